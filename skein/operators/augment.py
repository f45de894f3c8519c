"""Labelled augmentation: encoded variants of a table's texts with their lineage, and what the decoders make of them.

A choice that would be random is taken from a hash of the id, the seed and the step, so that results are the same under any
partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decode as D

Strategy = Callable[[Column, Column], Column]
STRATEGIES: dict[str, tuple[Strategy, str]] = {}


def strategy(name: str, decoder: str):
    """Registers ``f(text, hash) -> text`` under a name, with the decoder that its variants need."""

    def add(f: Strategy) -> Strategy:
        STRATEGIES[name] = (f, decoder)
        return f

    return add


@strategy("url_encode_full", "url_decode")
def _url(c, h):
    return D.percent_encode_all(c)


@strategy("url_encode_double", "url_decode")
def _double(c, h):
    return F.replace(D.percent_encode_all(c), F.lit("%"), F.lit("%25"))


@strategy("html_entity_encode", "html_entity")
def _html(c, h):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


@strategy("base64_encode", "base64_decode")
def _base64(c, h):
    std = F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", "")
    return F.when(h % 3 == 0, std).when(h % 3 == 1, F.translate(std, "+/", "-_")).otherwise(F.regexp_replace(std, "=+$", ""))


@strategy("hex_encode", "hex_decode")
def _hex(c, h):
    return F.lower(F.hex(F.encode(c, "UTF-8")))


@strategy("unicode_escape", "unicode_escape")
def _unicode(c, h):
    return D.unicode_escape_all(c)


@strategy("case_randomize", "case_fold")
def _case(c, h):
    return F.array_join(F.transform(F.split(c, ""), lambda x, i: F.when(F.pmod(F.xxhash64(h, i), F.lit(2)) == 0, F.upper(x)).otherwise(F.lower(x))), "")


@strategy("sql_concat_split", "string_concat")
def _concat(c, h):
    return F.regexp_replace(c, r"'([^']+)([^'])'", "'$1'+'$2'")


@strategy("path_encoding", "url_decode")
def _path(c, h):
    dots, slash, back = (F.replace(c, F.lit(a), F.lit(b)) for a, b in (("../", "%2e%2e%2f"), ("/", "%2f"), ("\\", "%5c")))
    return F.when(dots != c, dots).when(slash != c, slash).when(back != c, back).otherwise(c)


#: Chains: strategies applied one after the other.
CHAINS: dict[str, list[str]] = {name: [name] for name in STRATEGIES} | {"base64_then_url": ["base64_encode", "url_encode_full"], "unicode_then_double_url": ["unicode_escape", "url_encode_double"]}


def draw(*parts) -> Column:
    """A non-negative number that depends on its parts only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 31))


def augment(df: DataFrame, id_col: str, text_col: str, chains: dict[str, list[str]] | None = None, seed: int = 42) -> DataFrame:
    """A row per row and chain: (original id, chain name, obfuscation_chain, obfuscation_depth, decoder_requirements,
    generation_seed, variant, equal). Null texts have no variants; variants that equal their original are marked."""
    chains = chains or CHAINS
    made = []
    for name, chain in chains.items():
        out = F.col(text_col)
        for k, step in enumerate(chain):
            out = STRATEGIES[step][0](out, draw(F.col(id_col), F.lit(seed), F.lit(k)))
        needs = list(dict.fromkeys(STRATEGIES[s][1] for s in reversed(chain)))
        made.append(F.struct(F.lit(name).alias("strategy"), F.array(*map(F.lit, chain)).alias("obfuscation_chain"), F.lit(len(chain)).alias("obfuscation_depth"), F.array(*map(F.lit, needs)).alias("decoder_requirements"), out.alias("variant")))
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("original_id"), F.col(text_col).alias("_text"), F.inline(F.array(*made)))
    return rows.select("original_id", "strategy", "obfuscation_chain", "obfuscation_depth", "decoder_requirements", F.lit(seed).alias("generation_seed"), "variant", (F.col("variant") == F.col("_text")).alias("equal"))


def drawn_chain(df: DataFrame, id_col: str, text_col: str, weights: dict[str, float], seed: int = 42) -> DataFrame:
    """A row per row: one chain each, drawn by hash in proportion to ``weights``."""
    total, at, pick = sum(weights.values()), 0.0, F.lit(None).cast("string")
    u = draw(F.col(id_col), F.lit(seed), F.lit("chain")) / F.lit(float(1 << 31))
    for name, w in weights.items():
        pick = F.when(pick.isNull() & (u < (at + w) / total), F.lit(name)).otherwise(pick)
        at += w
    return augment(df.withColumn("_pick", pick), id_col, text_col, {k: CHAINS[k] for k in weights}, seed).join(df.select(F.col(id_col).alias("original_id"), pick.alias("strategy")), ["original_id", "strategy"], "left_semi")


def restoration(variants: DataFrame, originals: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per strategy: variants whose ``restored`` is exactly their original, holds it, or neither; and converged ones."""
    both = variants.join(originals.select(F.col(id_col).alias("original_id"), F.col(text_col).alias("_text")), "original_id")
    exact, holds = F.col("restored") == F.col("_text"), F.contains("restored", "_text")
    return both.groupBy("strategy").agg(F.count("*").alias("n"), F.count_if(exact).alias("exact"), F.count_if(holds & ~exact).alias("partial"), F.count_if(~holds).alias("failed"), F.count_if("meta.converged").alias("converged"))


def traceability(variants: DataFrame, originals: DataFrame, id_col: str) -> DataFrame:
    """Checks of lineage as rows: orphans, variants that equal their original, empty chains, originals without variants."""
    v = variants.join(originals.select(F.col(id_col).alias("original_id"), F.lit(1).alias("known")), "original_id", "left")
    a = v.agg(F.count_if(F.col("known").isNull()).alias("orphan"), F.count_if("equal").alias("unchanged"), F.count_if((F.size("obfuscation_chain") == 0) | (F.size("decoder_requirements") == 0)).alias("empty_chain"))
    missing = originals.select(F.col(id_col).alias("original_id")).join(variants, "original_id", "left_anti").agg(F.count("*").alias("uncovered"))
    one = a.crossJoin(missing)  # one row each
    return one.unpivot([], ["orphan", "unchanged", "empty_chain", "uncovered"], "check", "failing").withColumn("passed", F.col("failing") == 0)
