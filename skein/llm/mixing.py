"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks.

Every source's documents fall by a seeded hash into the same number of blocks, in permuted order. A source's target
makes its block quota: so many whole passes over all blocks, and then blocks of one more pass. The tree splits the
exact quotas of all sources between the two halves of the output shards, again and again, each split a
multivariate-hypergeometric draw, until every shard has its own quotas. Shards then take disjoint ranges of each
source's permuted blocks, and shuffle their documents locally.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, WORD, checkpointed

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
BLOCKS = 1024


def water_fill(sizes: list[float], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is over is shared again by weight."""
    target, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        scale = rest / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * scale > most * sizes[i]}
        for i in full or open_:
            target[i] = most * sizes[i] if full else weights[i] * scale
        rest -= sum(target[i] for i in full)
        open_ -= full or open_
    return target


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """quotas (draws of each source) -> (shards, sources) counts that add up to them, by recursive halving."""
    rng = np.random.default_rng(seed)

    def split(counts: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
        if hi - lo == 1:
            return [counts]
        mid = (lo + hi) // 2
        size = int(counts.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(counts, size, method="marginals")
        return split(left, lo, mid) + split(counts - left, mid, hi)

    return np.array(split(quotas.astype(np.int64), 0, shards))


def _picks(pdf: pd.DataFrame, blocks: int) -> pd.DataFrame:
    """Of one source's blocks (at most ``blocks`` rows): the slots of those that the last pass takes whole, in permuted
    order. A block is taken if it fits in what is left; then one is put in, or exchanged for a taken one, if that
    comes nearer to the quota. What is still left goes to single documents of the first block that is larger."""
    pdf = pdf.sort_values("block")
    block, words, rest = pdf["block"].to_numpy(), pdf["words"].to_numpy(np.float64), float(pdf["rest"].iloc[0])
    taken = np.zeros(len(block), bool)
    for k, n in enumerate(words):
        if n <= rest:
            taken[k], rest = True, rest - n
    gone, put = np.r_[-1, np.flatnonzero(taken)], np.flatnonzero(~taken)
    if len(put) and rest > 0:
        change = words[put][None, :] - np.where(gone < 0, 0, words[gone])[:, None]
        i, j = np.unravel_index(np.abs(rest - change).argmin(), change.shape)
        if abs(rest - change[i, j]) < rest:
            taken[put[j]], rest = True, rest - change[i, j]
            if gone[i] >= 0:
                taken[gone[i]] = False
    slot = np.full(blocks, -1)
    slot[block[taken]] = np.arange(taken.sum())
    cut = np.flatnonzero(~taken & (words > rest))
    return pd.DataFrame({"skey": [pdf["skey"].iloc[0]], "slots": [slot.tolist()], "picked": [int(taken.sum())], "cut": [int(block[cut[0]]) if len(cut) and rest > 0 else -1], "left": [rest]})


def plan(sizes: DataFrame, weights: tuple[float, ...], shards: int, blocks: int, seed: int) -> DataFrame:
    """One row per source: sizes, target, passes, slots of the last pass, the cut block and its last hash, shard bounds.

    ``sizes`` has (skey, source, block, h, size). The driver sees a row per source (mixing weights are given by source),
    never blocks or documents.
    """
    spark = sizes.sparkSession
    per_block = checkpointed(sizes.groupBy("skey", "source", "block").agg(F.sum("size").alias("words")))
    totals = [(r["skey"], r["source"], r["n"]) for r in per_block.groupBy("skey", "source").agg(F.sum("words").alias("n")).collect()]
    totals.sort(key=lambda r: (r[1] is None, r[1] or ""))
    targets = water_fill([float(n) for *_, n in totals], [weights[i % len(weights)] for i in range(len(totals))], float(sum(n for *_, n in totals)))
    heads = [(k, int(n), float(t), int(t // n) if n else 0, float(t - (t // n) * n) if n else 0.0) for (k, _, n), t in zip(totals, targets)]
    by_source = spark.createDataFrame(heads, "skey string, source_size long, target double, passes int, rest double")

    picked = per_block.join(by_source.select("skey", "rest"), "skey").groupBy("skey").applyInPandas(lambda pdf: _picks(pdf, blocks), "skey string, slots array<int>, picked int, cut int, left double")
    picked = checkpointed(picked)
    cut = picked.select("skey", F.col("cut").alias("block"), "left")
    inside = sizes.join(_hint(cut, len(heads)), ["skey", "block"])
    order = Window.partitionBy("skey").orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("sum", F.sum("size").over(order)).where("sum <= left").groupBy("skey").agg(F.max("h").alias("last_h"))
    done = by_source.join(picked, "skey").join(last, "skey", "left")
    draws = {r["skey"]: r["passes"] * blocks + r["picked"] + 1 for r in done.select("skey", "passes", "picked").collect()}
    keys = sorted(draws)
    bounds = np.cumsum(np.vstack([np.zeros(len(keys), np.int64), splitting_tree(np.array([draws[k] for k in keys]), shards, seed)]), axis=0) if keys else np.zeros((1, 0))
    cuts = spark.createDataFrame([(k, [int(x) for x in bounds[1:, i]]) for i, k in enumerate(keys)], "skey string, bounds array<int>")
    return _hint(done.join(cuts, "skey").select("skey", "source_size", "target", "passes", "slots", "cut", "last_h", "bounds"), len(keys))


def _hint(df: DataFrame, sources: int) -> DataFrame:
    """A row per source, about 5 KB each: broadcast up to 1,000 sources, joined by shuffle beyond."""
    return F.broadcast(df) if sources <= BROADCAST_ROWS // 20 else df


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, shards: int = 32, blocks: int = BLOCKS, seed: int = 5) -> DataFrame:
    """``docs`` with (size, source_size, target, taken, shards): the words that the mix takes of each document, repeats
    counted, and the output shard of every copy.

    Documents are taken whole, so a source comes within about one document of its target; sources without words have
    target 0 and take nothing; null and empty texts have size 0; a null source is a source of its own, last in the
    order of weights; repeated rows fall into the same block; an empty table gives an empty one. Equal input gives equal
    output, whatever the partitions. Columns of ``docs`` named like those of the result are replaced.
    """
    made = ["size", "source_size", "target", "taken", "shards"]
    base = docs.drop(*(c for c in made if c not in (id_col, text_col, source_col)))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    skey = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    keyed = lambda df: df.withColumn("_size", size).withColumn("_skey", skey).withColumn("_h", F.xxhash64(F.lit(seed), F.col("_skey"), F.col(id_col), F.col("_size"))).withColumn("_block", F.pmod(F.col("_h"), F.lit(blocks)).cast("int")).withColumn("_h", F.xxhash64(F.col("_h")))
    sizes = checkpointed(keyed(base).select(F.col("_skey").alias("skey"), F.col(source_col).alias("source"), F.col("_block").alias("block"), F.col("_h").alias("h"), F.col("_size").alias("size")))
    sources = plan(sizes, weights, shards, blocks, seed)
    sources = sources.select(*(F.col(c).alias(f"_p_{c}") for c in sources.columns))
    out = keyed(base).join(sources, F.col("_skey") == F.col("_p_skey"))
    slot = F.element_at("_p_slots", F.col("_block") + 1)
    more = F.when(slot >= 0, slot).when((F.col("_block") == F.col("_p_cut")) & (F.col("_h") <= F.col("_p_last_h")), F.array_max("_p_slots") + 1)
    # the k-th whole pass goes through the blocks in an order of its own
    turn = F.transform(F.sequence(F.lit(0), F.col("_p_passes")), lambda k: F.when(k < F.col("_p_passes"), k * blocks + F.pmod(F.col("_block") * (2 * k + 1) + k * 7, F.lit(blocks))).otherwise(k * blocks + more))
    places = F.filter(turn, lambda t: t.isNotNull())
    shard = F.transform(places, lambda t: F.least(F.size(F.filter("_p_bounds", lambda b: b <= t)), F.lit(shards - 1)))
    out = out.withColumn("shards", F.when(F.col("_size") > 0, shard).otherwise(F.array().cast("array<int>")))
    return out.select(*base.columns, F.col("_size").alias("size"), F.col("_p_source_size").alias("source_size"), F.col("_p_target").alias("target"), (F.col("_size") * F.size("shards")).alias("taken"), "shards")


def mix(docs: DataFrame, id_col: str = "doc_id", shards: int = 32, seed: int = 5, **options) -> DataFrame:
    """The mixed corpus: a row of ``docs`` for each copy taken, a partition per shard, shuffled inside it."""
    copies = mix_plan(docs, id_col, shards=shards, seed=seed, **options).select(*docs.columns, F.posexplode("shards").alias("_copy", "_shard"))
    dealt = copies.repartitionById(shards, F.col("_shard")).sortWithinPartitions("_shard", F.xxhash64(F.lit(seed), F.col(id_col), F.col("_copy")))
    return dealt.select(*docs.columns)
