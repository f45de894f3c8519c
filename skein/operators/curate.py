"""Corpus curation: fingerprints, first-occurrence deduplication, hash splits, caps, audits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP = 0xFFFFFFFFFFFFF


def content_hash(level: Column, material: Column) -> Column:
    return F.sha2(F.concat(level, F.lit("\0"), material), 256)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order: a min-aggregate combined before the shuffle, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def hash_split(group: Column, prefix: str = "", train: float = 0.75, validation: float = 0.87) -> Column:
    """train / validation / test by the first 52 bits of SHA-256 of the group, so a group never crosses splits."""
    share = F.conv(F.substring(F.sha2(F.concat(F.lit(prefix), group), 256), 1, 13), 16, 10).cast("bigint") / F.lit(TOP)
    return F.when(share < train, "train").when(share < validation, "validation").otherwise("test")


def rank_split(df: DataFrame, family: str, key: Column) -> DataFrame:
    """75 / 12.5 / 12.5 per family in the order of a hash."""
    w = Window.partitionBy(family)
    r, n = F.row_number().over(w.orderBy(F.sha2(key, 256))), F.count("*").over(w)
    return df.withColumn("split", F.when(r <= F.floor(n * 0.75), "train").when(r <= F.floor(n * 0.875), "validation").otherwise("test"))


def class_cap(n: Column, policy: str, rare: int = 20) -> Column:
    """How many of a class of ``n`` rows stay: all, cap_N, sqrt or log of the size; classes of up to ``rare`` stay whole."""
    if policy.startswith("cap_"):
        kept = F.lit(int(policy.split("_", 1)[1]))
    else:
        kept = {"all": n, "sqrt": F.bround(F.sqrt(n * rare)), "log": F.bround(rare * (1 + F.log2(n / rare)))}[policy]
    return F.when(n <= rare, n).otherwise(F.least(F.greatest(kept.cast("bigint"), F.lit(rare)), n)).cast("bigint")


def quota_sample(df: DataFrame, by: list[str], quota: int, key: Column) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.md5(key))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= quota).drop("_n")


def crossing_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def checks(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """A row per check: failing rows and whether it passed; one aggregate over the table."""
    one = df.agg(*(F.count_if(~F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()))
    return one.unpivot([], list(tests), "check", "failing").withColumn("passed", F.col("failing") == 0)


def data_level(r: dict[str, Column]) -> Column:
    """field, request, context, protocol or llm_context: declared, else by what a record has. ``r`` names the columns there are."""
    c = lambda k: r.get(k, F.lit(None).cast("string"))
    declared = F.lower(c("data_level"))
    asked = c("raw_request").isNotNull() | c("url").isNotNull() | c("method").isNotNull()
    return (
        F.when(declared.isin("field", "request", "context", "protocol", "llm_context"), declared).when(c("protocol_event").isNotNull(), "protocol").when(c("conversation").isNotNull(), "llm_context")
        .when(c("detection_scope").isin("authorization_or_request_sequence", "llm_conversation_or_output"), "context").when(asked, "request").otherwise("field")
    )


def representation(r: dict[str, Column]) -> Column:
    """struct(representation, basis): obfuscated only where a record says how it was derived; the first basis counts."""
    c = lambda k: r.get(k, F.lit(None).cast("string"))
    dataset, variant = c("source_dataset"), F.lower(F.coalesce(c("variant"), F.lit("raw")))
    named = [
        ("dedicated_obfuscated_attack_dataset", dataset == "obfuscated_attack_traffic"),
        ("all_original_generated_variant", dataset == "all_original_obfuscated"),
        ("explicit_is_encoding_variant", F.coalesce(c("is_encoding_variant").cast("boolean"), F.lit(False))),
        ("contrastive_non_raw_variant", (dataset == "enriched_traffic") & (c("pair_role") == "attack") & ~variant.isin("", "raw", "original")),
        ("specialized_non_raw_encoding", (dataset == "specialized_traffic/payloads") & c("decoded_payload").isNotNull() & ~F.lower(F.coalesce(c("encoding"), F.lit("raw"))).isin("", "raw")),
        ("validation_obfuscation_id", (dataset == "validation") & F.rlike(F.lower(F.coalesce(c("id"), F.lit(""))), F.lit("(?:^|_)(?:obf|combo)(?:_|$)"))),
    ]
    basis = F.coalesce(*(F.when(test, F.lit(k)) for k, test in named))
    return F.struct(F.when(basis.isNull(), "original").otherwise("obfuscated").alias("representation"), F.coalesce(basis, F.lit("no_explicit_obfuscation_derivation")).alias("basis"))


def group_identity(kind: Column, organized: Column, group: Column, original: Column, content: Column) -> Column:
    """The group of a record within its type: its original's id, its group, its original or its content."""
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    named = [F.concat(F.lit(f"{k}:"), some(c)) for k, c in (("organized", organized), ("group", group), ("original", original), ("content", content))]
    return F.concat(F.coalesce(kind, F.lit("unknown")), F.lit("|"), F.coalesce(*named))


def fill_groups(df: DataFrame, kind: str, group: str, policy: str, rare: int = 20, seed: int = 42) -> DataFrame:
    """The rows of ``df`` whose groups fill each type's cap: whole groups in the order of a hash, those that don't fit skipped
    (the first always fits).

    A group is summed up before it moves; a type's summaries are read in order as a stream, with one running count.
    """
    sizes = df.groupBy(kind, group).agg(F.count("*").alias("n"))
    caps = sizes.groupBy(kind).agg(F.sum("n").alias("available")).select(F.col(kind).alias("_kind"), class_cap(F.col("available"), policy, rare).alias("cap"))
    rows = sizes.join(caps, F.col(kind).eqNullSafe(F.col("_kind"))).select(F.col(kind).alias("kind"), F.col(group).alias("grp"), "n", "cap", F.sha2(F.concat(F.lit(f"{seed}|"), F.col(group)), 256).alias("at"))

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken = object(), 0
        for frame in frames:
            keep = []
            for k, n, cap in zip(frame["kind"], frame["n"], frame["cap"]):
                if k != now:
                    now, taken = k, 0
                fits = taken < cap and (not taken or taken + n <= cap)
                taken += n if fits else 0
                keep.append(fits)
            yield frame.loc[keep, ["kind", "grp"]]

    schema = df.schema
    out = f"kind {schema[kind].dataType.simpleString()}, grp {schema[group].dataType.simpleString()}"
    chosen = rows.repartition("kind").sortWithinPartitions("kind", "at").mapInPandas(fill, out).withColumnsRenamed({"kind": "_kind", "grp": "_grp"})
    return df.join(chosen, F.col(kind).eqNullSafe(F.col("_kind")) & F.col(group).eqNullSafe(F.col("_grp")), "left_semi")


def inherit_split(variants: DataFrame, originals: DataFrame, original_id: str, id_col: str, split: str = "split") -> DataFrame:
    """``variants`` with the split of their originals; null where there is none."""
    return variants.join(originals.select(F.col(id_col).alias(original_id), F.col(split)), original_id, "left")
