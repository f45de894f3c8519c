"""A corpus of labelled record files organised into shards: one pass, bad records set aside, a manifest that adds up."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.curate import content_hash

#: What is read of a record; everything else stays in its text.
FIELDS = "label string, attack_type string, data_level string, split string, payload string, obfuscated_payload string, is_encoding_variant boolean, raw_request string, method string, url string, protocol_event string, conversation string, detection_scope string"
# The levels and splits that a record may declare.
LEVELS = ["field", "request", "context", "protocol", "llm_context"]
SPLITS = ["train", "validation", "test", "evaluation"]
#: The folders of a shard, outermost first.
SHARD = ["bucket", "representation", "attack_type", "level", "split"]


def read_record_arrays(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, position, record): the elements of files that hold one JSON array each, as JSON text; the position counts from 1.

    A file that is no array of objects is one row of position 0 with its text, for the quarantine. A file is read by one task, as a JSON array can't be
    split; write JSON lines for files beyond a task's memory.
    """
    whole = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = whole.withColumn("array", F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"))
    items = parsed.where("array is not null").select("file", F.posexplode("array").alias("at", "item"))
    good = items.select("file", (F.col("at") + 1).cast("long").alias("position"), F.to_json("item").alias("record"))
    return good.union(parsed.where("array is null").select("file", F.lit(0).cast("long"), "value"))


def read_record_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, position, record) of JSON lines; the position orders the lines of a file, without being their number."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id()).alias("position"), F.col("value").alias("record")).where("trim(record) <> ''")


def level_of(r: Column) -> Column:
    """The level that a record declares, else the one that its fields speak of."""
    declared = F.lower(r["data_level"])
    context = r["detection_scope"].isin("authorization_or_request_sequence", "llm_conversation_or_output")
    request = r["raw_request"].isNotNull() | r["url"].isNotNull() | r["method"].isNotNull()
    return F.when(declared.isin(LEVELS), declared).when(r["protocol_event"].isNotNull(), "protocol").when(r["conversation"].isNotNull(), "llm_context").when(context, "context").when(request, "request").otherwise("field")


def material_of(r: Column, level: Column) -> Column:
    """What a record is about, for its fingerprint."""
    full = lambda c: F.nullif(c, F.lit(""))
    request = F.to_json(F.struct(F.coalesce(r["method"], F.lit("GET")).alias("method"), F.coalesce(r["url"], F.lit("/")).alias("url")))
    by_level = F.when(level == "field", F.coalesce(full(r["obfuscated_payload"]), full(r["payload"]), F.lit(""))).when(level == "request", F.coalesce(full(r["raw_request"]), request)).when(level == "protocol", r["protocol_event"]).when(level == "llm_context", r["conversation"]).otherwise(r["raw_request"])
    return F.when(F.coalesce(r["is_encoding_variant"], F.lit(False)) & r["obfuscated_payload"].isNotNull(), r["obfuscated_payload"]).otherwise(F.coalesce(by_level, F.lit("")))


def classified(records: DataFrame) -> DataFrame:
    """``records(file, position, record)`` with where each belongs (``SHARD``), its fingerprint, and ``reason`` where it is no usable record."""
    known = F.try_parse_json("record")
    r = records.withColumn("r", F.from_json(F.when(F.startswith(F.schema_of_variant(known), F.lit("OBJECT")), F.col("record")), FIELDS))
    level = level_of(F.col("r"))
    r = r.withColumn("level", level).withColumn("material", material_of(F.col("r"), F.col("level")))
    kind = F.regexp_replace(F.regexp_replace(F.trim(F.lower("r.attack_type")), r"[^a-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
    attack = F.col("r.label") == "1"
    reason = (
        F.when(F.col("r").isNull(), "unreadable").when(~F.coalesce(F.col("r.label").isin("0", "1"), F.lit(False)), "invalid label").when(F.col("material") == "", F.concat(F.lit("empty "), F.col("level"), F.lit(" material")))
        .when(attack & F.coalesce(kind.isin("", "normal", "unknown", "missing"), F.lit(True)), "invalid attack type")
    )
    named = F.regexp_extract(F.lower(F.element_at(F.split("file", "/"), -1)), r"(?:^|_)(validation|train|test)(?:[_.]|$)", 1)
    split = F.when(F.lower("r.split").isin(SPLITS), F.lower("r.split")).otherwise(F.coalesce(F.nullif(named, F.lit("")), F.lit("unspecified")))
    r = r.withColumn("reason", reason)
    good = F.col("reason").isNull()
    variant = F.coalesce(F.col("r.is_encoding_variant"), F.lit(False))
    return r.select(
        "file", "position", "record", "reason",
        F.when(~good, "quarantine").when(attack, "attack").otherwise("normal").alias("bucket"),
        F.when(good & attack, F.when(variant, "obfuscated").otherwise("original")).otherwise("-").alias("representation"),
        F.when(good & attack, kind).otherwise(F.when(good, "normal").otherwise("-")).alias("attack_type"),
        F.when(good, F.col("level")).otherwise("-").alias("level"), F.when(good, split).otherwise("-").alias("split"),
        F.when(good, content_hash(F.col("level"), F.col("material"))).alias("content_sha256"), F.col("r.label").alias("label"),
    )


def organize(records: DataFrame, folder: str) -> dict:
    """Writes ``records(file, position, record)`` below ``folder`` and returns the manifest, which is written beside them as JSON.

    One pass: a record's shard is a partition folder (bucket, representation, attack type, level, split), and the quarantine is a bucket like the
    others, with the reason and the place of each record. What went by is counted on the way (``Observation``); the shards' own counts
    come from what was written, and the manifest only stands if both agree.
    """
    spark, seen = records.sparkSession, Observation()
    rows = classified(records)
    counted = rows.observe(seen, F.count("*").alias("records"), F.count_if(F.col("bucket") == "quarantine").alias("quarantined"), F.count_if(F.col("bucket") == "attack").alias("attacks"), F.count_if(F.col("bucket") == "normal").alias("normal"))
    counted.write.mode("overwrite").partitionBy(*SHARD).json(f"{folder}/shards")
    written = read_shards(spark, folder)
    shards = [r.asDict() for r in written.groupBy(*SHARD).count().orderBy(*SHARD).collect()]  # one row a shard folder
    reasons = {r["reason"]: r["count"] for r in written.where("bucket = 'quarantine'").groupBy("reason").count().collect()}
    content = written.where("bucket <> 'quarantine'").groupBy("content_sha256").agg(F.count_distinct("label").alias("labels"))
    audit = content.agg(F.count("*").alias("unique_content"), F.count_if(F.col("labels") > 1).alias("conflicts")).first()
    totals = seen.get
    if sum(s["count"] for s in shards) != totals["records"] or sum(reasons.values()) != totals["quarantined"]:
        raise RuntimeError(f"{totals} went by, but {sum(s['count'] for s in shards)} records were written")
    manifest = {
        "records": totals["records"], "label_counts": {"normal": totals["normal"], "attack": totals["attacks"]}, "quarantined": totals["quarantined"], "quarantine_reasons": dict(sorted(reasons.items())),
        "attack_types": _counts(shards, "attack", "attack_type"), "representations": _counts(shards, "attack", "representation"),
        "levels": {b: _counts(shards, b, "level") for b in ("normal", "attack")}, "splits": {b: _counts(shards, b, "split") for b in ("normal", "attack")},
        "content": {"unique": audit["unique_content"], "label_conflicts": audit["conflicts"]}, "shards": shards,
    }
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest


def _counts(shards: list[dict], bucket: str, by: str) -> dict[str, int]:
    made: dict[str, int] = {}
    for s in shards:
        if s["bucket"] == bucket:
            made[s[by]] = made.get(s[by], 0) + s["count"]
    return dict(sorted(made.items()))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The organised records of a folder with their shards; a filter on these reads the folders it names alone."""
    columns = "file string, position long, record string, reason string, content_sha256 string, label string, " + ", ".join(f"{c} string" for c in SHARD)
    return spark.read.schema(columns).json(f"{folder}/shards")


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
