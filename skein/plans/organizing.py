"""Queries of whole corpora organised from files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import corpus, organize
from .queries import query, t

_RECORDS = """r as (select d.doc_id, case when d.doc_id % 13 = 0 then 7 else coalesce(l.toxic, 0) end as label, case when d.doc_id % 11 = 0 then '' else d.text end as material,
  case d.doc_id % 3 when 0 then 'request' when 1 then 'field' else 'llm_context' end as level, d.lang, d.source, d.doc_id % 5 = 0 as variant,
  case when d.doc_id % 4 = 0 then 'test' else 'validation' end as split from documents d left join labels l using (doc_id)),
 j as (select *, case when label not in (0, 1) then 'invalid label' when material = '' then case when level = 'request' then null else 'empty ' || level || ' material' end
   when label = 1 and doc_id % 7 = 0 then 'invalid attack type' end as reason from r),
 k as (select *, case when reason is not null then reason when material = '' and label = 1 and doc_id % 7 = 0 then 'invalid attack type' end as why from j)"""


#: Bytes of text of a file of records, more or less: a file is an array that one task holds.
FILE = 1 << 22


def _files(spark, d):
    """Files of JSON arrays of some ``FILE`` bytes of text, as many as that takes and eight at least, with records of every kind, and one that is no JSON."""
    doc, label = F.col("doc_id"), F.when(F.col("doc_id") % 13 == 0, 7).otherwise(F.coalesce("toxic", F.lit(0)))
    docs = t(spark, d, "documents").join(t(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    text = F.when(doc % 11 == 0, "").otherwise(F.col("text"))
    record = F.struct(
        label.alias("label"), F.when(doc % 7 == 0, " Unknown ").otherwise(F.concat(F.lit("Type "), F.col("lang"), F.lit("!"))).alias("attack_type"), F.when(doc % 4 == 0, "TEST").alias("split"),
        F.when(doc % 3 == 1, text).alias("payload"), F.when(doc % 3 == 0, text).alias("raw_request"), F.when(doc % 3 == 2, text).alias("conversation"), (doc % 5 == 0).alias("is_encoding_variant"), doc.alias("doc_id"),
    )
    folder = corpus.scratch(spark)
    files = max(8, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE)
    dealt = docs.withColumn("k", F.pmod(F.xxhash64("doc_id", "text"), F.lit(files))).repartition(files, "k")
    arrays = dealt.groupBy("k").agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.select("value").write.option("compression", "none").option("maxRecordsPerFile", 1).text(f"{folder}/data_validation")
    spark.range(1).select(F.lit('[{"label": 1').alias("value")).coalesce(1).write.text(f"{folder}/broken")
    return folder


@query(f"""with {_RECORDS}, s as (select case when why is not null then 'quarantine' when label = 1 then 'attack' else 'normal' end as bucket,
    case when why is not null then '-' when label = 1 then case when variant then 'obfuscated' else 'original' end else '-' end as representation,
    case when why is not null then '-' when label = 1 then 'type_' || lang else 'normal' end as attack_type, case when why is not null then '-' else level end as level,
    case when why is not null then '-' when split = 'test' then 'test' else 'unspecified' end as split, why as reason from k
    union all select 'quarantine', '-', '-', '-', '-', 'unreadable')
  select bucket, representation, attack_type, level, split, coalesce(reason, '') as reason, count(*) as n from s group by all""")
def io_organize(spark, d):
    """Shards and quarantine of a corpus of files with bad records in them."""
    folder = _files(spark, d)
    records = organize.read_record_arrays(spark, [f"{folder}/data_validation", f"{folder}/broken"])
    organize.organize(records, f"{folder}/organized")
    written = organize.read_shards(spark, f"{folder}/organized")
    return written.groupBy(*organize.SHARD, F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""with {_RECORDS} select 'attack' as bucket, level, count(*) as n from k where why is null and label = 1 group by level
  union all select 'normal', level, count(*) from k where why is null and label = 0 group by level union all select 'quarantine', reason, count(*) from (select coalesce(why, '') as reason from k where why is not null union all select 'unreadable') group by reason""")
def io_manifest(spark, d):
    """The same corpus by its manifest, read back from JSON."""
    folder = _files(spark, d)
    organize.organize(organize.read_record_arrays(spark, [f"{folder}/data_validation", f"{folder}/broken"]), f"{folder}/organized")
    m = organize.read_manifest(spark, f"{folder}/organized")
    rows = [(b, k, n) for b in ("attack", "normal") for k, n in m["levels"][b].items()] + [("quarantine", k, n) for k, n in m["quarantine_reasons"].items()]
    return spark.createDataFrame(rows, "bucket string, level string, n long")
