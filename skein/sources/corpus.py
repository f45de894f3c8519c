"""Files of labelled corpora and logs: JSON arrays, JSON lines, partitioned shards, inventories, gates."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: how a placeholder of a large file begins.
POINTER = "version https://git-lfs.github.com/spec/"


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which every executor reaches; a folder of its own only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared}/corpus-{uuid.uuid4().hex}" if shared else f"{tempfile.mkdtemp(prefix='spark-')}/rows"


def read_arrays(spark: SparkSession, paths: list[str], schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, broken): records of files that hold a JSON array, and what couldn't be read, with its file."""
    held = StructType(list(schema)).add("_corrupt", "string")
    df = spark.read.schema(held).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(paths)
    df = df.withColumn("file", F.col("_metadata.file_path"))
    return df.where("_corrupt is null").drop("_corrupt"), df.where("_corrupt is not null").select("file", "_corrupt")


def read_lines(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a broken one fails the job and names its file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def read_log(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """A log in JSON lines without its malformed lines."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def union_all(parts: list[DataFrame], exclude: str | None = None) -> DataFrame:
    """Record sets of different columns as one, each row with its ``file``; files that match ``exclude`` are left out."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p if "file" in p.columns else p.withColumn("file", F.col("_metadata.file_path")) for p in parts))
    return df.where(~F.rlike("file", F.lit(exclude))) if exclude else df


def origin(path: Column, declared: Column) -> Column:
    """struct(source, split) of a file's path; a declared split wins, and one that isn't known is unspecified."""
    known = ["train", "validation", "test", "evaluation"]
    folders = F.split(path, "/")
    named = F.get(F.filter(F.transform(folders, lambda f: F.regexp_replace(f, r"\.jsonl?$", "")), lambda f: f.isin(known)), F.lit(0))
    source = F.element_at(F.filter(F.slice(folders, 1, F.size(folders) - 1), lambda f: ~f.isin("", *known)), -1)
    return F.struct(source.alias("source"), F.coalesce(F.when(F.lower(declared).isin(known), F.lower(declared)), named, F.lit("unspecified")).alias("split"))


def write_shards(df: DataFrame, path: str, by: list[str]) -> None:
    """A folder per value of ``by``. Rows of a value are spread over the tasks that hold them: no task gathers a hot value."""
    df.write.partitionBy(*by).mode("overwrite").parquet(path)


def misplaced(df: DataFrame, column: str, kept: str) -> DataFrame:
    """Rows whose partition folder differs from the value they carry."""
    return df.where(~F.col(column).eqNullSafe(F.col(kept)))


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, bytes, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tree_fingerprint(files: DataFrame) -> DataFrame:
    """Files, bytes and an order-free fingerprint of a folder, from an inventory."""
    name = F.element_at(F.split("file", "/"), -1)
    return files.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.hex(F.bit_xor(F.xxhash64(name, "sha256"))).alias("fingerprint"))


def unreadable(text: Column) -> Column:
    """Why a file's text can't be used: a placeholder, empty, or wrong UTF-8; null if it can."""
    return F.when(F.startswith(text, F.lit(POINTER)), "placeholder").when(F.trim(text) == "", "empty").when(~F.is_valid_utf8(text), "invalid_utf8")


def catalog(df: DataFrame, items: str, key: str) -> DataFrame:
    """A row per item of a nested catalog, under its upper-cased key; an item listed twice stays once."""
    rows = df.select(F.explode(items).alias("item")).select("item.*")
    return rows.withColumn(key, F.upper(F.trim(F.col(key)))).dropDuplicates([key])


def payload_of(df: DataFrame, columns: list[str]) -> Column:
    """The first of ``columns`` that says something, as text."""
    have = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns if c in df.columns]
    return F.coalesce(*have, F.lit("")) if have else F.lit("")


def parse_time(text: Column) -> Column:
    """ISO 8601 to a timestamp; without an offset it is UTC; what can't be read is null."""
    zoned = F.when(F.rlike(text, F.lit(r"(?:Z|[+-]\d{2}:?\d{2})$")), text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(zoned)
