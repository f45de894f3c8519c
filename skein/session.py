"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

REPO = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers that start from now on import this package in local mode; clusters ship it with --py-files."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if REPO not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(x for x in (REPO, known) if x)
    return spark


def local_session(name: str = "skein", cores: str = "8", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return prepare(builder.getOrCreate())
