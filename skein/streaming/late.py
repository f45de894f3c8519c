"""Streams whose late rows are kept: what the watermark has passed goes to a sink of its own."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def split_late(stream: DataFrame, at: str, delay: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Runs ``stream`` over what is there now, and returns (rows in time, late rows), both read back from below ``folder``.

    A row is late if its event time lies more than ``delay`` behind the latest one of all earlier batches, which is Spark's own watermark; but where
    Spark drops such rows before a stateful operator, here every row lands in exactly one of the sinks. Rows without an event time are late.

    Each batch writes folders of its own number over again, and the watermark comes from what the earlier numbers have written, so a batch that is
    repeated after a failure gives the same rows and none twice.
    """
    spark = stream.sparkSession
    main, late, seen = (f"{folder}/{name}" for name in ("in_time", "late", "seen"))

    def split(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        try:
            known = session.read.parquet(seen).where(F.col("batch") < number)
            latest = known.agg(F.max("latest")).first()[0]
        except AnalysisException:  # nothing has been written yet
            latest = None
        passed = F.lit(None).cast("timestamp") if latest is None else F.lit(latest) - F.expr(f"interval {delay}")
        is_late = F.col(at).isNull() | F.coalesce(F.col(at) < passed, F.lit(False))
        batch = batch.persist()
        try:
            batch.where(~is_late).write.mode("overwrite").parquet(f"{main}/batch={number}")
            batch.where(is_late).write.mode("overwrite").parquet(f"{late}/batch={number}")
            batch.agg(F.max(at).alias("latest")).write.mode("overwrite").parquet(f"{seen}/batch={number}")
        finally:
            batch.unpersist()

    query = stream.writeStream.foreachBatch(split).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = StructType([*stream.schema, StructField("batch", IntegerType())])
    return spark.read.schema(schema).parquet(main), spark.read.schema(schema).parquet(late)


def corrected(in_time: DataFrame, late: DataFrame, by: list, **aggregates) -> DataFrame:
    """Aggregates over both sinks, and how many rows came late into each group."""
    all_ = in_time.withColumn("_late", F.lit(0)).unionByName(late.withColumn("_late", F.lit(1)))
    return all_.groupBy(*by).agg(*(c.alias(k) for k, c in aggregates.items()), F.sum("_late").alias("late"))
