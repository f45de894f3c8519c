"""Per-client windows over event streams: trailing frames, scanner scores, buckets, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trailing(df: DataFrame, client: str, ts: str, seq: str, seconds: int, item: Column) -> DataFrame:
    """``df`` with ``frame``: the client's items of the last ``seconds``, own row included. Rows of the same instant count
    up to their own place in ``seq``. Frames are as long as the window's own traffic; partitioning is by client."""
    w = Window.partitionBy(client).orderBy(F.col(ts).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    held = F.collect_list(F.struct(F.col(ts).alias("t"), F.col(seq).alias("s"), item.alias("v"))).over(w)
    seen = F.filter(held, lambda e: (e["t"] < F.col(ts)) | (e["s"] <= F.col(seq)))
    return df.withColumn("frame", F.transform(seen, lambda e: e["v"]))


def scanner_score(n: Column, paths: Column, probes: Column, targets: Column, agent: Column) -> Column:
    """Points for a scanner's agent, many paths, many requests, probes and attack-shaped targets."""
    points = lambda test, p: F.when(test, p).otherwise(0)
    return points(agent, 1) + points((paths >= 8) & (n >= 8), 2) + points(n >= 25, 1) + F.when(probes >= 2, 4).when(probes >= 1, 1).otherwise(0) + F.when(targets >= 2, 3).when(targets >= 1, 1).otherwise(0)
