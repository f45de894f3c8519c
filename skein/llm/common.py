"""Shared Spark helpers: cutting lineage, links inside buckets, connected components, vector statistics."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this package: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hot buckets up to this many are broadcast; a longer list is joined by shuffle.
BROADCAST_ROWS = 20_000
#: Rows of a few numbers each in one task at least, where their number is known.
TASK_ROWS = 20_000
#: Bits of a filter for each of its keys, and in all at most (16 MB); bits in one of its rows; bits that a key sets.
KEY_BITS, FILTER_BITS, ROW_BITS, SET_BITS = 16, 1 << 27, 1 << 15, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder of ``spark.checkpoint.dir``; one of its own only where that is unset."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def small_batches(df: DataFrame) -> None:
    """Sends Python workers at most 2,048 rows at a time where the session has Spark's default of 10,000: texts of some
    KB would make batches of many MB in the executor and the worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, "2048")


def give_back() -> None:
    """Hands memory that Arrow's pool and the C library keep for later back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lower_ascii(column):
    """Lower-cases A-Z only, unlike ``lower``."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where ``rows`` (counted by the caller) is within the bound; else Spark joins by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fitted(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df`` in no more partitions than ``rows`` (counted by the caller) need: every task that shuffles writes files of its own, however few its rows."""
    return df.coalesce(max(1, -(-rows // each)))


def sifted(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``key`` can be in the first column of ``keys``, and those whose ``key`` surely isn't; no row of ``df`` is shuffled.

    A Bloom filter, each key within one of its rows, is broadcast: some 0.5 % of the other rows are taken for ones with a key, more where
    the keys are so many that the filter is at its bound, so a join must follow. Null keys are in neither set of keys, and so surely aren't.
    """
    keys = checkpointed(keys.select(F.col(keys.columns[0]).alias("k")).where("k is not null"))
    n, bits_wanted = 1, min(FILTER_BITS, KEY_BITS * keys.count())
    while n * ROW_BITS < bits_wanted:
        n *= 2

    def places(k: Column) -> tuple[Column, list[Column]]:
        more = F.xxhash64(F.lit(2), k)
        return F.pmod(F.xxhash64(F.lit(1), k), F.lit(n)), [F.shiftrightunsigned(more, 15 * i).bitwiseAND(F.lit(ROW_BITS - 1)) for i in range(SET_BITS)]

    at, bits = places(F.col("k"))
    rows = keys.select(at.alias("_filter_at"), F.explode(F.array(*bits)).alias("bit")).repartition("_filter_at")
    made = F.broadcast(rows.groupBy("_filter_at").agg(F.bitmap_construct_agg("bit").alias("_filter_bits")))
    at, bits = places(key)
    held = at == F.col("_filter_at")
    for b in bits:
        byte = F.conv(F.hex(F.substring(F.col("_filter_bits"), F.shiftright(b, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        held &= F.getbit(byte, b.bitwiseAND(F.lit(7)).cast("int")) == 1
    held &= key.isNotNull()
    return df.join(made, held, "left_semi"), df.join(made, held, "left_anti")


def by_runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames sorted by ``keys``, cut anew so that no run of equal keys is split."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        at = int(np.argmax((frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()))
        if at:
            yield frame.iloc[:at]
        rest = frame.iloc[at:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Whether each row differs in ``keys`` from the row before."""
    k = frame[keys].to_numpy(np.int64)
    return np.r_[True, (k[1:] != k[:-1]).any(1)]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable, for every id in ``edges(a, b)`` but those smallest ones themselves.

    Alternates large-star and small-star contraction, so the number of rounds grows with the logarithm of the longest
    chain. Each step is a min-aggregate (combined before the shuffle) and an equi-join; nothing is collected but one
    checksum per round. Each step has as many tasks as its links need, as they grow no more from round to round. Null ends and self-links
    are ignored.
    """
    now = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(now)
    while before[0]:
        now, links = fitted(now, before[0]), before[0]
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = fitted(fitted(large, links).distinct(), links)
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(root, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(fitted(fitted(kept.union(root.select("u", F.col("m").alias("v"))), links).distinct(), links))
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _within(rows: pd.DataFrame, decode: Callable, verify: Callable) -> pd.DataFrame:
    """All pairs inside each run of equal (tbl, key, lo, hi), by growing distance; per row its links and its local group."""
    k = rows[["tbl", "key", "lo", "hi"]].to_numpy(np.int64)
    start = np.r_[True, (k[1:] != k[:-1]).any(1)]
    first = np.flatnonzero(start)
    size = np.diff(np.r_[first, len(k)])
    left = np.repeat(first + size, size) - np.arange(len(k))  # rows of the run from this one on
    ids, weight, mine = (rows[c].to_numpy(np.int64) for c in ("id", "weight", "mine"))
    across = k[:, 2] != k[:, 3]
    tbl, live, found, d = k[:, 0], np.flatnonzero(left > 1), [], 1
    data = decode(rows["payload"]) if len(live) else None
    while len(live):
        i, j = live, live + d
        ok = ~across[i] | (mine[i] != mine[j])
        i, j = i[ok], j[ok]
        ok = verify(data, tbl[i], i, j)
        found.append((i[ok], j[ok]))
        d += 1
        live = live[left[live] > d]
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
    links, leader = np.zeros(len(k), np.int64), ids.copy()
    np.add.at(links, i, weight[j])
    np.add.at(links, j, weight[i])
    while len(i):
        m = np.minimum(leader[i], leader[j])
        if (leader[i] == m).all() and (leader[j] == m).all():
            break
        np.minimum.at(leader, i, m)
        np.minimum.at(leader, j, m)
    has = links > 0
    return pd.DataFrame({"id": ids[has], "links": links[has], "leader": leader[has]})


def bucket_links(rows: DataFrame, decode: Callable, verify: Callable, block: int = 512) -> DataFrame:
    """(id, links, leader) of ``rows(id, weight, tbl, key, payload)``: verified links between rows that share (tbl, key).

    ``verify(data, tbl, i, j)`` judges pairs of row numbers of ``data = decode(payloads)``. ``links`` adds the partners'
    weights; ``leader`` is the smallest id of the row's connected group inside its bucket, so a clique leaves one row
    for each member and not one for each pair. A bucket of more than ``block`` rows is cut into parts by a hash of the
    id, and every pair of parts is a task's group of its own: no group exceeds two parts, and no pair is lost.
    """
    hot = checkpointed(rows.groupBy("tbl", "key").agg(F.count("*").alias("n")).where(F.col("n") > block))
    n = hot.count()
    if n:
        rows = rows.join(small(hot, n), ["tbl", "key"], "left")
        parts = F.coalesce(F.ceil(F.col("n") / F.lit(block // 2)), F.lit(1)).cast("int")
        rows = rows.withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        rows = rows.select("id", "weight", "tbl", "key", "payload", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    else:
        rows = rows.select("id", "weight", "tbl", "key", "payload", *(F.lit(0).alias(c) for c in ("mine", "lo", "hi")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = frame.iloc[-1]
            same = ((frame[["tbl", "key", "lo", "hi"]] == last[["tbl", "key", "lo", "hi"]]).all(axis=1)).to_numpy()
            at = int(np.argmax(same))
            if at:
                yield _within(frame.iloc[:at], decode, verify)
            rest = frame.iloc[at:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield _within(rest, decode, verify)

    dealt = rows.repartition("tbl", "key", "lo", "hi").sortWithinPartitions("tbl", "key", "lo", "hi", "id")
    return dealt.mapInPandas(run, "id long, links long, leader long")


def good_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>): rows whose vector has neither nulls nor NaN nor infinities and isn't all zero."""
    v = F.col(vec_col).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & usable)


def usual_length(vectors: DataFrame) -> int:
    """The commonest vector length, the larger of equals; 0 without vectors."""
    first = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def matrix(column: pd.Series) -> np.ndarray:
    return np.array([*column], dtype=np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaling by the largest component first keeps squares of huge or tiny values in range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def second_moments(vectors: DataFrame, dim: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and covariance of the unit vectors over all rows. Tasks add up dim x dim cells; the driver gets those."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim + 1, dim + 1))
        for frame in frames:
            x = unit(matrix(frame["v"]))
            x = np.c_[np.ones(len(x)), x]
            total += x.T @ x
        at = np.argwhere(np.triu(np.ones_like(total), 0))
        yield pd.DataFrame({"i": at[:, 0], "j": at[:, 1], "s": total[at[:, 0], at[:, 1]]})

    m = np.zeros((dim + 1, dim + 1))
    for r in vectors.select("v").mapInPandas(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    n = max(m[0, 0], 1.0)
    mean = m[0, 1:] / n
    return m[0, 0], mean, m[1:, 1:] / n - np.outer(mean, mean)
