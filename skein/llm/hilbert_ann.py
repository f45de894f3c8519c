"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected to a few dimensions, one projection and one shift for each curve, and ordered along a Hilbert
curve. Spark range-partitions every ordering; a row's rank is its partition's offset plus its place there. A query
looks at a window of ranks on both sides: the window's blocks meet the query in groups of bounded size, each gives its
nearest by exact distance, and the curves' answers merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, good_vectors, matrix, usual_length

DIMS, BITS = 8, 7
#: Curves, and the share of all ranks that a query's window spans on each curve. Vectors that fill all their dimensions
#: evenly need wide windows for a recall of 0.9 (measured in the README); clustered ones much narrower.
CURVES, SHARE = 4, 0.5
BLOCK, QUERIES = 2048, 1000
#: Entries of the vectors whose exact distances are taken at once; equal vectors can make many.
PIECE = 1 << 21


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (n x dims), by transposing to Gray code; dims x bits <= 62."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def projections(dim: int, curves: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(curves x dim x DIMS) orthonormal where possible, and (curves x DIMS) shifts in cells."""
    rng = np.random.default_rng(seed)
    made = []
    for _ in range(curves):
        q = np.linalg.qr(rng.normal(size=(dim, max(dim, DIMS))))[0] if dim >= DIMS else rng.normal(size=(dim, DIMS))
        made.append(q[:, :DIMS])
    return np.array(made), rng.uniform(0, 1, size=(curves, DIMS))


def nearest(base: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest base rows of each query by exact distance, ties to the smaller id, the query's own id left out; none where a side has no rows."""
    if not len(base) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    b, ids, out = matrix(base["v"]), base["id"].to_numpy(), []
    norm, pairs = (b * b).sum(1), max(1, PIECE // b.shape[1])
    for at in range(0, len(queries), 256):
        part = queries.iloc[at : at + 256]
        q, own = matrix(part["v"]), part["id"].to_numpy()
        rough = norm - 2 * q @ b.T  # without the query's own norm; only to choose what is worth an exact distance
        rough[own[:, None] == ids[None, :]] = np.inf
        top = min(k, rough.shape[1]) - 1
        limit = np.partition(rough, top, axis=1)[:, top] + 1e-9 * (1 + np.abs(norm).max())
        r, c = np.nonzero((rough <= limit[:, None]) & np.isfinite(rough))
        d = np.concatenate([np.sqrt(((b[c[i : i + pairs]] - q[r[i : i + pairs]]) ** 2).sum(1)) for i in range(0, max(1, len(r)), pairs)])
        o = np.lexsort((ids[c], d, r))
        r, c, d = r[o], c[o], d[o]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k  # by the place in the query's own run
        out.append(pd.DataFrame({"query_id": own[r[first]], "vec_id": ids[c[first]], "score": d[first]}))
    return pd.concat(out, ignore_index=True)


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES, share: float = SHARE, block: int = BLOCK, queries: int = QUERIES, seed: int = 9) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where ``is_query``, their k nearest other rows found.

    Nearness is the Euclidean distance in double precision, ties go to the smaller id. Null, zero or non-finite vectors,
    those of another than the commonest length, and rows without an id take no part. Equal vectors are all candidates;
    repeated rows of one id are one. Fewer candidates than k give them all; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = good_vectors(vectors, id_col, vec_col).where("id is not null").dropDuplicates(["id"])
    dim = usual_length(rows)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = vectors.where(is_query).select(F.col(id_col).cast("long").alias("id")).distinct().withColumn("q", F.lit(True))
    rows = checkpointed(rows.where(F.size("v") == dim).join(asked, "id", "left").select("id", "v", F.coalesce("q", F.lit(False)).alias("q")))
    stats = rows.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).collect()
    mean, scale = np.zeros(dim), 1e-300
    for r in stats:
        mean[r["pos"]], scale = r["m"], max(scale, r["s"])
    maps, shifts = projections(dim, curves, seed)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = 1 << BITS
        for frame in frames:
            x = (matrix(frame["v"]) - mean) / scale
            for c in range(curves):
                cells = np.clip(np.floor((x @ maps[c] + 4) * (top / 8) + shifts[c]), 0, top - 1)
                yield pd.DataFrame({"curve": c, "key": hilbert(cells), "id": frame["id"], "q": frame["q"]})

    keys = rows.mapInPandas(place, "curve int, key long, id long, q boolean").repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    keys = checkpointed(keys.withColumn("at", F.monotonically_increasing_id()))  # partition << 33 | place
    part = F.shiftright("at", 33)
    sizes = keys.groupBy(part.alias("p"), "curve").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("p", "curve").collect()
    starts, seen = [], {}
    for r in sizes:  # a row per partition and curve in it
        starts.append((r["p"], r["curve"], seen.get(r["curve"], 0) - r["first"]))
        seen[r["curve"]] = seen.get(r["curve"], 0) + r["n"]
    n = max(seen.values())
    offsets = F.broadcast(spark.createDataFrame(starts, "p long, curve int, start long"))
    ranked = keys.withColumn("p", part).join(offsets, ["p", "curve"]).select("curve", "id", "q", (F.col("at") + F.col("start")).alias("rank"))
    ranked = ranked.join(rows.select("id", "v"), "id")

    wide, step = int(np.ceil(share * n / 2)), queries * 100  # on each side; ranks that share a group of queries
    last = (n - 1) // block
    clip = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit((n - 1) // step))
    bounded = lambda x: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(last))
    b = F.floor(F.col("rank") / block)
    base = ranked.withColumn("block", b).select("curve", "id", "v", "block", F.explode(F.sequence(clip(F.floor((b * block - wide) / step)), clip(F.floor(((b + 1) * block + wide) / step)))).alias("chunk"))
    asked = ranked.where("q").select("curve", "id", "v", F.floor(F.col("rank") / step).alias("chunk"), F.explode(F.sequence(bounded((F.col("rank") - wide) / block), bounded((F.col("rank") + wide) / block))).alias("block")).toDF("q_curve", "id", "v", "q_chunk", "q_block")
    found = base.groupBy("curve", "block", "chunk").cogroup(asked.groupBy("q_curve", "q_block", "q_chunk")).applyInPandas(lambda x, y: nearest(x, y, k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
