"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables, reranked on the original vectors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_links, checkpointed, components, good_vectors, matrix, second_moments, unit, usual_length

#: Vectors that the rotation is learned on, at most.
SAMPLE = 20_000
BYTES, TOGETHER = 8, 2


def learn_rotation(x: np.ndarray, basis: np.ndarray, rounds: int = 50, seed: int = 6) -> np.ndarray:
    """Iterative quantisation: turns the projected sample so that its signs lose least; dim x bits."""
    bits = basis.shape[1]
    v = x @ basis
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, wt = np.linalg.svd(b.T @ v)
        r = (u @ wt).T
    return basis @ r


def fit_codes(classes: DataFrame, dim: int, sample: int = SAMPLE, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(mean, dim x 64 projection). Mean and principal axes come from all rows, the rotation from at most ``sample`` rows,
    the first in the order of a hash. With fewer than 64 dimensions, random directions make up the rest."""
    bits = 8 * BYTES
    _, mean, cov = second_moments(classes, dim)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :bits]
    rng = np.random.default_rng(seed)
    if axes.shape[1] < bits:
        axes = np.c_[axes, rng.normal(size=(dim, bits - axes.shape[1])) / np.sqrt(dim)]
    rows = classes.select("v").orderBy(F.xxhash64("id")).limit(sample).toPandas()
    return mean, learn_rotation(unit(matrix(rows["v"])) - mean, axes, seed=seed)


def links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``, over pairs with a cosine of at least ``cosine``.

    Equal vectors are one class, counted and not paired. Each class has a 64-bit code; the tables are the 28 pairs of
    its 8 bytes, so a pair is found if its codes agree in two bytes, wherever they are, and judged by the cosine in
    double precision in the first table that holds it. Rows whose vector is null, all zero, or holds nulls, NaN or
    infinities link with nothing; of vectors of another than the commonest length only equal ones link. Rows with the
    same id count as one node; a null id has no component; an empty table gives an empty one.
    """
    rows = good_vectors(vectors, id_col, vec_col)
    dim = usual_length(rows)
    classes = checkpointed(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    usable = classes.where((F.size("v") == dim) & F.col("id").isNotNull())
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    if dim:
        mean, projection = fit_codes(usable, dim, sample)
        pairs = [*combinations(range(BYTES), TOGETHER)]

        def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x = unit(matrix(frame["v"]))
                code = np.packbits((x - mean) @ projection >= 0, axis=1)
                keys = [[int(c[a]) << 8 | int(c[b]) for a, b in pairs] for c in code]
                yield pd.DataFrame({"id": frame["id"], "weight": frame["weight"], "payload": [c.tobytes() + r.tobytes() for c, r in zip(code, x)], "keys": keys})

        def decode(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
            raw = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
            return raw[:, :BYTES], np.ascontiguousarray(raw[:, BYTES:]).view(np.float64)

        first = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])

        def near(data, tbl: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            code, x = data
            ok = np.zeros(len(i), bool)
            for at in range(0, len(i), 16_384):
                s = slice(at, at + 16_384)
                p, q, t = i[s], j[s], tbl[s]
                equal = code[p] == code[q]
                before = (equal & (np.arange(BYTES) < first[1][t][:, None])).sum(1)  # this table's first byte alone
                here = np.flatnonzero(before == 1)
                dots = (x[p[here]] * x[q[here]]).sum(1)
                ok[np.arange(len(i))[s][here]] = dots >= cosine
            return ok

        coded = checkpointed(usable.mapInPandas(encode, "id long, weight long, payload binary, keys array<long>"))
        found = checkpointed(bucket_links(coded.select("id", "weight", "payload", F.posexplode("keys").alias("tbl", "key")), decode, near))
        degree = found.groupBy("id").agg(F.sum("links").alias("links"))
        group = components(found.select(F.col("id").alias("a"), F.col("leader").alias("b")))
        named = classes.join(degree, "id", "left").join(group, classes["id"] == group["node"], "left")
    else:
        named = classes.withColumn("links", F.lit(0)).withColumn("component", F.lit(None).cast("long"))
    named = named.select(F.col("v").alias("of"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    done = every.join(named, F.col("v") == F.col("of"), "left")
    component = F.coalesce("c", "id")
    return done.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
