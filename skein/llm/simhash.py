"""SimHash near-duplicates: fingerprints in pigeonhole blocks, joined on blocks, verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_links, checkpointed, components, fitted, small_batches

#: Shingles hashed at a time, so that very long texts need bounded memory.
STEP = 65_536
#: Odd multipliers that turn one 64-bit hash into further words of a wider fingerprint.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, shingle: int = 3, words: int = 1) -> bytes:
    """The fingerprint's 64-bit words, big-endian. A bit is set if it is in over half of the shingles' hashes.

    The first word takes XXH64 (seed 42) as it is; the k-th further word takes a finaliser of the hash plus k steps.
    No words give zero; fewer words than ``shingle`` make one shingle.
    """
    w = (text or "").encode().lower().split()
    if not w:
        return bytes(8 * words)
    n = max(1, len(w) - shingle + 1)
    ones, hashed = np.zeros(64 * words, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, STEP):
        part = w[i : min(i + STEP, n) + shingle - 1]
        cut = zip(*(part[k:] for k in range(shingle))) if len(part) >= shingle else [part]
        ones += bit_counts(np.array([hashed(b" ".join(s), 42) for s in cut], dtype=np.uint64), words)
    return np.packbits(2 * ones > n).tobytes()


def bit_counts(hashes: np.ndarray, words: int) -> np.ndarray:
    """How many hashes have each bit of a fingerprint of ``words`` 64-bit words."""
    ones = np.zeros(64 * words, np.int64)
    for j in range(0, len(hashes), 1024):  # small enough for the processor's caches
        for k in range(words):
            x = hashes[j : j + 1024]
            if k:
                with np.errstate(over="ignore"):
                    x = x + np.uint64(k) * _MIX
                    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    x = x ^ (x >> np.uint64(31))
            ones[64 * k : 64 * k + 64] += np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return ones


def block_keys(prints: np.ndarray, blocks: int, together: int) -> np.ndarray:
    """Keys of uint8 rows: for every choice of ``together`` of the ``blocks`` equal parts, their bits as one long."""
    n, width = len(prints), prints.shape[1] * 8 // blocks
    bits = np.unpackbits(prints, axis=1).reshape(n, blocks, width).astype(np.int64)
    value = bits @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))
    keys = np.zeros((n, 0), np.int64)
    for chosen in combinations(range(blocks), together):
        key = np.zeros(n, np.int64)
        for c in chosen:
            key = (key << width) | value[:, c]
        keys = np.c_[keys, key]
    return keys


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1, distance: int = 2, blocks: int = 4, together: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``: fingerprint in lower-case hex, component_id the
    smallest id reachable over fingerprints that differ in at most ``distance`` bits.

    By default four blocks of 16 bits, of which any pair within two bits shares two: the join is on 32 bits of six
    choices and loses nothing. ``words`` > 1 takes wider fingerprints for larger distances, where a shared block is
    likely and not certain. Equal fingerprints are one row in the search, so copies never meet each other; hot blocks
    are cut into parts (``bucket_links``). Null and empty texts have fingerprint zero and link like any other; rows
    with a null id have no component unless a row with an id shares their fingerprint; rows with the same id count as
    one node; an empty table gives an empty one.
    """

    small_batches(docs)
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "fp": [fingerprint(t, shingle, words) for t in frame["text"]]})

    prints = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, fp binary")
    prints = checkpointed(prints)
    classes = checkpointed(fitted(prints.groupBy("fp").agg(F.min("id").alias("class")), prints.count()))

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = block_keys(decode(frame["fp"]), blocks, together)
            yield pd.DataFrame({"id": frame["class"], "payload": frame["fp"], "keys": [*found]})

    def decode(column: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 8 * words)

    def near(data: np.ndarray, tbl: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        w = data.view(np.uint64).reshape(len(data), -1)
        ok = np.zeros(len(i), bool)
        for at in range(0, len(i), 65_536):
            s = slice(at, at + 65_536)
            ok[s] = np.bitwise_count(w[i[s]] ^ w[j[s]]).sum(1) <= distance
        return ok

    rows = classes.where("class is not null").mapInPandas(keys, "id long, payload binary, keys array<long>")
    rows = rows.select("id", F.lit(1).cast("long").alias("weight"), "payload", F.posexplode("keys").alias("tbl", "key"))
    links = bucket_links(rows, decode, near).select(F.col("id").alias("a"), F.col("leader").alias("b"))
    group = components(links)
    named = classes.join(group, classes["class"] == group["node"], "left").select(F.col("fp").alias("of"), F.coalesce("component", "class").alias("component_id"))
    return prints.join(named, F.col("fp") == F.col("of")).select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")

