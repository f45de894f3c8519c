"""Token counts by overlap resynchronisation.

A byte-level BPE tokenizer first cuts the text into pre-tokens with a memoryless left-to-right pattern, then merges
inside each of them. So two scans that have a pre-token start at the same place agree from there on, and the tokens
before and after such a place add up. Two kinds of proven places are used:

* a space between two characters that aren't white space always starts a pre-token, whatever stands around it; ordinary
  texts are summed over such segments, each distinct segment encoded once per worker;
* huge documents are cut into overlapping chunks, which Spark spreads over tasks. Each chunk is encoded with offsets, and
  neighbours are spliced at the first pre-token start that both scans have in the overlap. Where they have none, the
  document is done again with an overlap that doubles until they do (or reaches the end of the text).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches

#: No added token is longer than this; a start so far from a chunk's end has all its context inside the chunk.
MARGIN = 64
_SPACE = re.compile(r"(?<=\S) ")
_LOADED: dict[str, object] = {}
_COUNTS: dict[str, dict[str, int]] = {}
_CACHE = 250_000


def tokenizer(path: str):
    """The tokenizer of a .json file, one per worker, on one thread. Longer added tokens than MARGIN are refused."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        if any(len(t.content) >= MARGIN for t in made.get_added_tokens_decoder().values()):
            raise ValueError("an added token is longer than MARGIN")
        _LOADED[path] = made
    return _LOADED[path]


def segment_counts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, summed over its segments."""
    cache, encode = _COUNTS.setdefault(path, {}), tokenizer(path).encode_batch_fast
    if len(cache) > _CACHE:
        cache.clear()
    cut = []
    for text in texts:
        parts = _SPACE.split(text)
        cut.append([parts[0], *(" " + p for p in parts[1:])])
    missing = list({p for parts in cut for p in parts} - cache.keys())
    for i in range(0, len(missing), 4096):
        cache.update(zip(missing[i : i + 4096], map(len, encode(missing[i : i + 4096], add_special_tokens=False))))
    return [sum(map(cache.__getitem__, parts)) for parts in cut]


def starts(text: str, path: str) -> tuple[dict[int, int], int]:
    """Where the pre-tokens of a chunk start, with the number of tokens before each; the number of all tokens."""
    enc = tokenizer(path).encode(text, add_special_tokens=False)
    at, before = {}, None
    for n, (word, (begin, _)) in enumerate(zip(enc.word_ids, enc.offsets)):
        if word != before:
            at.setdefault(begin, n)
            before = word
    return at, len(enc.ids)


def spliced_count(text: str, path: str, chunk: int, overlap: int) -> int:
    """Tokens of a text by chunks from left to right; a splice without a common start doubles its overlap."""
    total, begin = 0, 0
    wide = overlap
    while True:
        end = begin + chunk + wide
        at, n = starts(text[begin:end], path)
        if end >= len(text):
            return total + n
        heads, _ = starts(text[begin + chunk : begin + chunk + 2 * wide], path)
        common = next((p for p in sorted(heads) if p + chunk in at and p + chunk <= chunk + wide - MARGIN), None)
        if common is None:
            wide *= 2
            continue
        total, begin, wide = total + at[common + chunk], begin + chunk + common, overlap


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, huge: int = 65_536, chunk: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``, other columns left aside.

    Null and empty texts have 0 bytes and tokens; a null id stays null; repeated rows are each counted and kept; an empty
    table gives an empty one. Texts of more than ``huge`` characters go through overlapping chunks.
    """
    if overlap <= 2 * MARGIN or chunk <= overlap:
        raise ValueError("chunk > overlap > 2 * MARGIN is needed")
    small_batches(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long"

    def usual(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 128):
                part = frame.iloc[i : i + 128]
                yield pd.DataFrame({"id": part["id"], "n_bytes": part["n_bytes"], "n_tokens": segment_counts(list(part["text"]), path)})

    length = F.length("text")
    counted = rows.where(length <= huge).withColumn("n_bytes", F.octet_length("text").cast("long")).mapInPandas(usual, out)

    long = rows.where(length > huge).withColumn("rid", F.concat_ws(":", F.col("id").cast("string"), F.sha2("text", 256))).withColumn("n_bytes", F.octet_length("text").cast("long"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rid, text in zip(frame["rid"], frame["text"]):
                last = max(0, (len(text) - overlap - 1) // chunk)
                for i in range(last + 1):
                    yield pd.DataFrame({"rid": [rid], "i": [i], "last": [i == last], "part": [text[i * chunk : (i + 1) * chunk + overlap if i < last else None]]})

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rid, i, last, part in zip(frame["rid"], frame["i"], frame["last"], frame["part"]):
                at, n = starts(part, path)
                head = [p for p in at if p <= overlap] if i else []
                tail = [] if last else [p for p in at if chunk <= p <= len(part) - MARGIN]
                yield pd.DataFrame({"rid": [rid], "i": [i], "last": [last], "n": [n], "head": [[p + i * chunk for p in head]], "head_n": [[at[p] for p in head]], "tail": [[p + i * chunk for p in tail]], "tail_n": [[at[p] for p in tail]]})

    pieces = long.select("rid", "text").mapInPandas(cut, "rid string, i long, last boolean, part string").repartition("rid", "i")
    pieces = pieces.mapInPandas(encode, "rid string, i long, last boolean, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>").dropDuplicates(["rid", "i"])
    pieces = checkpointed(pieces)
    right = pieces.select("rid", (F.col("i") - 1).alias("i"), "head", "head_n")
    seam = pieces.where(~F.col("last")).select("rid", "i", "tail", "tail_n").join(right, ["rid", "i"]).withColumn("p", F.array_min(F.array_intersect("tail", "head")))
    here = lambda at, n: F.expr(f"element_at({n}, cast(array_position({at}, p) as int))")
    seam = seam.select("rid", F.col("p").isNull().alias("failed"), F.when(F.col("p").isNotNull(), here("tail", "tail_n") - here("head", "head_n")).alias("n"))
    ends = pieces.where("last").select("rid", F.lit(False).alias("failed"), "n")
    sums = checkpointed(seam.union(ends).groupBy("rid").agg(F.max("failed").alias("failed"), F.sum("n").alias("n_tokens")))
    long_rows = long.select("id", "rid", "n_bytes").join(sums.where("not failed"), "rid").select("id", "n_bytes", "n_tokens")
    failed = sums.where("failed")
    result = counted.unionByName(long_rows)
    if not failed.isEmpty():

        def widen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({"id": frame["id"], "n_bytes": frame["n_bytes"], "n_tokens": [spliced_count(t, path, chunk, 2 * overlap) for t in frame["text"]]})

        result = result.unionByName(long.join(failed.select("rid"), "rid", "left_semi").select("id", "n_bytes", "text").mapInPandas(widen, out))
    return result.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
