"""Documents to training data: toxic documents go, near-duplicates go, sources are mixed, texts become pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and read
again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common, mixing, shingle_sets, suffix_pieces, toxicity

#: Near-duplicates: sets of five-word shingles with a Jaccard similarity of 0.8 at least.
NEAR = {"shingle": 5, "similar": 0.8, "fingerprints": True}
#: Bytes of text of a shard at least; the mix takes a text three times at most.
SHARD = 1 << 26


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose own text the classifier of operator 4 doesn't call toxic.

    Each row is judged by its text: a row without an id can go, and a clean row stays though another of its id goes. Null and empty texts
    stay, equal rows go or stay together, an empty table stays empty.
    """
    return toxicity.clean_rows(docs, common.table(spark, sf_dir, "labels")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates, each link verified on the shingle sets.

    Candidates are the classes of operator 3, by SimHash in pigeonhole blocks, and the pairs that bands of MinHashes find beside them.

    Rows without an id are judged like others and stand behind those with one; texts without words are one group; rows that are equal in
    all columns are one; an empty table stays empty.
    """
    return shingle_sets.one_of_each(docs, **NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus of operator 5: each document as often as the mix takes it, in shuffled shards of some 64 MB of text.

    Documents without words aren't taken, a null source is a source, an empty table stays empty.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return mixing.mix(docs, shards=max(32, 3 * size // SHARD))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of operator 7 for each copy in the mix: doc_id, ids, their number, and whether they decode to the text.

    Null and empty texts have no pieces; equal rows are encoded each.
    """
    return suffix_pieces.encode_texts(docs, path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("sentencepiece", encode_pieces)]
#: Hashes, learned weights and tokenizer models aren't expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the folder of spark.checkpoint.dir and read again."""
    docs = common.table(spark, sf_dir, "documents")
    common.checkpointed(spark.range(0))  # sets a folder of its own where none is set
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
