"""What stages of the pipeline leave behind in Python workers that go on to other stages, and how many checkpoint files near copies write."""

import glob
import random

import pandas as pd
from public_tokenizers import path

from skein.llm import shingle_sets, suffix_pieces


def test_workers_keep_no_words_after_their_texts(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(f"w{rng.getrandbits(40):x}" for _ in range(200))) for k in range(160)]
    done = suffix_pieces.encode_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), path("piece_bpe_32k.model"))
    assert done.where("round_trip").count() == len(rows)

    def known(frames):
        for _ in frames:
            yield pd.DataFrame({"words": [sum(len(p.cache) + len(p.old) for p in suffix_pieces._LOADED.values())], "models": [len(suffix_pieces._LOADED)]})

    left = spark.range(0, 64, 1, 64).mapInPandas(known, "words long, models long").collect()
    assert any(r["models"] for r in left)  # some of these workers did encode
    assert max(r["words"] for r in left) == 0


def test_few_rows_are_few_checkpoint_files(spark):
    """300 texts dealt over 64 partitions that nothing coalesces: tables of known size don't write 64 files each."""
    rng = random.Random(4)
    own = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(60)) for _ in range(150)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(own)] + [(500 + k, f"{t} more") for k, t in enumerate(own)], "doc_id long, text string").coalesce(1)
    shingle_sets.checkpointed(df.limit(1))  # sets the folder
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    files = set(glob.glob(f"{folder}/rdd-*/part-*"))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        kept = shingle_sets.one_of_each(df, fingerprints=True).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r["doc_id"] for r in kept) == list(range(150))
    made = len(set(glob.glob(f"{folder}/rdd-*/part-*")) - files)
    assert made < 320, made  # 458 before
