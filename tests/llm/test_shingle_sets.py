"""The pipeline's near-duplicate stage against brute force over shingle sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import shingle_sets


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def planted(seed=1):
    """Texts of 100 to 400 words, each with variants of which a run of words at the end is new: similarities of 0.6 to 0.97."""
    rng = random.Random(seed)
    texts = []
    for g in range(150):
        n = rng.randrange(100, 400)
        words = [f"g{g}w{i}" for i in range(n)]
        texts.append(" ".join(words))
        for v, s in enumerate((0.6, 0.7, 0.75, 0.78, 0.79, 0.8, 0.81, 0.85, 0.9, 0.97)[g % 5 :: 5]):
            new = round((n - 4) * (1 - s) / (1 + s))
            texts.append(" ".join(words[: n - new] + [f"g{g}v{v}n{i}" for i in range(new)]))
    line = "the same short line comes again and again in this text "
    texts += [line * 40 + " ".join(f"x{t}y{i}" for i in range(30)) for t in range(4)]  # same line, different sets
    return texts


def brute_force(texts):
    sets, kept = [shingles(t) for t in texts], []
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or a and b and len(a & b) / len(a | b) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if find(i) == i}


def test_near_duplicates_against_brute_force(spark, data, monkeypatch):
    texts = planted() + ["", None, "", "one two three", "One  two\tthree"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(5)
    want = brute_force(texts)
    assert 0.2 * len(texts) < len(want) < 0.8 * len(texts)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, data).collect()} == want
    monkeypatch.setattr(shingle_sets, "PART", 1)  # each bucket dealt over tasks
    got = corpus_pipeline.drop_near_duplicates(spark, df, data)
    assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} == want
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), data).count() == 0


def test_near_duplicates_of_the_given_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id")
    rows = docs.select("doc_id", "text").collect()
    want = {rows[i][0] for i in brute_force([r[1] for r in rows])}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, data).collect()} == want


@pytest.mark.parametrize("words", [8, 9, 20, 60, 250])
def test_keys_reach_every_band_of_similarity_and_length(words):
    """Of pairs in each band from the similarity itself upwards, nearly all share a key, short texts as well as long ones."""
    sets, band = [], []
    for g in range(800):
        for s in (0.8, 0.82, 0.85, 0.9):
            n = words - 4
            new = int((n * (1 - s) / (1 + s)) + 1e-9)
            base = [f"g{g}w{i}" for i in range(words)]
            pair = [shingle_sets.shingle_set(" ".join(w), 5) for w in (base, base[: words - new] + [f"g{g}s{s}n{i}" for i in range(new)])]
            assert len(np.intersect1d(*pair)) / len(np.union1d(*pair)) >= 0.8
            sets += pair
            band.append(s)
    keys = shingle_sets.band_keys(sets)
    shared = (keys[::2] == keys[1::2]).any(1)
    recall = {s: shared[np.array(band) == s].mean() for s in set(band)}
    assert min(recall.values()) > 0.99, recall


def test_very_short_sets_at_the_similarity():
    """Sets of 4 and 5 shingles that share 4: similarity 0.8."""
    sets = [shingle_sets.shingle_set(" ".join(f"g{g}w{i}" for i in range(n)), 5) for g in range(2000) for n in (8, 9)]
    keys = shingle_sets.band_keys(sets)
    assert (keys[::2] == keys[1::2]).any(1).mean() > 0.995


def test_keys_do_not_crowd():
    """Unlike sets share no key, and a set's keys don't depend on the batch."""
    sets = [shingle_sets.shingle_set(" ".join(f"d{d}w{i}" for i in range(60)), 5) for d in range(3000)]
    keys = shingle_sets.band_keys(sets)
    assert len(np.unique(keys)) == keys.size
    assert (shingle_sets.band_keys(sets[7:9]) == keys[7:9]).all() and shingle_sets.band_keys([]).shape == (0, shingle_sets.BANDS)


def test_row_key_reads_every_column(spark):
    df = spark.sql("select 1 as a, map('x', 1, 'y', 2) as m union all select 1, map('y', 2, 'x', 1) union all select 1, map('x', 1, 'y', 3) union all select null, null union all select 1, null")
    keys = [r[0] for r in df.select(shingle_sets.row_key(df)).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 4


def test_large_groups_and_hot_buckets(spark, monkeypatch):
    """Near copies by the hundred, chained and not, in buckets over the parts' size: the groups of the brute force."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(120):  # one or two words changed: a clique in effect
        w = base.copy()
        w[rng.randrange(200)] = f"c{i}"
        texts.append(" ".join(w))
    chain = [f"k{i}" for i in range(300)]
    texts += [" ".join(chain[4 * i : 4 * i + 120]) for i in range(40)]  # each like its neighbours only
    monkeypatch.setattr(shingle_sets, "PART", 16)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {r[0] for r in shingle_sets.one_of_each(df).select("doc_id").collect()} == brute_force(texts)


def test_each_row_is_judged_by_its_own_text(spark):
    """Copies keep the smallest id; rows that share an id but not a text all stay; repeated rows fold, with or without an id."""
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(5, long, "a"), (3, long, "b"), (9, "another text of its own", "c"), (9, "a second text under that id", "d"), (None, "x y z", "e"), (None, "x y z", "e"), (None, None, None), (7, "word " * 300_000, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("node", F.lit("clash")).withColumn("row", F.lit(1))
    got = [sorted(map(str, shingle_sets.one_of_each(d).collect())) for d in (df, df.repartition(7), df.orderBy("source"))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 6
    assert shingle_sets.one_of_each(df).columns == df.columns and shingle_sets.one_of_each(df.limit(0)).count() == 0
