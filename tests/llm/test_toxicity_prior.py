"""The label model on its own: what it reads, what it recovers, and what its posterior finds without gold labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import common, toxicity


def test_prior_does_not_depend_on_the_bound_of_the_sample(spark, data, monkeypatch):
    docs, labels = common.table(spark, data, "documents"), common.table(spark, data, "labels")
    y = [r[0] for r in labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("toxic").collect()]
    share, model, seen = (sum(y) + 1) / (len(y) + 2), toxicity.label_model, []
    assert share < 0.3
    monkeypatch.setattr(toxicity, "label_model", lambda *a: seen.append(model(*a)) or seen[-1])
    for sample in (toxicity.SAMPLE, sum(y)):  # the second has as many clean rows as toxic ones
        toxicity.score_toxicity(docs, labels, sample=sample)
    assert [m[0] for m in seen] == [pytest.approx(np.log(share / (1 - share)))] * 2


def test_accuracies_and_a_correlation_are_recovered_without_labels(spark):
    """Ten voters of known accuracy, one of them twice, and one that says nothing about the class."""
    rng = np.random.default_rng(3)
    n, share = 60_000, 0.12
    y = rng.random(n) < share
    a, b = np.linspace(0.25, 0.5, 10), np.linspace(0.002, 0.02, 10)
    x = rng.random((n, 10)) < np.where(y[:, None], a, b)
    x = np.c_[x, x[:, 4], rng.random(n) < 0.05]
    rows = spark.createDataFrame([(np.flatnonzero(v).tolist(),) for v in x], "speak array<int>").groupBy("speak").agg(F.count("*").alias("n"))
    prior, accuracy, weight, shared = toxicity.label_model(rows, share, np.r_[np.ones(11), 0])
    true = np.array([y[x[:, k]].mean() for k in range(12)])
    assert np.abs(accuracy - true)[:11].max() < 0.08 and accuracy[11] < 0.4
    assert shared[4, 10] > 0.9 and shared[10, 4] > 0.9 and np.delete(np.delete(shared, [4, 10], 0), [4, 10], 1).max() < 0.3
    q = toxicity.posterior(x.astype(float), prior, weight, shared)
    both, one = np.zeros((1, 12)), np.zeros((1, 12))
    both[0, [4, 10]], one[0, 4] = 1, 1
    assert toxicity.posterior(both, prior, weight, shared)[0] == pytest.approx(toxicity.posterior(one, prior, weight, shared)[0], abs=0.05)
    spoken = x[:, :11].any(1)
    assert (q[y & spoken] >= 0.5).mean() > 0.9 and (q[~y] >= 0.5).mean() < 0.1


def test_votes_alone_find_most_toxic_rows(spark, monkeypatch):
    """Without any gold term the posterior calls most toxic training rows toxic, and hardly a clean one; so do the scores
    on rows whose labels were held out. On sf0.1, as sf0.01 has six toxic rows held out and 45 to learn from."""
    folder = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    kept, voters, model = {}, toxicity.tuned_voters, toxicity.label_model
    monkeypatch.setattr(toxicity, "tuned_voters", lambda *a: kept.setdefault("voters", voters(*a)))
    monkeypatch.setattr(toxicity, "label_model", lambda *a: kept.setdefault("model", model(*a)))
    y = dict(toxicity.training_labels(labels, "doc_id").collect())
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    lexicon, m = [e for e, *_ in kept["voters"]], len(kept["voters"]) + len(toxicity.PATTERNS)
    votes = toxicity.find_votes(docs, lexicon, "doc_id", "text").withColumn("speak", toxicity.speaking(kept["voters"])).select("id", "speak").toPandas()
    prior, _, weight, shared = kept["model"]
    q = dict(zip(votes["id"], toxicity.posterior(toxicity.votes_matrix(votes["speak"], m), prior, weight, shared)))
    calls = {c: np.mean([q[i] >= 0.5 for i in y if y[i] == c]) for c in (0, 1)}
    assert calls[1] > 0.8 and calls[0] < 0.02, calls
    held = {i: t for i, t in labels.select("doc_id", "toxic").collect() if scored[i]["held_out"]}
    toxic, other = ([scored[i]["score"] for i, t in held.items() if t == c] for c in (1, 0))
    assert np.mean([s >= 0.5 for s in toxic]) > 0.85 and np.mean([s >= 0.5 for s in other]) < 0.02
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in other]) > 0.95


def test_repeated_ids_and_copies_stay_linear(spark, data):
    """An id that stands 300 times, with equal and with other texts, is scored 300 times and no more is collected."""
    docs, labels = common.table(spark, data, "documents").select("doc_id", "text"), common.table(spark, data, "labels")
    one = labels.where("toxic = 1").orderBy("doc_id").select("doc_id").first()[0]
    text = docs.where(F.col("doc_id") == one).first()["text"]
    more = spark.range(300).select(F.lit(one).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(text)).otherwise(F.concat(F.lit(text), F.col("id").cast("string"))).alias("text"))
    all_ = docs.unionByName(more)
    assert toxicity.one_of_copies(toxicity.training_sample(all_, labels, "doc_id", "text", 8000)).count() <= labels.count() + 2
    got = toxicity.score_toxicity(all_, labels).where(F.col("doc_id") == one).groupBy("n_voters").count().collect()
    assert sum(r["count"] for r in got) == 301


def test_a_very_long_text_is_read_to_its_end(spark, data):
    labels = common.table(spark, data, "labels")
    word = "clean words only " * 60_000
    long = spark.createDataFrame([(10**9, word + "idiot scum trash moron clown"), (10**9 + 1, word)], "doc_id long, text string")
    got = {r[0]: r[4] for r in toxicity.score_toxicity(common.table(spark, data, "documents").select("doc_id", "text").unionByName(long), labels).where(F.col("doc_id") >= 10**9).collect()}
    assert got[10**9] >= 4 and got[10**9 + 1] == 0
