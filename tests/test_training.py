"""The vocabulary and its weights by hand, early stopping, metric bounds, and a search that can't see the test part."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.operators import curate, training


def grams(text):
    text = " ".join(text.lower().split()) if text.strip() == text else text.lower()
    return [text[i : i + n] for n in range(2, 6) for i in range(len(text) - n + 1)]


TEXTS = ["select a from b", "select c", "Hello hello", "", "hello"]


def test_vocabulary_and_weights(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    counts = training.gram_counts(df, "id", "text")
    held = [Counter(grams(t)) for t in TEXTS]
    total, documents = Counter(), Counter()
    for c in held:
        total.update(c)
        documents.update(c.keys())
    chosen = sorted((g for g in total if documents[g] >= 2), key=lambda g: (-total[g], g))[:12]
    words = training.vocabulary(counts, len(TEXTS), most=12).orderBy("at").collect()
    assert [r["gram"] for r in words] == chosen and [r["at"] for r in words] == list(range(12))
    assert all(abs(r["idf"] - math.log((1 + 5) / (1 + documents[r["gram"]])) - 1) < 1e-12 for r in words)
    got = {r["id"]: r["x"] for r in training.weighed_texts(counts, training.vocabulary(counts, len(TEXTS), most=12), 12, df).collect()}
    for k, c in enumerate(held):
        w = [(1 + math.log(c[g])) * (math.log(6 / (1 + documents[g])) + 1) if c[g] else 0.0 for g in chosen]
        norm = math.sqrt(sum(x * x for x in w)) or 1.0
        assert got[k].toArray().tolist() == pytest.approx([x / norm for x in w])


@pytest.fixture(scope="module")
def rows(spark):
    """Short values of customers, a third of them with an attack of one of three kinds behind; a training label in twelve is wrong."""
    c = spark.read.parquet("/root/testdata/sf0.01/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    kinds = F.array(*map(F.lit, ["sqli", "xss", "cmdi"]))
    kind = F.get(kinds, (k / 3).cast("int") % 3)
    attack = F.when(kind == "sqli", F.concat(F.lit("1 union select "), k.cast("string"))).when(kind == "xss", F.concat(F.lit("<svg onload=x"), k.cast("string"))).otherwise(F.concat(F.lit("; cat /tmp/"), k.cast("string")))
    text = F.when(k % 3 == 0, F.concat("c_mktsegment", F.lit(" "), attack)).otherwise(F.concat("c_name", F.lit(" "), "c_mktsegment"))
    split = curate.hash_split(k.cast("string"))
    label = F.when((k % 12 == 1) & (split == "train"), k % 3 != 0).otherwise(k % 3 == 0).cast("int")
    return c.select(k.alias("id"), text.alias("text"), label.alias("label"), split.alias("split"), F.when(label == 1, kind).otherwise("normal").alias("kind"), (k % 6 == 0).alias("hard"))


@pytest.fixture(scope="module")
def ready(rows):
    return training.prepare(rows, most=2000)


def test_all_features(ready):
    assert len(ready.names) == 38 and ready.words == 2000
    assert ready.parts["train"].select(*ready.names).where(" or ".join(f"{n} is null or isnan({n})" for n in ready.names)).count() == 0


def test_metrics_and_early_stop(rows, ready):
    found = training.train(rows, most=2000, least_recall=0.85, most_fpr=0.1)
    assert found.trees < 60  # the validation rows stopped the growth
    assert found.validation["recall"] >= 0.85 and found.validation["fpr"] <= 0.1 and found.test["f1"] > 0.8


def test_search_does_not_depend_on_the_test_part(ready, rows):
    options = {"names": ready.names, "policies": ["all", "log"], "modes": ["sqrt_ratio"], "rare": 20, "least_recall": 0.85, "most_fpr": 0.1}
    best, reached = training.search(ready.parts["train"], ready.parts["validation"], **options)
    turned = training.prepare(rows.withColumn("label", F.when(F.col("split") == "test", 1 - F.col("label")).otherwise(F.col("label"))), most=2000)
    again, same = training.search(turned.parts["train"], turned.parts["validation"], **options)
    assert (best.policy, best.mode, best.weight, best.threshold) == (again.policy, again.mode, again.weight, again.threshold) and reached == same
    assert [r["policy"] for r in reached] == ["all", "log"] and best.judged(ready.parts["test"])["f1"] > 0.75


def test_what_may_train(spark):
    cases = [("field", True, "x", False, True), ("request", True, "x", False, False), ("field", False, "x", False, False), ("field", True, "", False, False), ("field", True, "x" * 8193, False, False), ("field", True, "x", True, False), (None, True, "x", None, False), ("field", None, "x", None, False), ("field", True, "x", None, True)]
    df = spark.createDataFrame(cases, "level string, allowed boolean, payload string, duplicate boolean, want boolean")
    assert all(r[0] == r[1] for r in df.select(training.eligible(F.col("level"), F.col("allowed"), F.col("payload"), F.col("duplicate")), "want").collect())
    made = spark.createDataFrame([("", "p"), (None, "p"), ("o", "p"), (None, None)], "o string, p string").select(training.chosen_payload(F.col("o"), F.col("p")), training.model_text(F.col("p"), F.col("o"))).collect()
    assert [tuple(r) for r in made] == [("p", "p __normalized__ "), ("p", "p __normalized__ "), ("o", "p __normalized__ o"), ("", " __normalized__ ")]
