"""Near copies of the pipeline by the classes of operator 3."""

from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import shingle_sets


def test_classes_of_operator_3_are_candidates(spark, data, monkeypatch):
    """Without any key of the bands, near copies still meet by their fingerprints; the exact decision stays."""
    base = [f"w{k}" for k in range(3000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["other"])), (3, " ".join(f"v{k}" for k in range(3000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(shingle_sets, "candidates", lambda nodes: nodes.select("node", F.array("node").alias("firsts")).limit(0))
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, data).collect()} == {1, 3}
