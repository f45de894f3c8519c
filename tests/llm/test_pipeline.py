"""The stages of the pipeline one by one, on odd rows and on the given table."""

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import common, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, toxic, clean):
    rows = [(1, toxic), (1, clean), (None, toxic), (None, clean), (2, None), (3, ""), (4, clean), (4, clean), (5, "word " * 200_000), (6, " \n ")]
    return spark.createDataFrame([(i, t, None, "s" if i else None, 1) for i, t in rows], SCHEMA).withColumn("score", F.lit("clash")).repartition(3)


@pytest.fixture(scope="module")
def texts(spark, data):
    docs, labels = common.table(spark, data, "documents"), common.table(spark, data, "labels")
    found = toxicity.score_toxicity(docs, labels).where("predicted = 1").orderBy(F.desc("score")).first()["doc_id"]
    return docs.where(F.col("doc_id") == found).first()["text"], "a clean text of its own with nothing in it"


def test_toxic_rows_go_by_their_text(spark, data, texts):
    docs = common.table(spark, data, "documents")
    rows = odd(spark, *texts)
    got = corpus_pipeline.drop_toxic(spark, docs.withColumn("score", F.lit("clash")).unionByName(rows), data).collect()
    assert not [r for r in got if r["text"] == texts[0]]
    kept = [(r["doc_id"], r["text"]) for r in got if r["lang"] is None]
    want = [(r["doc_id"], r["text"]) for r in rows.collect() if r["text"] != texts[0]]
    assert sorted(map(str, kept)) == sorted(map(str, want))
    scored = toxicity.score_toxicity(docs, common.table(spark, data, "labels"))
    assert {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, data).collect()} == {r["doc_id"] for r in scored.where("predicted = 0").collect()}
    assert corpus_pipeline.drop_toxic(spark, docs.limit(0), data).count() == 0


def test_one_id_with_many_texts_collects_no_more(spark, data):
    """40,000 texts under one training id: the sample that reaches the driver stays within its bound."""
    docs, labels = common.table(spark, data, "documents").select("doc_id", "text"), common.table(spark, data, "labels")
    one = toxicity.training_labels(labels, "doc_id").where("y = 1").first()["doc_id"]
    many = spark.range(40_000).select(F.lit(one).alias("doc_id"), F.concat(F.lit("distinctive"), F.col("id").cast("string"), F.lit(" wording")).alias("text"))
    sample = toxicity.training_sample(docs.unionByName(many), labels, "doc_id", "text", 8000)
    assert sample.count() == sample.select("doc_id").distinct().count() <= 2 * 8000
    assert toxicity.one_of_copies(sample).count() <= sample.count()


@pytest.mark.parametrize("rows", ["id", "0", "if(id % 3 = 0, 5, id)"])
def test_first_by_hash(spark, rows):
    df = spark.range(3000).selectExpr(f"{rows} as id", "id as tie")
    want = [tuple(r) for r in df.orderBy(F.xxhash64("id"), "tie").limit(100).collect()]
    assert [tuple(r) for r in toxicity.first_by_hash(df, "id", ["tie"], 100).collect()] == want
    assert toxicity.first_by_hash(df, "id", ["tie"], 10**6).count() == 3000 and toxicity.first_by_hash(df.limit(0), "id", ["tie"], 5).count() == 0


def test_mixing_and_pieces(spark, data):
    import sentencepiece

    docs = common.table(spark, data, "documents").limit(200).unionByName(odd(spark, "some words", "other words here").drop("score"))
    mixed = corpus_pipeline.mix_sources(spark, docs, data)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert {r["doc_id"] for r in rows if r["source"] is None} and all((r["text"] or "").split() for r in rows)
    assert sorted(map(str, corpus_pipeline.mix_sources(spark, docs.repartition(5), data).collect())) == sorted(map(str, rows))
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), data).count() == 0
    model = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    done = corpus_pipeline.encode_pieces(spark, docs, data)
    want = sorted(str((r["doc_id"], model.encode(r["text"] or ""))) for r in docs.collect())
    assert sorted(str((r["doc_id"], list(r["ids"]))) for r in done.collect()) == want
    assert corpus_pipeline.encode_pieces(spark, docs.limit(0), data).count() == 0


def test_run_applies_the_stages_in_order(spark, data):
    docs, labels = common.table(spark, data, "documents"), common.table(spark, data, "labels")
    got = corpus_pipeline.run(spark, data)
    staged = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        staged = stage(spark, staged, data)
        assert staged.columns == docs.columns
    ids = np.unique([r["doc_id"] for r in staged.select("doc_id").collect()])
    assert set(ids) == {r["doc_id"] for r in got.select("doc_id").distinct().collect()} and got.count() == staged.count()
    toxic = toxicity.score_toxicity(docs, labels).where("predicted = 1").select("doc_id")
    assert got.join(toxic, "doc_id").count() == 0 and toxic.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "mixing", "sentencepiece"] and corpus_pipeline.ORACLE_SQL is None
