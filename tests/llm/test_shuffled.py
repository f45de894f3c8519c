"""What the pipeline's first two stages write for their shuffles, and the filter that keeps texts out of them."""

import random
from contextlib import contextmanager

from pyspark.sql import functions as F

from skein.llm import common, shingle_sets, toxicity


def _stages(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {x.stageId(): (x.shuffleWriteBytes(), x.numTasks()) for x in (found.apply(k) for k in range(found.size()))}


@contextmanager
def shuffled(spark, into):
    """Puts the bytes shuffled inside and the tasks that wrote them into ``into``."""
    before = max(_stages(spark), default=-1)
    yield
    mine = [x for k, x in _stages(spark).items() if k > before]
    into += [sum(b for b, _ in mine), sum(n for b, n in mine if b)]


def texts(rng, n, words=3000):
    return [" ".join(f"{rng.getrandbits(48):x}" for _ in range(words)) for _ in range(n)]


def test_texts_of_lone_documents_are_not_shuffled_for_near_copies(spark):
    """Of 60 texts of 36 KB three have a near copy, one has a copy, one is a repeated row: only those are shuffled."""
    own = texts(random.Random(3), 60)
    rows = [(k, t) for k, t in enumerate(own)] + [(100 + k, own[k] + f" more{k}") for k in range(3)] + [(200, own[9]), (5, own[5])]
    df = common.checkpointed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    did = []
    with shuffled(spark, did):
        kept = shingle_sets.one_of_each(df, fingerprints=True).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(60))
    assert did[0] < 0.5 * sum(len(t) for _, t in rows), did


def test_clean_texts_are_not_shuffled_for_toxic_ones(spark, data, monkeypatch):
    """More toxic texts than are broadcast: still no clean text is shuffled."""
    docs, labels = common.table(spark, data, "documents"), common.table(spark, data, "labels")
    calls = toxicity.score_toxicity(docs, labels).where("predicted = 1").select("doc_id")
    want = {r["doc_id"] for r in docs.join(calls, "doc_id", "left_anti").select("doc_id").collect()}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    joined, taken = [], []
    scored = common.checkpointed(toxicity.score_toxicity(docs, labels, carry={"a": F.xxhash64(F.coalesce("text", F.lit(""))), "b": F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))}).where("predicted = 1"))
    monkeypatch.setattr(toxicity, "score_toxicity", lambda *_, **__: scored)
    with shuffled(spark, joined):
        assert {r["doc_id"] for r in toxicity.clean_rows(docs, labels).collect()} == want
    with shuffled(spark, taken):
        docs.repartition(8, "text").write.format("noop").mode("overwrite").save()
    assert 0 < joined[0] < 0.4 * taken[0], (joined, taken)


def test_small_components_take_few_tasks(spark):
    """A chain of 600 links under 60 shuffle partitions."""
    edges = common.checkpointed(spark.range(600).selectExpr("id as a", "id + 1 as b"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    did = []
    try:
        for k, v in zip(held, ("60", "false")):
            spark.conf.set(k, v)
        with shuffled(spark, did):
            group = common.components(edges)
            assert {r["component"] for r in group.collect()} == {0} and group.count() == 600
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert did[1] < 800, did


def test_sifted_loses_no_key_and_takes_few_others(spark, monkeypatch):
    df = spark.range(200_000).select("id", F.when(F.col("id") % 1000 != 7, F.concat(F.lit("k"), "id")).alias("key"))
    keys = df.where("id % 10 = 0").select("key").union(spark.sql("select cast(null as string)"))
    near, rest = common.sifted(df, F.col("key"), keys)
    assert near.count() + rest.count() == 200_000 and near.where("id % 10 = 0").count() == 20_000
    assert near.count() < 20_000 + 0.02 * 180_000 and near.where("key is null").count() == 0
    assert [x.count() for x in common.sifted(df, F.col("key"), keys.limit(0))] == [0, 200_000]
    monkeypatch.setattr(common, "FILTER_BITS", common.ROW_BITS)  # far too few bits: more rows are taken for ones, none is lost
    near, rest = common.sifted(df, F.col("key"), keys)
    assert near.where("id % 10 = 0").count() == 20_000 and near.count() + rest.count() == 200_000
