"""Literal cases of the gates, the normaliser, carriers and the cascade."""

import pytest
from pyspark.sql import functions as F

from skein.functions import gates as G
from skein.functions import normalize as N
from skein.operators import addresses, augment, cascade, fields

DISCUSSIONS = [
    "SELECT と JOIN の違いは何ですか？ UNION はどう使いますか？",
    "SELECT와 JOIN의 차이점은 무엇인가요? UNION은 어떻게 사용하나요?",
    "¿Cuál es la diferencia entre SELECT y JOIN? ¿Cómo se usa UNION?",
    "Quelle est la différence entre SELECT et JOIN ? Comment utiliser UNION ?",
    "Was ist der Unterschied zwischen SELECT und JOIN? Wie nutzt man UNION?",
    "В чем разница между SELECT и JOIN? Как использовать UNION?",
    "ما الفرق بين SELECT و JOIN؟ كيف يتم استخدام UNION؟",
    "Qual é a diferença entre SELECT e JOIN? Como usar UNION?",
]


def verdicts(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, value string, location string")
    return [(r["verdict"], r["layer"]) for r in cascade.detect_fields(df).orderBy("i").collect()]


def test_discussions_are_benign_and_hide_nothing(spark):
    rows = [("content", text, "body") for text in DISCUSSIONS]
    rows += [("value", "SELECT 和 JOIN 的区别是什么？ <script src='x'></script>", "query"), ("value", "SELECT 和 JOIN 的区别是什么？; DROP TABLE users", "query"), ("content", None, "body"), ("content", "", "body")]
    got = verdicts(spark, rows)
    assert got[:8] == [("benign", "L0-Context")] * 8
    assert [v for v, _ in got[8:10]] == ["attack"] * 2
    assert [v for v, _ in got[10:]] == ["uncertain"] * 2


def test_encoded_and_documented(spark):
    rows = [("x", "JTBkJTBh", "query"), ("x", "%p%p%p%p", "query"), ("note", "example: &lt;script&gt;alert&lt;/script&gt;", "body"), ("v", "select a, b from t where id = ?", "body")]
    assert verdicts(spark, rows) == [("attack", "L1-Raw"), ("attack", "L1-Raw"), ("benign", "L0-Context"), ("benign", "L0-Context")]


def test_scores_decide_last(spark):
    df = spark.createDataFrame([(0, "zz", "previously;unseen", "query", 0.7), (1, "zz", "previously;unseen", "header", 0.7), (2, "zz", "previously;unseen", "query", 0.01), (3, "zz", "previously;unseen", "query", None)], "i int, name string, value string, location string, s double")
    got = cascade.detect_fields(df, F.col("s")).orderBy("i").select("verdict", F.round("confidence", 2)).collect()
    assert [tuple(r) for r in got] == [("attack", 0.7), ("benign", 0.7), ("benign", 0.99), ("uncertain", 0.5)]


def test_normaliser(spark):
    cases = {"%2541%20b": "A b", "MSB1bmlvbiBzZWxlY3QgMg==": "1 union select 2", "c2VsZWN0IDEgZnJvbSB4": "c2VsZWN0IDEgZnJvbSB4", "&lt;b&gt;&eacute;&#x41;&#66;&bogus;": "<b>éAB&bogus;", "UN/**/ION": "UNION", "'a'+'b'": "'ab'", "ｆｕｌｌ": "full", "plain": "plain", "": "", None: None}
    df = spark.createDataFrame([(v,) for v in cases], "value string")
    assert {r["value"]: r["restored"] for r in N.normalize_fields(df, location=None).collect()} == cases


def test_clients_and_carriers(spark):
    rows = [("127.0.0.1", "198.51.100.9, 203.0.113.8, 10.1.2.3"), ("192.0.2.10", "203.0.113.8"), ("127.0.0.1", "junk"), ("127.0.0.1", None), ("127.0.0.1", "10.0.0.1, 10.0.0.2"), ("127.0.0.1", "junk, 203.0.113.8")]
    df = spark.createDataFrame(rows, "peer string, f string")
    got = [r[0] for r in df.select(addresses.effective_client(F.col("peer"), F.col("f"), ["127.0.0.0/8", "10.0.0.0/8"])).collect()]
    assert got == ["203.0.113.8", "192.0.2.10", "127.0.0.1", "127.0.0.1", "10.0.0.1", "203.0.113.8"]
    raw = "POST / HTTP/1.1\r\nContent-Length: 3\r\nTransfer-Encoding: chunked\r\n\r\nabc"
    flags = spark.createDataFrame([(raw,), (raw + "Content-Length: 4",), ("GET / HTTP/1.1\r\nContent-Length: -1\r\n\r\n",)], "v string").select(fields.framing_flags(F.col("v"))).collect()
    assert [r[0] for r in flags] == [["CL_TE_ambiguity"], ["CL_TE_ambiguity", "duplicate_content_length"], ["invalid_content_length"]]


def test_multipart_request(spark):
    raw = 'POST /u HTTP/1.1\r\nHost: h\r\nContent-Type: multipart/form-data; boundary=B\r\n\r\n--B\r\nContent-Disposition: form-data; name="site_name"\r\n\r\nx y\r\n--B\r\nContent-Disposition: form-data; name="logo"; filename="a.png"\r\nContent-Type: image/png\r\n\r\n<script>\r\n--B--\r\n'
    got = fields.explode_requests(spark.createDataFrame([(1, raw)], "id int, raw string"), "id", "raw").where("location = 'body'")
    assert [(r["name"], r["value"]) for r in got.collect()] == [("site_name", "x y"), ("logo.filename", "a.png")]


def test_allow_list():
    assert G.allow_list("/a:query:Q, /b:BODY:x,/a:query:q") == [("/a", "query", "q"), ("/b", "body", "x")]
    for bad in ("a:query:x", "/a:path:x", "/a?b:query:x", "/a:query:", "/a"):
        with pytest.raises(ValueError):
            G.allow_list(bad)


def test_variants_are_reproducible(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None), (3, "")], "id int, text string")
    one, two = (augment.augment(x, "id", "text").orderBy("original_id", "strategy").collect() for x in (df, df.repartition(5)))
    assert one == two and {r["original_id"] for r in one} == {1, 3}
