"""Registered queries against their DuckDB twins, and literal cases of the column functions."""

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from skein.functions import decode as D
from skein.functions import patterns as P
from skein.functions.rule_index import rule_hits
from skein.operators import cascade, fields, windows
from skein.plans import queries as plans

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_twin(spark, con, name):
    bad, _ = differences(con, plans.QUERIES[name](spark, SMALL), plans.ORACLE_SQL[name])
    assert bad is None, bad


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "v string").select(*columns).first())


@pytest.mark.parametrize("text, want", [("%E4%B8%AD%E6%96%87", "中文"), ("a+b%2", "a+b%2"), ("100%", "100%"), ("%zz%41", "%zzA"), ("", "")])
def test_percent_decode(spark, text, want):
    assert one(spark, text, D.percent_decode(F.col("v"))) == (want,)


def test_layers_and_gates(spark):
    v = F.col("v")
    assert one(spark, "%252541", *D.percent_decode_layers(v)) == ("A", 3)
    assert one(spark, "c2VsZWN0IDEgZnJvbSB4", D.base64_decode(v)) == ("select 1 from x",)
    assert one(spark, "plainwords", D.base64_decode(v)) == (None,)
    assert one(spark, "73656c656374", D.hex_decode(v)) == ("select",)
    assert one(spark, "a\\u0041\\u4e2dz", D.unicode_unescape(v)) == ("aA中z",)
    assert one(spark, "/a\\b//c/./d/../e/....//x", D.fold_path(v))[0].startswith("/a/b/c/e/")
    assert one(spark, "UN/**/ION /*!50000SELECT*/", *D.sql_comments(v)) == ("UNION SELECT", 2)


@pytest.mark.parametrize("value, verdict", [("1 UNION ALL SELECT 2", "attack"), ("sleep(.5)", "attack"), ("previously unseen syntax", "uncertain"), ("<script>x", "uncertain"), ("<script src='a'>", "attack"), ("aaaaaaaaaaaa.bbb.", "attack"), ("${jndi:x}", "attack"), ("; cat /etc/passwd", "attack"), ("%12$n", "attack"), ("100% of it", "uncertain")])
def test_rules(spark, value, verdict):
    assert one(spark, value, P.verdict_of(rule_hits(F.col("v")))) == (verdict,)


def test_field_verdicts(spark):
    rows = [("redirect", "//evil.example", "query", "attack", "L1-Context"), ("page", "2", "query", "benign", "L0"), ("x", "%2527%20OR%201=1", "query", "attack", "L1"), ("x", "%253Cscript src='a'%253E", "query", "attack", "L1"), ("x", "drop table t", "query", "attack", "L1-Raw"), ("file", "a/../b", "query", "attack", "L1-Context")]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, name string, value string, location string")
    got = {r["i"]: (r["verdict"], r["layer"]) for r in cascade.detect_fields(df).collect()}
    assert got == {i: r[3:] for i, r in enumerate(rows)}


def test_requests_to_fields(spark):
    raw = "post /a/b?x=1&y=&x=2 HTTP/1.1\r\nHost: h\r\nCookie: s=1; bare\r\nX-Note: n: m\r\nSec-Fetch-Mode: cors\r\n\r\nu=a+b&v=%41"
    df = spark.createDataFrame([(1, raw)], "id int, raw string")
    got = [tuple(r) for r in fields.explode_requests(df, "id", "raw").select("name", "value", "location").collect()]
    assert got == [("path", "/a/b", "path"), ("path_seg_0", "a", "path"), ("path_seg_1", "b", "path"), ("x", "1", "query"), ("y", "", "query"), ("x", "2", "query"), ("u", "a b", "body"), ("v", "A", "body"), ("X-Note", "n: m", "header"), ("s", "1", "cookie"), ("bare", "", "cookie")]


def test_scanner_timeline(spark):
    probes = [(0, "/.env"), (5, "/x"), (8, "/.git/config"), (40, "/.env")]
    df = spark.createDataFrame([(k, "c", s, p) for k, (s, p) in enumerate(probes)], "seq int, client string, s int, path string").withColumn("ts", F.timestamp_seconds("s"))
    framed = windows.trailing(df, "client", "ts", "seq", 15, F.col("path"))
    n = F.size(F.filter("frame", lambda p: P.has(p, P.KNOWN_PROBES)))
    score = windows.scanner_score(F.size("frame"), F.size(F.array_distinct("frame")), n, F.lit(0), F.lit(False))
    assert [r[0] for r in framed.orderBy("seq").select(score).collect()] == [1, 1, 4, 1]
