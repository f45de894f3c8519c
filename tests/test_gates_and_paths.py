"""The gate for plainly benign values, path folding to its fixpoint, and word edges, each against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skein.functions import decode as D
from skein.functions import patterns as P
from skein.operators.cascade import obviously_benign

# name, value, location, whether the value is plainly benign
CASES = [
    ("id", "123", "query", True), ("id", "+7", "query", True), ("id", "-1.50", "query", True), ("log", "plain text", "query", False), ("message", "hello there", "body", False),
    ("return", "abc", "query", False), ("x", "a-b.c", "query", True), ("x", "你好", "query", True), ("x", "abcdefg", "query", False), ("x", "some plain words", "query", True),
    ("x", "a..b c", "query", False), ("x", "  true ", "query", True), ("x", "zh-CN", "header", True), ("User-Agent", "Mozilla/5.0 (X11; Linux x86_64)", "header", True),
    ("User-Agent", "Mozilla/5.0 <b>", "header", False), ("User-Agent", "Mozilla/5.0 (X11)", "query", False), ("x", "", "query", False), ("x", "w " * 200, "query", False), ("x", "1 or 1=1", "query", False), ("x", "été été", "query", True),
]


def test_plainly_benign_values(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, name string, value string, location string, want boolean")
    got = df.select("name", "value", "want", obviously_benign(F.col("name"), F.col("value"), F.col("location")).alias("got")).collect()
    assert [r for r in got if r["got"] != r["want"]] == []


def folded(s):
    s = re.sub("/{2,}", "/", s.replace("\\", "/"))
    for pattern, by in ((r"/\./", "/"), (r"/(?!\.\.(?:/|$))[^/]+/\.\./", "/"), (r"\.\.\.\./", "../")):
        before = None
        while before != s:
            before, s = s, re.sub(pattern, by, s)
    return re.sub(r"/\.$", "/", s)


def test_paths_fold_to_the_fixpoint(spark):
    rng = random.Random(5)
    paths = ["/a/.../b", "/a/..../b", "/x/....../y", "/x/...../y", "a/b/../../c", "/../../etc/passwd", "/a/./././././././././././b/.", "/" + "x/" * 40 + "../" * 40 + "etc", "..", "/..", "", "/", "c:\\w\\..\\x"]
    paths += ["".join(rng.choice(["/", "..", ".", "a", "bc", "\\", "/../", "/./", "....", "/x/"]) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", D.fold_path(F.col("p")).alias("f")).collect()
    assert [(r["p"], r["f"], folded(r["p"])) for r in got if r["f"] != folded(r["p"])][:5] == []


@pytest.mark.parametrize("pattern", [p for _, _, _, p in P.RULES if r"\b" in p] + [P.SHELL_WORDS, P.DB_FUNCTIONS, P.INTERNAL_IPS, P.SCANNER_AGENTS, P.ATTACK_TARGETS])
def test_shortened_word_edges_match_alike(spark, pattern):
    """A boundary with a word character surely on one side only looks at the other; it matches the same texts."""
    rng = random.Random(len(pattern))
    words = re.findall(r"[A-Za-z]{2,}|\d+", pattern) + [" ", "_", "é", "(", "=", "1", "'", "/", "10.0.0.1", ".", ";", "--"]
    texts = ["".join(rng.choice(words) + rng.choice(["", "", " ", "_", "x"]) for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    plain = F.rlike("t", F.lit("(?di)" + pattern.replace(r"\b", P._EDGE)))
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert df.where(plain != P.has(F.col("t"), pattern)).count() == 0


@pytest.mark.parametrize("text", ["你好，世界。欢迎来到这里看看", "Привет, мир! Как дела?", "plain ascii text <b>", "naïve café 😀😀"])
def test_encoded_text_of_any_script_is_restored(spark, text):
    import base64

    units = "".join(f"\\u{int.from_bytes(text.encode('utf-16-be')[i : i + 2], 'big'):04x}" for i in range(0, len(text.encode("utf-16-be")), 2))
    points = "".join(f"\\U{ord(c):08X}" for c in text)
    row = spark.createDataFrame([(base64.b64encode(text.encode()).decode(), text.encode().hex(), units, points)], "b string, h string, u string, p string")
    got = row.select(D.base64_decode(F.col("b")), D.hex_decode(F.col("h")), D.unicode_unescape(F.col("u")), D.unicode_unescape(F.col("p"))).first()
    assert [*got] == [text] * 4
