"""The Merkle manifest against a plain recursion over sorted rows."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from skein.llm import common, merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int, tree string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """The root, and the siblings of every leaf with their side."""
    paths, index = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, k in enumerate(index):
            if (k ^ 1) < len(nodes):
                paths[leaf].append((k % 2, nodes[k ^ 1]))
            else:
                paths[leaf].append((0, ""))
        nodes, index = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)], [k // 2 for k in index]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaf = lambda r, more=0: h(*map(framed, (r[0], r[1], r[2], r[3] if r[3] is None else r[3] + more, r[4])))
    made = {}
    for g in names:
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[g] = (ordered, *climb([leaf(r) for r in ordered]))
    root, upper = climb([made[g][1] for g in names])
    out = []
    for g, up in zip(names, upper):
        for r, path in zip(made[g][0], made[g][2]):
            path = path + up
            x = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for left, s in path:
                x = h(s, x) if left else h(x, s)
            out.append((r[0], leaf(r), made[g][1], root, h(*(s for _, s in path)), x, x == root))
    return out


def audit(df, **options):
    altered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    found = merkle.audited(df, altered, {"n_chars": F.col("n_chars") + 1}, **options)
    return [tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


@pytest.mark.parametrize("bits", [None, 0, 2])
@pytest.mark.parametrize("n", [1, 2, 9, 70])
def test_against_recursion(spark, n, bits):
    odd = [(None, "s", "en", 1, "no id"), (None, None, None, None, None), (3, "a", "en", 3, "Zwölf"), (3, "a", "en", 3, "Zwölf"), (3, "b", "en", 3, ""), (4, "", "", 0, ""), (5, "x", "Äö", -1, "y" * 5000)]
    rows = ([(k * 3, "s", ("en", "fr", None, "en", "en")[k % 5], None if k % 11 == 0 else k, f"text {k}") for k in range(n)] + odd)[: n if n < 5 else None]
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(3)
    key = lambda r: tuple(map(str, r))
    assert sorted(audit(df, bits=bits), key=key) == sorted(brute(rows), key=key)


def test_equal_rows_and_empty_table(spark):
    rows = [(1, "s", "en", 1, "same")] * 37 + [(2, "s", "de", 1, "same")]
    df = spark.createDataFrame([(*r, "", 1, "") for r in rows], SCHEMA)
    assert sorted(map(str, audit(df, bits=1))) == sorted(map(str, brute(rows)))
    assert audit(df.where("false")) == []


def test_query_verifies_all_but_the_tampered(spark, data):
    docs = common.table(spark, data, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = audit(docs, bits=4)
    assert sorted(map(str, found)) == sorted(map(str, brute(rows)))
    tampered = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert {r[0] for r in found if not r[6]} == tampered and tampered
