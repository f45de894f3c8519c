"""Repetition measures against counted windows, maximal repeats against all substrings."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import common, repetition

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "covered_chars", "longest_repeat")


def inside(words, k):
    windows = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    times, mask = Counter(windows), [False] * len(words)
    for i, w in enumerate(windows):
        if times[w] > 1:
            mask[i : i + k] = [True] * k
    return mask


def brute(text):
    text = text or ""
    words = text.encode().split()
    longest = 0
    while len({tuple(words[i : i + longest + 1]) for i in range(len(words) - longest)}) < len(words) - longest:
        longest += 1
    lines, over = [x for x in text.split("\n") if x.encode().split()], inside(words, 5)
    size = [len(w.decode()) for w in words]
    return (len(words), sum(size), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), sum(inside(words, 8)), sum(over), sum(s for s, o in zip(size, over) if o), longest)


def maximal(text, least=5):
    words, found = (text or "").split(), set()
    for k in range(least, len(words)):
        at = defaultdict(list)
        for i in range(len(words) - k + 1):
            at[tuple(words[i : i + k])].append(i)
        for places in at.values():
            before, after = ({None if not 0 <= p + d < len(words) else words[p + d] for p in places} for d in (-1, k))
            if len(places) > 1 and len(before) > 1 and len(after) > 1:
                found.add((places[0], k, len(places)))
    return found


def drawn():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a " * 40, "x y " * 30, "# line\n# line\n \n<b>&amp; 5%\n# line ", "a\x85b c\xa0d e", "ü中 \U0001f600 " * 9]
    for _ in range(150):
        words = [f"w{i}é" for i in range(rng.choice([2, 3, 5, 20]))]
        texts.append("".join(rng.choice(words) + rng.choice("  \n") for _ in range(rng.randrange(120))))
    return texts


def test_measures_and_maximal_repeats():
    texts = drawn()
    found = repetition.measured(texts, repeats=True)
    for text, got in zip(texts, found.to_dict("records")):
        assert tuple(got[c] for c in NAMES) == brute(text), text
        assert {(r["start"], r["words"], r["times"]) for r in got["repeats"]} == maximal(text), text
        mask = [False] * got["n_words"]
        for s in got["spans"]:
            mask[s["start"] : s["end"]] = [True] * (s["end"] - s["start"])
        assert mask == inside((text or "").encode().split(), 5)


@pytest.mark.parametrize("text, words", [("again " * 300_000, 299_999), (" ".join(f"w{k % 100_000}" for k in range(200_000)), 100_000)])
def test_very_long_texts(text, words):
    found = repetition.measured([text, "short one"])
    assert found["longest_repeat"].to_list() == [words, 0] and found["n_repeat_words"][0] == found["n_words"][0]


def test_table(spark, data):
    odd = [(i, t, 1, "clash") for i, t in enumerate(drawn())] + [(None, "no id", 2, ""), (3, "a", 1, "clash"), (3, "a", 1, "clash")]
    tables = (spark.createDataFrame(odd, "doc_id long, text string, n_words int, kept string").repartition(3), common.table(spark, data, "documents"))
    for df in tables:
        found = [tuple(r) for r in repetition.judge_repetition(df).collect()]
        want = []
        for doc_id, text in (tuple(r) for r in df.select("doc_id", "text").collect()):
            m = brute(text)
            failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
            want.append((doc_id, *m, failed, not failed and m[6] <= 0.5 * m[1] and m[7] <= 60))
        assert sorted(map(str, found)) == sorted(map(str, want))
    assert repetition.judge_repetition(tables[0].where("false")).count() == 0


def test_verdict(spark):
    rng = random.Random(1)
    prose = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (400, 61, 60)]
    cases = [(0, prose[0], True), (1, f"{prose[1]} {prose[0]} {prose[1]}", False), (2, f"{prose[2]} {prose[0]} {prose[2]}", True), (3, " ".join(w for k in range(30) for w in [f"u{k}"] * 7), False), (4, "w " * 19, False)]
    found = repetition.judge_repetition(spark.createDataFrame(cases, "doc_id int, text string, want boolean"), repeats=True).collect()
    assert {r["doc_id"]: r["kept"] for r in found} == {i: w for i, _, w in cases}
    one = next(r for r in found if r["doc_id"] == 1)
    assert [tuple(x) for x in one["repeats"]] == [(0, 61, 2)] and [tuple(x) for x in one["spans"]] == [(0, 61), (461, 522)]
    assert not one["base_failed"] and one["longest_repeat"] == 61
    assert repetition.judge_repetition(spark.range(0).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))).count() == 0
