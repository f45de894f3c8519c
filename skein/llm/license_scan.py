"""Licence scans with DataFrame functions only: a positional index of rare words.

Document frequencies of the templates' words over all documents give each template its anchors, the words of highest
IDF. A file's postings are the places of its words that anchor a template; each posting looks up the templates with that
anchor and gives a relative position (place minus the anchor's offset). Positions that both anchors of a template agree
on are candidates, and the template's mandatory key phrase must stand there word by word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (label, words, mandatory key phrase within them); the first three are the base phrases, found wherever they stand.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
MORE = [
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("artistic", "artistic license 2 0", "artistic license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "bsd 3 clause license", "bsd 3 clause"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial", "attribution noncommercial"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0"),
    ("epl", "eclipse public license v 2 0", "eclipse public license"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "the mit license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
]
#: A template counts from this share of its words at their places, its key phrase being whole.
LEAST = 0.6


def templates() -> list[dict]:
    made = [{"label": n, "words": p.split(), "key": p.split(), "base": True} for n, p in BASE]
    made += [{"label": n, "words": w.split(), "key": k.split(), "base": False} for n, w, k in MORE]
    for t in made:
        t["at"] = next(i for i in range(len(t["words"])) if t["words"][i : i + len(t["key"])] == t["key"])
    return made


def words_of(text: Column) -> Column:
    """Lower-cased words, from 0; null and empty texts have none."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP)
    return F.filter(parts, lambda w: w != "")


def frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and how many have each word of the fixed vocabulary, over all documents."""
    known = F.array_intersect(words_of(F.col(text_col)), F.array(*map(F.lit, vocabulary)))
    seen = docs.select(F.explode(F.concat(F.array(F.lit("")), known)).alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in seen}
    return df.pop("", 0), df


def anchors(template: dict, idf: dict[str, float]) -> list[tuple[str, int]]:
    """The two words of highest IDF inside the key phrase and their offsets (one, if it has only one word)."""
    at = range(template["at"], template["at"] + len(template["key"]))
    best = sorted(at, key=lambda i: (-idf[template["words"][i]], i))
    return [(template["words"][i], i) for i in best[:2]]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) for every row of ``docs``.

    ``places`` are the matches array<struct<label, base, start, share>>; ``score`` is the best share of a template's
    words that stand at their places (1 for a base phrase), 0 without a match. Labels are distinct, sorted and joined by
    commas, empty without a match. Null and empty texts have no words; null ids and repeated rows stay; an empty table
    gives an empty one. Other columns of ``docs`` are left aside, whatever their names.
    """
    all_ = templates()
    vocabulary = sorted({w for t in all_ for w in t["words"]})
    n, df = frequencies(docs, text_col, vocabulary)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in vocabulary}
    index: dict[str, list[tuple[int, int]]] = {}
    second = []
    for k, t in enumerate(all_):
        (word, offset), *rest = anchors(t, idf)
        index.setdefault(word, []).append((k, offset))
        second.append(rest[0] if rest else (word, offset))
    texts = lambda rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
    lookup = F.create_map(*(x for w, found in sorted(index.items()) for x in (F.lit(w), F.array(*(F.struct(F.lit(k).alias("k"), F.lit(o).alias("o")) for k, o in found)))))
    col = lambda name, values: F.array(*map(F.lit, values)).alias(name)

    read = docs.select(F.col(id_col), words_of(F.col(text_col)).alias("w"))
    rare = sorted(index)
    posts = F.filter(F.transform("w", lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("i")))), lambda p: p.isNotNull())
    read = read.select(id_col, "w", F.size("w").cast("long").alias("n_words"), posts.alias("posts"))
    met = F.flatten(F.transform("posts", lambda p: F.transform(F.element_at(lookup, p["w"]), lambda t: F.struct(t["k"].alias("k"), (p["i"] - t["o"]).alias("rel")))))
    words = F.col("w")
    get = lambda a, i: F.get(a, i)
    agree = lambda c: get(words, c["rel"] + get(col("o2", [o for _, o in second]), c["k"])) == get(col("w2", [w for w, _ in second]), c["k"])
    key_at, keys = col("at", [t["at"] for t in all_]), texts([t["key"] for t in all_])
    begins = lambda c: c["rel"] + get(key_at, c["k"])
    phrase = lambda c: (begins(c) >= 0) & (F.slice(words, F.greatest(begins(c), F.lit(0)) + 1, F.size(get(keys, c["k"]))) == get(keys, c["k"]))
    whole = texts([t["words"] for t in all_])

    def share(c: Column) -> Column:
        t = get(whole, c["k"])
        same = F.filter(F.transform(t, lambda w, i: F.when(c["rel"] + i >= 0, get(words, c["rel"] + i)) == w), lambda x: x)
        return F.size(same) / F.size(t)

    found = F.filter(met, lambda c: agree(c) & phrase(c))
    places = F.transform(found, lambda c: F.struct(get(col("l", [t["label"] for t in all_]), c["k"]).alias("label"), (c["k"] < len(BASE)).alias("base"), begins(c).cast("long").alias("start"), share(c).alias("share")))
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,share:double>>")
    read = read.withColumn("places", F.when(F.size("posts") > 0, F.filter(places, lambda p: p["base"] | (p["share"] >= least))).otherwise(none))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: p["label"]))), ",")
    return read.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels("places").alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"), "places",
    )
