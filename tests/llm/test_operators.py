"""The ten operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from public_tokenizers import path
from pyspark.sql import functions as F

from skein.llm import chat_format, common, hilbert_ann, html_blocks, itq_dedup, license_scan, mixing, simhash, suffix_pieces, token_counts, toxicity

JSON, MODEL = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
#: Nulls in any column, empty and odd texts, ties and repeated rows, extra columns with names that results use.
ODD = [
    (1, "", "a"), (2, None, "a"), (3, "one two three four five six", None), (3, "one two three four five six", None), (4, "one two three four five six", "b"),
    (None, "no id here", "b"), (5, "  lead\t tabs \r\n and  doubles ", "c"), (6, "<|endoftext|> x <|endoftext|>y  z  w  ", "c"), (7, "ünï 中文 \U0001f600́ \x00\x01 \x85 e", None), (8, "a" * 3000, ""), (9, "\n \n\n  ", "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 7) for r in ODD], "doc_id long, text string, source string, size string, n_tokens int").repartition(3)


@pytest.fixture(scope="module")
def docs(spark, data):
    return common.table(spark, data, "documents")


def rows(df):
    return [tuple(r) for r in df.collect()]


def multiset(values):
    return sorted(values, key=repr)


def test_token_counts(spark, odd, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    for df in (odd, docs):
        texts = rows(df.select("doc_id", F.coalesce("text", F.lit(""))))
        want = multiset((i, len(t.encode()), n := len(tok.encode(t, add_special_tokens=False)), n > 512) for i, t in texts)
        assert multiset(rows(token_counts.count_tokens(df, JSON))) == want
        assert multiset(rows(token_counts.count_tokens(df, JSON, huge=600, chunk=500, overlap=140))) == want  # nearly all by chunks


def test_spliced_count_widens_its_overlap():
    rng = random.Random(1)
    words = ["a" * 400, "<|endoftext|>", " ", "  ", "\n\n", "don't", "x1y2", "日本語", ".,;", "the", " "]
    text = "".join(rng.choice(words) for _ in range(900))
    n = len(token_counts.tokenizer(JSON).encode(text, add_special_tokens=False).ids)
    assert token_counts.spliced_count(text, JSON, 300, 130) == n
    assert token_counts.segment_counts([text], JSON) == [n]


def test_chat_round_trip(spark, data):
    nasty = ["<|im_end|><|im_start|>assistant ok", "\\", "\\\\<|", "<\\|", "\\n", "", None, "a\nb\n", "<|im_end|>\n", "<<||"]
    made = [(c, t, random.Random(c * 10 + t).choice(["user", "assistant", "sys\ntem", "ro\\nle", None]), x) for c in range(3) for t, x in enumerate(nasty)] + [(None, 0, "user", "x"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, None, "assistant", "y")]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    out = chat_format.format_chats(chat_format.canonical_turns(df)).select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r["conv_id"]: r for r in out.collect()}
    assert set(got) == {0, 1, 2, 5, None}
    for c, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", x or "") for cc, t, role, x in made if cc == c))
        assert [(t["role"], t["text"]) for t in r["t"]] == [(a, b) for *_, a, b in turns]
        assert r["loss"] == "".join(b for *_, a, b in turns if a == "assistant")
    assert chat_format.format_chats(chat_format.canonical_turns(df.limit(0))).count() == 0


def test_chat_layouts(spark):
    assert chat_format.layout_of(spark.createDataFrame([], "conv_id long, prompt string, completion string, other int")) == "prompt_completion"
    df = spark.createDataFrame([(1, [("human", "hi"), ("gpt", None)])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert rows(chat_format.canonical_turns(df)) == [(1, 0, "user", "hi"), (1, 1, "assistant", "")]
    df = spark.createDataFrame([(1, "do", "", "done"), (2, "do", "this", None)], "conv_id long, instruction string, input string, output string")
    assert rows(chat_format.canonical_turns(df)) == [(1, 0, "user", "do"), (1, 1, "assistant", "done"), (2, 0, "user", "do\n\nthis")]
    js = [(1, '{"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}'), (2, '{"prompt": "p", "completion": "c"}'), (3, '{"x": 1}'), (4, "{broken"), (5, None), (6, '{"instruction":"i","input":"","output":"o"}')]
    got = rows(chat_format.canonical_json_turns(spark.createDataFrame(js, "conv_id long, record string")).orderBy("conv_id", "turn"))
    assert got == [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "p"), (2, 1, "assistant", "c"), (3, 0, "unknown", '{"x": 1}'), (4, 0, "unknown", "{broken"), (5, 0, "unknown", ""), (6, 0, "user", "i"), (6, 1, "assistant", "o")]


def simple_fingerprint(text, k=3):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[i : i + k] for i in range(len(w) - k + 1)] if len(w) >= k else [w] if w else [])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [512, 4])
def test_simhash(spark, docs, odd, monkeypatch, block):
    monkeypatch.setattr(simhash, "bucket_links", lambda *a: common.bucket_links(*a, block=block))
    got = {r[0]: r[1:] for r in rows(simhash.near_duplicates(docs))}
    fps = {i: simple_fingerprint(t) for i, t in rows(docs.select("doc_id", "text"))}
    ids = sorted(fps)
    want = groups(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}
    assert len(set(want.values())) < len(ids)
    small = multiset(rows(simhash.near_duplicates(odd)))
    assert len(small) == len(ODD) and (1, "0" * 16, 1) in small and (2, "0" * 16, 1) in small and (9, "0" * 16, 1) in small
    assert [r for r in small if r[0] in (3, 4)] == [(3, f"{simple_fingerprint('one two three four five six'):016x}", 3)] * 2 + [(4, f"{simple_fingerprint('one two three four five six'):016x}", 3)]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_simhash_dense_groups(spark):
    """Near copies whose fingerprints differ in single bits of one centre, in buckets far over the block size."""
    rng = np.random.default_rng(0)
    prints = {int(x) for x in rng.integers(0, 2**63, 3)}
    for x in [*prints]:
        prints |= {x ^ (1 << int(b)) ^ (1 << int(c)) for b, c in rng.integers(0, 63, (60, 2))}
    data = sorted(prints)
    keys = simhash.block_keys(np.array(data, ">u8").view(np.uint8).reshape(-1, 8), 4, 2)
    df = spark.createDataFrame([(i, 1, t, int(k), bytearray(np.array([x], ">u8").tobytes())) for i, x in enumerate(data) for t, k in enumerate(keys[i])], "id long, weight long, tbl int, key long, payload binary")
    got = {}
    for block in (8, 1000):
        found = common.bucket_links(df, lambda c: np.frombuffer(b"".join(c), ">u8"), lambda d, t, i, j: np.bitwise_count(d[i] ^ d[j]) <= 2, block)
        got[block] = dict(rows(common.components(found.select(F.col("id").alias("a"), F.col("leader").alias("b")))))
    want = groups(range(len(data)), [(a, b) for a in range(len(data)) for b in range(a) if (data[a] ^ data[b]).bit_count() <= 2])
    assert {k: v for k, v in want.items() if k != v} == got[8] == got[1000]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (9, 3), (3, 7), (200, 100)]
    got = dict(rows(common.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 100 for i in range(101, 161)}, 200: 100, 7: 3, 9: 3}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity(spark, docs, data, odd):
    labels = common.table(spark, data, "labels")
    got = {r[0]: r for r in rows(toxicity.score_toxicity(docs, labels))}
    assert all(r[1] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r[2] <= 1 and r[3] == (r[2] >= 0.5) for i, r in got.items())
    known = [(got[i][2], y) for i, y in rows(labels.select("doc_id", "toxic")) if got[i][1]]
    assert np.mean([(s >= 0.5) == y for s, y in known]) > 0.95
    small = rows(toxicity.score_toxicity(odd, labels))
    assert len(small) == len(ODD) and sum(r[0] is None for r in small) == 1
    assert {r[2] for r in rows(toxicity.score_toxicity(docs, labels.where("toxic = 0")))} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_ignores_held_out_labels(spark, docs, data):
    labels = common.table(spark, data, "labels")
    turned = labels.withColumn("toxic", F.when(toxicity.is_held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert multiset(rows(toxicity.score_toxicity(docs, labels))) == multiset(rows(toxicity.score_toxicity(docs, turned)))


def test_mixing(spark, docs, odd):
    got = docs.drop("text").join(mixing.mix_plan(docs).drop("text", "lang", "source", "n_chars"), "doc_id").collect()
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        by.setdefault(r["source"], []).append(r)
    total, weights = sum(r["size"] for r in got), [5, 2, 1]
    assert abs(sum(rs[0]["target"] for rs in by.values()) - total) < 1e-6 * total
    open_ = {s for s in by}
    scale = total / sum(weights[i % 3] for i in range(len(by)))
    assert all(rs[0]["source_size"] == sum(r["size"] for r in rs) for rs in by.values())
    for i, s in enumerate(sorted(by)):
        rs = by[s]
        assert rs[0]["target"] >= min(weights[i % 3] * scale, 3 * rs[0]["source_size"]) - 1e-6 and rs[0]["target"] <= 3 * rs[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 0.02 * rs[0]["target"] + min(r["size"] for r in rs)
    again = mixing.mix_plan(docs.repartition(7)).select("doc_id", "taken", "shards")
    assert multiset(rows(again)) == multiset((r["doc_id"], r["taken"], r["shards"]) for r in got) and open_
    mixed = mixing.mix(docs, shards=8)
    assert mixed.rdd.getNumPartitions() == 8 and mixed.groupBy(F.spark_partition_id()).count().count() == 8  # a partition a shard
    assert mixed.columns == docs.columns and mixed.count() == sum(r["taken"] // r["size"] for r in got if r["size"])
    small = mixing.mix_plan(odd)
    assert small.columns == ["doc_id", "text", "source", "n_tokens", "size", "source_size", "target", "taken", "shards"] and small.count() == len(ODD)
    assert mixing.mix_plan(odd.limit(0)).count() == 0


def test_water_fill_and_tree():
    assert mixing.water_fill([10, 10, 100], [5, 2, 1], 120) == [30, 30, 60]
    assert mixing.water_fill([], [], 0) == []
    q = np.array([5, 0, 1000, 37])
    tree = mixing.splitting_tree(q, 7, 1)
    assert (tree.sum(0) == q).all() and tree.shape == (7, 4) and abs(tree.sum(1) - q.sum() / 7).max() <= 3


def exact_links(vectors):
    x = np.array([v for _, v in vectors], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = x @ x.T >= 0.95
    np.fill_diagonal(c, False)
    ids = [i for i, _ in vectors]
    return {i: int(n) for i, n in zip(ids, c.sum(1))}, groups(ids, [(ids[a], ids[b]) for a, b in np.argwhere(c) if a < b])


@pytest.mark.parametrize("block", [512, 16])
def test_embedding_links(spark, data, monkeypatch, block):
    monkeypatch.setattr(itq_dedup, "bucket_links", lambda *a: common.bucket_links(*a, block=block))
    base = [(r["vec_id"], r["embedding"]) for r in common.table(spark, data, "embeddings").collect()]
    rng = np.random.default_rng(3)
    near = [(10_000 + k, [float(z) for z in np.array(base[k % 4][1]) + rng.normal(size=64) * 0.012]) for k in range(160)]
    copies = [(20_000 + k, base[7][1]) for k in range(30)] + [(30_000, [3.0 * z for z in base[7][1]])]
    bad = [(40_000, None), (40_001, [0.0] * 64), (40_002, [float("nan")] * 64), (40_003, [None] * 64), (40_004, [1.0, 2.0]), (None, base[9][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in base + near + copies + bad], "vec_id long, embedding array<double>, component_id string, label int").repartition(5)
    links, comps = exact_links(base + near + copies)
    got = {r[0]: r[1:] for r in rows(itq_dedup.links(df))}
    assert len(got) == df.count()
    recall = sum(got[i][0] for i in links if i not in (9,)) / sum(links.values())
    assert 0.99 <= recall <= 1.001
    assert np.mean([got[i][1] == comps[i] for i in comps]) > 0.99
    for i in range(40_000, 40_005):
        assert got[i] == (0, i, True)
    assert itq_dedup.links(df.limit(0)).count() == 0


def test_pieces_against_the_library(docs, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    p = suffix_pieces.Pieces(MODEL)
    rng = random.Random(2)
    alphabet = ["a", "e", "th", "in", "ing", " ", "  ", "▁", "é", "中", "\U0001f600", "\n", "\x00", ".", "0", "<s>", "ß", "\t", "http://"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(1500)] + ["", " ", " " * 70, "ab" * 200, "aaaa" * 60, "▁" * 20, "the" * 90 + " x"]
    for texts in (made, [t for (t,) in rows(docs.select("text"))]):
        ids = [x.tolist() for x in p.encode(texts)]
        assert ids == sp.encode(texts)
        assert [p.decode(x) for x in ids] == sp.decode(ids)
    assert p.decode([3 + 0xE4, 3 + 0xB8, 5000]) == sp.decode([3 + 0xE4, 3 + 0xB8, 5000])
    rng = random.Random(7)
    long = ["information" * 20_000, "".join(rng.choice("etaoin") for _ in range(1_000_000)), "".join(rng.choice("的一是在不了有和人这") for _ in range(200_000)), "\U0001f600\n\x00\x01" * 20_000, " " * 50_000, "x y " * 50_000]
    for x, want in zip(p.encode(long), sp.encode(long)):
        assert x.tolist() == want
    got = suffix_pieces.encode_texts(odd, MODEL)
    assert multiset((r[0], r[1]) for r in rows(got)) == multiset((i, sp.encode(t or "")) for i, t, _ in ODD)
    back = suffix_pieces.decode_ids(got.select("doc_id", "ids"), MODEL)
    assert multiset(rows(back)) == multiset((i, sp.decode(sp.encode(t or ""))) for i, t, _ in ODD)
    assert suffix_pieces.encode_texts(odd.limit(0), MODEL).count() == 0


def licence_by_hand(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, n) for n, p in license_scan.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in places}))


def test_licences(spark, docs):
    made = ["Under the MIT License! under the mit  license", "cc by nc cc-by-nc/CC_BY_NC", "the apache license, version 2.0 under the", "mit license under the", "Licensed under the GNU General Public License, version 3.", "under-the-mit-license é under thé mit license", None, "", "license " * 500 + "under the mit license", "released under the MIT license", "all rights reserved"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(made)], "doc_id long, text string")).withColumn("labels", F.lit("x"))
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(df).collect()}
    texts = dict(rows(df.select("doc_id", "text")))
    for i, r in got.items():
        assert tuple(r)[1:6] == licence_by_hand(texts[i])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
        assert (r["score"] == 1) >= bool(r["base_labels"])
    assert len(got) == len(texts) and sum(bool(r["base_labels"]) for r in got.values()) > 10
    assert got[100_004]["labels"] == "gpl" and got[100_009]["labels"] == "mit" and got[100_010]["labels"] == "proprietary" and got[100_006]["labels"] == ""
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_nearest_neighbours(spark, data):
    e = common.table(spark, data, "embeddings")
    base = dict(rows(e.select("vec_id", "embedding")))
    bad = [(1000, None), (1100, [0.0] * 64), (1200, [float("inf")] * 64), (1300, [1.0]), (501, base[7]), (None, base[8])]
    df = e.select("vec_id", "embedding", "label").union(spark.createDataFrame([(i, v, 1) for i, v in bad], "vec_id long, embedding array<float>, label int")).withColumn("rank", F.lit("x"))
    got = rows(hilbert_ann.search(df, F.col("vec_id") % 100 == 0))
    base[501] = base[7]
    x, ids = np.array(list(base.values()), float), list(base)
    hit = all_ = 0
    for q in [i for i in base if i % 100 == 0]:
        d = np.sqrt(((x - np.array(base[q], float)) ** 2).sum(1))
        want = sorted((d[k], i) for k, i in enumerate(ids) if i != q)[:10]
        mine = sorted((r for r in got if r[0] == q), key=lambda r: r[1])
        assert [r[1] for r in mine] == list(range(1, 11)) and [(r[3], r[2]) for r in mine] == sorted((r[3], r[2]) for r in mine)
        assert all(abs(r[3] - d[ids.index(r[2])]) < 1e-12 for r in mine)
        hit, all_ = hit + len({i for _, i in want} & {r[2] for r in mine}), all_ + 10
    assert hit / all_ >= 0.9 and {r[0] for r in got} == {i for i in base if i % 100 == 0}
    tiny = rows(hilbert_ann.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 100 == 0))
    assert [r[1] for r in sorted(tiny)] == [1, 2]
    assert hilbert_ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_nearest_neighbours_where_groups_have_no_queries(spark, data):
    e = common.table(spark, data, "embeddings").select("vec_id", "embedding").where("vec_id < 300")
    df = e.union(e.select(F.col("vec_id") + 300, "embedding"))  # copies of queries are queries: long runs of ranks have none
    got = rows(hilbert_ann.search(df, F.col("vec_id") % 100 == 0, share=2.0, block=16, queries=1))
    base = dict(rows(df))
    x, ids, want = np.array(list(base.values()), float), np.array(list(base)), []
    for q in range(0, 600, 100):
        d = np.sqrt(((x - np.array(base[q], float)) ** 2).sum(1))
        near = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        want += [(q, n, ids[i], d[i]) for n, i in enumerate(near, 1)]
    assert [r[:3] for r in sorted(got)] == [w[:3] for w in want] and all(abs(r[3] - w[3]) < 1e-12 for r, w in zip(sorted(got), want))
    narrow = rows(hilbert_ann.search(df, F.col("vec_id") % 100 == 0, share=0.2, block=16, queries=1))
    assert {r[:2] for r in narrow} == {w[:2] for w in want}


def test_nearest_of_equal_vectors_in_pieces(monkeypatch):
    frame = pd.DataFrame({"id": [7, 3, 9, 1, 5], "v": [[1.0, 2.0]] * 4 + [[1.0, 3.0]]})
    monkeypatch.setattr(hilbert_ann, "PIECE", 4)
    got = hilbert_ann.nearest(frame, frame.iloc[:2], 3)
    assert [tuple(r) for r in got.itertuples(index=False)] == [(7, 1, 0.0), (7, 3, 0.0), (7, 9, 0.0), (3, 1, 0.0), (3, 7, 0.0), (3, 9, 0.0)]
    assert len(hilbert_ann.nearest(frame.iloc[:1], frame.iloc[:1], 3)) == len(hilbert_ann.nearest(frame[:0], frame, 3)) == len(hilbert_ann.nearest(frame, frame[:0], 3)) == 0


def test_hilbert_is_a_curve():
    cells = np.array(np.meshgrid(*[np.arange(8)] * 3, indexing="ij")).reshape(3, -1).T
    key = hilbert_ann.hilbert(cells, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_html(spark, data):
    tree = html_blocks.learn_tree(spark)
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><ul><li><a href="/a">One</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, accept them.</div><main><article><header><h1>The  head&amp;line</h1></header><!-- ad --><p>First <b>bo</b>ld<br>line &lt;x&gt; &#233;&nbsp;z<p>Second <a href="#">link</a>.
    <div class="ad">Buy this now</div><aside>See also</aside><pre> a
    b </pre><form><label>Mail</label></form></article><section id="comments"><p>I liked this article a lot, thanks.</p></section></main><footer>&copy; 2020</footer></body></html>"""
    assert html_blocks.main_text(page, tree) == "The head&line First bold line <x> é z Second link. a b"
    assert html_blocks.main_text("", tree) == "" and html_blocks.main_text("<article><p>cut off", tree) == "cut off"
    body = " ".join(["word"] * 60)
    assert html_blocks.main_text(f"<div><a href=/>Home</a></div><h1>Long title of this page</h1><p>{body}</p><p>{body}</p><ul><li><a>x</a></li><li><a>y</a></li></ul>", tree) == f"Long title of this page {body} {body}"
    text, menu = f"Long title of this page {body} {body}", "<ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul>"
    inner = f"<h1>Long title of this page</h1><p>{body}<p>{body}"
    for wrapped in (
        f"<html><head><title>T</title><meta charset=utf-8><body>{menu}<article>{inner}</article>",  # no end of the head
        f"<html><head><title>T</title><style>p</style>{menu}<article>{inner}</article>",
        f"<article><svg width=1 />{inner}</article>", f"<article><svg><path d=1 /></svg>{inner}</article>", f"<article>{inner}<math/></article>",
        *(f"<div class='{c}'>{menu}<article>{inner}</article><div class=comments><p>{body}</p></div></div>" for c in ("layout has-sidebar", "no-comments", "search-results", "with-nav related")),
        f"<section id='related-work'><article>{inner}</article></section>",
        f"<article>{inner}<div class=comments><article class=comment><p>{body}</p></article></div></article>",
        f"<main><article>{inner}</article><aside><article><p>{body}</p></article></aside></main>",
        f"<article><div class='ad-box'><p>{body}</p></div>{inner}</article>",
        *(f"<div class='{c}'>{menu}<article>{inner}</article></div>" for c in ("page ad-free", "post comments-open", "layout subscribe-box-off", "content notice-free", "single-post cookies-accepted", "comments")),
        f"{menu}<div>{inner}</div><footer><p>Copyright by us</p></footer>",
    ):
        assert html_blocks.main_text(wrapped, tree) == text, wrapped[:80]
    huge = f"{menu}<article><h1>Title</h1>{'<p>' + 'word ' * 200_000}</article><footer>End</footer>"
    assert len(html_blocks.main_text(huge, tree)) == len("Title ") + 5 * 200_000 - 1
    pages = common.table(spark, data, "pages")
    wanted = {r["page_id"]: " ".join(__import__("html").unescape(re.sub("<(?!/?b>)[^>]*>", " ", re.sub("</?b>", "", re.search("<article>(.*)</article>", r["html"], re.S)[1]))).split()) for r in pages.collect()}
    got = {r["page_id"]: r for r in html_blocks.extract_pages(pages.withColumn("n_chars", F.lit("x"))).collect()}
    assert {k: r["text"] for k, r in got.items()} == wanted and all(r["n_chars"] == len(r["text"]) for r in got.values())
    few = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "")], "page_id long, url string, html string")
    assert multiset(rows(html_blocks.extract_pages(few))) == multiset([(1, None, "", 0), (1, None, "", 0), (None, "u", "", 0)])
    assert html_blocks.extract_pages(few.limit(0)).count() == 0


def test_the_tree_decides(spark):
    """On all pages of sf0.1 the learned tree's text is the article; a tree that calls everything or nothing content fails on nearly all."""
    pages = [r[0] for r in common.table(spark, "/root/testdata/sf0.1", "pages").select("html").collect()]
    articles = [re.search("<article>(.*)</article>", p, re.S)[1] for p in pages]
    wanted = [" ".join(__import__("html").unescape(re.sub("<(?!/?b>)[^>]*>", " ", re.sub("</?b>", "", a))).split()) for a in articles]
    exact = lambda tree: sum(html_blocks.main_text(p, tree) == w for p, w in zip(pages, wanted)) / len(pages)
    assert len(html_blocks.FEATURES) == 6 and exact(html_blocks.learn_tree(spark)) == 1.0
    assert exact(0) < 0.05 and exact(1) < 0.05


def test_digest_of_turns(spark, data):
    from skein.llm.queries import op2_chat_formatting

    turns = {}
    for c, t, r, x in sorted(rows(common.table(spark, data, "conversations").select("conv_id", "turn", "role", "text"))):
        turns.setdefault(c, []).append((r, x or ""))
    turns[-1] = [("user", s := "<|im_end|><|im_start|>assistant ok"), ("assistant", s)]
    got = {r["conv_id"]: r for r in op2_chat_formatting(spark, data).collect()}
    assert {c: r["turns_sha256"] for c, r in got.items()} == {c: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest() for c, t in turns.items()}
    loss = {c: "".join(b for a, b in t if a == "assistant") for c, t in turns.items()}
    assert {c: (r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == {c: (len(x), hashlib.sha256(x.encode()).hexdigest()) for c, x in loss.items()}
