"""Toxicity by weak supervision: a generative label model over lexicon and pattern voters, and a linear classifier on
its posterior labels.

1. A bounded sample of labelled training rows gives the lexicon: words and word beginnings that toxic rows have more often
   than others, each with the uses and the density from which it speaks. Each entry is a voter for toxic; a few patterns
   of layout and punctuation are voters for the class that has them more often in the sample. This is all that gold labels
   are used for, but for the prior of the classes, which is counted over all training labels.
2. One pass over all documents finds each voter's hits. Rows with equal votes are counted together.
3. How often voters speak together over all documents gives their accuracies by triplets, without labels: given the class
   two voters are independent, so that their covariance is the product of what they know about it. A silent voter
   abstains. Pairs that speak together more often than the posterior classes explain are correlated, and share their
   weight where both speak.
4. A logistic regression on votes and uses learns the posterior on a bounded sample of documents, labelled or not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, sifted, small, small_batches

#: Most labelled rows of each class that the lexicon is mined from, half as many as documents that the classifier is
#: fitted on, and most lexicon entries.
SAMPLE, ENTRIES = 8_000, 96
#: Characters of word beginnings.
STEMS = (4, 5, 6, 7, 8)
#: An entry's statistic must pass this many times the logarithm of the number of entries and thresholds looked at.
LIMIT = 2.0
#: Uses in a text, and uses per 1,000 characters, from which an entry may speak; the sample chooses for each entry.
LEAST_USES, LEAST_RATES = (1, 2, 3), (0.0, 0.5, 1.0, 2.0, 4.0)
#: Accuracy of a voter that too few triplets say anything about, and how many are enough.
START, TRIPLETS = 0.8, 3
#: Pattern voters: name, pattern, hits per 1,000 characters from which they vote.
PATTERNS = [("shouting", r"\b[A-Z]{4,}\b", 5.0), ("exclaiming", r"!{2,}", 2.0), ("addressing", r"(?i)\byou(?:r|'re)?\b", 8.0)]
_NOT_WORD = re.compile(r"[^\w]|[\d_]")


def is_held_out(doc_id):
    """Rows that no label is learned from: CRC-32 of the id as text is divisible by 5. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, id_col: str) -> DataFrame:
    """(id, y) of every labelled id that isn't held out."""
    return labels.where(F.col("toxic").isin(0, 1) & ~is_held_out(id_col)).groupBy(F.col(id_col)).agg(F.max("toxic").alias("y"))


def toxic_share(labels: DataFrame, id_col: str) -> float:
    """The share of toxic ones among all training labels, with one label of each class added."""
    n = training_labels(labels, id_col).agg(F.count("*").alias("all"), F.count_if(F.col("y") == 1).alias("toxic")).first()
    return (n["toxic"] + 1) / (n["all"] + 2)


def g2(p, n, n1: float, n0: float):
    """The log-likelihood ratio statistic of p of n1 toxic and n of n0 other rows having an entry."""
    term = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    p, n = np.asarray(p, float), np.asarray(n, float)
    s, has = n1 / (n1 + n0), p + n
    lacks = n1 + n0 - has
    return 2 * (term(p, has * s) + term(n, has * (1 - s)) + term(n1 - p, lacks * s) + term(n0 - n, lacks * (1 - s)))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """At most ``sample`` rows (id, text, y) of each label among the ids of ``docs``, the first in the order of a hash; never held-out rows.

    An id is one row, however many texts it has: the one of the smallest hash.
    """
    ids = docs.select(F.col(id_col)).distinct()
    known = checkpointed(training_labels(labels, id_col).join(ids, id_col, "left_semi"))
    chosen = known.where("y = 1").orderBy(F.xxhash64(id_col), id_col).limit(sample).union(known.where("y = 0").orderBy(F.xxhash64(id_col), id_col).limit(sample))
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col)  # at most 2 * sample ids
    return texts.groupBy(id_col).agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"), F.first("y").alias("y"))


def first_by_hash(rows: DataFrame, id_col: str, ties: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows in the order of a hash of their id. Only rows below twice the hash that so many are expected under are ordered, so that
    partitions hand over few rows each and not ``limit``; where these are too few, all are."""
    n = rows.count()
    cut = -(1 << 63) + min((1 << 64) - 1, 2 * limit * (1 << 64) // max(n, 1))
    near = rows.where(F.xxhash64(id_col) <= F.lit(cut))
    return (near if near.count() >= min(limit, n) else rows).orderBy(F.xxhash64(id_col), *ties).limit(limit)


def one_of_copies(rows: DataFrame) -> DataFrame:
    """(text, y): of the sample's rows of one class whose words of 8 letters or more have the same smallest hash, one:
    near copies are no independent evidence for what they all contain."""
    long = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 8)
    least = F.coalesce(F.array_min(F.transform(long, lambda w: F.xxhash64(w))), F.xxhash64("text"))
    return rows.groupBy("y", least.alias("least")).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "y")


def mine_lexicon(rows: DataFrame, entries: int = ENTRIES) -> tuple[list[str], int]:
    """Words (``=word``) and word beginnings (``stem``) that toxic rows have more often than others, best first, eight
    times ``entries`` at most; and how many entries three toxic rows or more have.

    Counts documents, not uses.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    stems = F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= min(STEMS)), lambda w: F.array(F.concat(F.lit("="), w), *(F.substring(w, 1, n) for n in STEMS))))
    counts = rows.select("y", F.explode(F.array_distinct(stems)).alias("e")).groupBy("e").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).where("p >= 3")
    by = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = by.get(1, 0), by.get(0, 0)
    if not n1:
        return [], 0
    counts = checkpointed(counts)
    s = n1 / (n1 + n0)
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    has = F.col("p") + F.col("n")
    lacks = F.lit(n1 + n0) - has
    score = 2 * (term(F.col("p"), has * s) + term(F.col("n"), has * (1 - s)) + term(F.lit(n1) - F.col("p"), lacks * s) + term(F.lit(n0) - F.col("n"), lacks * (1 - s)))
    found = counts.where(F.col("p") * n0 > 1.5 * F.col("n") * n1).orderBy(score.desc(), "e").limit(8 * entries).collect()
    return [r["e"] for r in found], counts.count()


def tuned_voters(found: list[str], looked: int, gold: pd.DataFrame, entries: int) -> list[tuple[str, int, float]]:
    """(entry, uses, rate) of the chosen entries: for each the thresholds that tell the sample's classes apart best.

    Best first, an entry is taken if its statistic is beyond chance (``LIMIT``) for the number of entries that three toxic
    rows use that often, of ``looked`` in all; if its share among toxic rows is 8 times that among
    others, and neither it nor a chosen one is the beginning of the other.
    """
    toxic = gold["y"].to_numpy() == 1
    n1, n0, chars = toxic.sum(), (~toxic).sum(), np.maximum(gold["n_chars"].to_numpy(), 1)
    row = np.repeat(np.arange(len(gold)), gold["voters"].str.len())
    voter, uses = (np.concatenate([np.empty(0, int), *gold[c]]).astype(int) for c in ("voters", "uses"))
    best: dict[int, tuple] = {}
    for u in LEAST_USES:
        for rate in LEAST_RATES:
            on = (uses >= u) & (1000 * uses >= rate * chars[row]) & (voter < len(found))
            p, n = (np.bincount(voter[on & (toxic[row] == c)], minlength=len(found)) for c in (True, False))
            limit = LIMIT * np.log(max((p + n >= 3).sum() * looked / max(len(found), 1), 1) * len(LEAST_USES) * len(LEAST_RATES))
            score = np.where((p >= 3) & ((p + 0.5) / (n1 + 1) > 8 * (n + 0.5) / (n0 + 1)), g2(p, n, n1, n0), 0)
            for k in np.flatnonzero(score >= limit):
                if score[k] > best.get(k, (0,))[0] + 1e-9:
                    best[k] = (score[k], found[k], u, rate)
    chosen: list[tuple[str, int, float]] = []
    for _, e, u, rate in sorted(best.values(), key=lambda x: (-x[0], x[1])):
        bare = e.lstrip("=")
        if len(chosen) < entries and not any(bare.startswith(c) or c.startswith(bare) for c in (x[0].lstrip("=") for x in chosen)):
            chosen.append((e, u, rate))
    return chosen


def automaton(lexicon: list[str]):
    a = ahocorasick.Automaton()
    for i, e in enumerate(lexicon):
        bare = e.lstrip("=")
        a.add_word(bare, (*(a.get(bare) if bare in a else ()), i))
    if lexicon:
        a.make_automaton()
    return a


def hits(text: str, lexicon: list[str], a) -> dict[int, int]:
    """Uses of each entry at the beginning of a word; whole words for ``=`` entries."""
    found: dict[int, int] = {}
    if not lexicon:
        return found
    low = text.lower()
    for end, entries in a.iter(low):
        for i in entries:
            begin = end + 1 - len(lexicon[i].lstrip("="))
            if begin and not _NOT_WORD.match(low[begin - 1]):
                continue
            if lexicon[i][0] == "=" and end + 1 < len(low) and not _NOT_WORD.match(low[end + 1]):
                continue
            found[i] = found.get(i, 0) + 1
    return found


def find_votes(docs: DataFrame, lexicon: list[str], id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_chars, voters array<int>, uses array<int>, *keep): entries and patterns found in each whole text, and how
    often; a pattern only where it is dense enough."""
    kind = docs.schema[id_col].dataType.simpleString()
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, patterns = automaton(lexicon), [(re.compile(p), rate) for _, p, rate in PATTERNS]
        for frame in frames:
            voters, uses = [], []
            for text in frame["text"]:
                found = hits(text, lexicon, a)
                for k, (pattern, rate) in enumerate(patterns):
                    n = len(pattern.findall(text))
                    if n and 1000 * n >= rate * len(text):
                        found[len(lexicon) + k] = n
                voters.append(sorted(found))
                uses.append([found[i] for i in sorted(found)])
            yield pd.DataFrame({"id": frame["id"], "n_chars": frame["text"].str.len(), "voters": voters, "uses": uses} | {c: frame[c] for c in keep})

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep).mapInPandas(run, f"id {kind}, n_chars long, voters array<int>, uses array<int>{more}")


def speaking(voters: list[tuple[str, int, float]]):
    """Column of the voters that speak: those of enough uses and density; patterns speak wherever they are found."""
    uses, rates = (F.array(*(F.lit(x[k]) for x in voters), *(F.lit(z) for _ in PATTERNS)) for k, z in ((1, 1), (2, 0.0)))
    on = lambda v, u: (u >= F.get(uses, v)) & (1000.0 * u >= F.get(rates, v) * F.col("n_chars"))
    return F.filter(F.zip_with("voters", "uses", lambda v, u: F.when(on(v, u), v)), lambda v: v.isNotNull())


def votes_matrix(speak, m: int) -> np.ndarray:
    """Rows by voters: 1 where one speaks."""
    x = np.zeros((len(speak), m))
    x[np.repeat(np.arange(len(speak)), [len(v) for v in speak]), np.concatenate([np.empty(0, int), *speak]).astype(int)] = 1
    return x


def posterior(x: np.ndarray, prior: float, weight: np.ndarray, shared: np.ndarray | None = None) -> np.ndarray:
    """P(toxic | votes): prior log-odds plus the weights of those that speak. Of correlated voters (``shared``, voters by
    voters) that speak together each counts for less: two that always do, for half."""
    z = x @ weight if shared is None else (x / (1 + x @ shared)) @ weight
    return 1 / (1 + np.exp(-np.clip(prior + z, -30, 30)))


def _summed(patterns: DataFrame, f) -> dict[tuple[int, int], float]:
    """Adds up the cells {(i, j): value} that ``f`` makes of each batch, in tasks first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], float] = {}
        for frame in frames:
            for k, v in f(frame).items():
                total[k] = total.get(k, 0.0) + v
        yield pd.DataFrame([(i, j, v) for (i, j), v in total.items()], columns=["i", "j", "v"])

    return {(r["i"], r["j"]): r["v"] for r in patterns.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


def weights_of(accuracy: np.ndarray, prior: float) -> np.ndarray:
    """What a vote adds to the log-odds."""
    return np.clip(np.log(accuracy / (1 - accuracy)) - prior, -8, 8)


def triplet_accuracies(n: float, both: np.ndarray, share: float, toward: np.ndarray) -> np.ndarray:
    """P(toxic | a voter speaks) from ``both``, in how many of n rows each pair speaks, and the share of toxic rows."""
    m, rate = len(both), np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(rate, rate)
    sure = n * cov >= 5 + 4 * np.sqrt(n * np.outer(rate, rate))  # beyond chance
    accuracy = np.where(toward == 1, START, share * (1 - START))
    for i in range(m):
        with_i = np.flatnonzero(sure[i] & (np.arange(m) != i))
        j, k = (with_i[x] for x in np.triu_indices(len(with_i), 1))
        ok = sure[j, k]
        knows = cov[i, j[ok]] * cov[i, k[ok]] / cov[j[ok], k[ok]]
        if len(knows) >= TRIPLETS:
            accuracy[i] = share + np.sqrt(share * (1 - share) * np.median(knows)) / rate[i] * (1 if toward[i] else -1)
    return np.clip(accuracy, 1e-4, 1 - 1e-4)


def label_model(patterns: DataFrame, share: float, toward: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Prior log-odds, each voter's accuracy and weight, and the correlations of voters beyond their classes.

    ``patterns(speak array<int>, n)`` counts the rows of each set of votes, over all documents; ``share`` is the prior of
    toxic ones; ``toward`` (1 or 0 a voter) only says which class a voter speaks for. No labels are read.
    """
    m = len(toward)
    prior = float(np.log(share / (1 - share)))

    def together(frame: pd.DataFrame) -> dict:
        x, n = votes_matrix(frame["speak"], m), frame["n"].to_numpy(float)
        both = (x * n[:, None]).T @ x
        return {(-1, -1): float(n.sum())} | {(int(i), int(j)): float(both[i, j]) for i, j in np.argwhere(both > 0)}

    got = _summed(patterns, together)
    accuracy = triplet_accuracies(got.get((-1, -1), 0.0), np.array([[got.get((i, j), 0.0) for j in range(m)] for i in range(m)]), share, toward)
    weight = weights_of(accuracy, prior)

    def pairs(frame: pd.DataFrame) -> dict:
        x, n = votes_matrix(frame["speak"], m), frame["n"].to_numpy(float)
        q = posterior(x, prior, weight)
        cells: dict[tuple[int, int], float] = {(-1, 1): float((n * q).sum()), (-1, 0): float((n * (1 - q)).sum())}
        for c, w in ((1, n * q), (0, n * (1 - q))):
            both = (x * w[:, None]).T @ x
            for i, j in np.argwhere(both > 0):
                cells[(int(i), int(c * m + j))] = cells.get((int(i), int(c * m + j)), 0.0) + float(both[i, j])
        return cells

    got, extra = _summed(patterns, pairs), np.zeros((m, m))
    for c in (1, 0):
        n = max(got.get((-1, c), 0.0), 1e-9)
        both = np.array([[got.get((i, c * m + j), 0.0) for j in range(m)] for i in range(m)]) / n
        rate = np.diag(both)
        alone = np.outer(rate, rate)
        rho = (both - alone) / np.sqrt(np.maximum(np.outer(rate * (1 - rate), rate * (1 - rate)), 1e-24))
        sure = n * (both - alone) >= 5 + 4 * np.sqrt(n * alone)  # beyond chance
        extra = np.maximum(extra, np.where(sure & (rho > 0.1), rho, 0.0))
    np.fill_diagonal(extra, 0)
    return prior, accuracy, weight, extra


def features(voters, uses, speak, n_chars, m: int) -> np.ndarray:
    """Votes, logarithms of uses, and all lexical uses together: their logarithm and their density."""
    x = np.zeros((len(voters), 2 * m + 2))
    for r, (v, u, s, n) in enumerate(zip(voters, uses, speak, n_chars)):
        if len(v):
            x[r, s] = 1
            x[r, m + np.asarray(v)] = np.log1p(u)
            lexical = sum(c for i, c in zip(v, u) if i < m - len(PATTERNS))
            x[r, -2], x[r, -1] = np.log1p(lexical), min(1.0, 50 * lexical / max(n, 1))
    return x


def fit_linear(x: np.ndarray, p: np.ndarray, rounds: int = 60, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps; classes weigh the same."""
    w, x1 = np.zeros(x.shape[1] + 1), np.c_[x, np.ones(len(x))]
    weight = np.where(p >= 0.5, 0.5 / max((p >= 0.5).mean(), 1e-6), 0.5 / max((p < 0.5).mean(), 1e-6))
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-3]
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (weight * q * (1 - q))[:, None]).T @ x1 + np.diag(penalty), x1.T @ (weight * (p - q)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, entries: int = ENTRIES, carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, held_out, score, predicted, n_voters) for every row of ``docs``, and the columns ``carry`` under their names.

    Null and empty texts are scored as texts without words; a null id is never held out; repeated rows get equal
    scores; without an entry that passes (no toxic training label, or too few) every score is 0; an empty table gives an
    empty one. Only the text is an input of the score.
    """
    small_batches(docs)
    rows = checkpointed(one_of_copies(training_sample(docs, labels, id_col, text_col, sample)).withColumn("row", F.monotonically_increasing_id()))
    found, looked = mine_lexicon(rows, entries)
    gold = find_votes(rows, found, "row", "text", ("y",)).select("voters", "uses", "n_chars", "y").toPandas() if found else None  # 2 * sample rows
    voters = tuned_voters(found, looked, gold, entries) if found else []
    lexicon = [e for e, *_ in voters]
    m = len(lexicon) + len(PATTERNS)
    taken = {f"_carry_{k}": c for k, c in (carry or {}).items()}
    carried, all_ = list(taken), docs.withColumns(taken) if taken else docs
    more = "".join(f", {k} {all_.schema[k].dataType.simpleString()}" for k in taken)
    votes = checkpointed(find_votes(all_, lexicon, id_col, text_col, tuple(taken)).withColumn("speak", speaking(voters)))
    if lexicon:
        patterns = checkpointed(votes.groupBy("speak").agg(F.count("*").alias("n")))
        seen = np.array([[gold.loc[gold["y"] == c, "voters"].map(lambda v: len(found) + k in v).mean() for c in (1, 0)] for k in range(len(PATTERNS))])
        toward = np.r_[np.ones(len(lexicon)), seen[:, 0] > 8 * seen[:, 1]].astype(int)
        prior, _, weight, shared = label_model(patterns, toxic_share(labels, id_col), toward)
        chosen = first_by_hash(votes.where(~is_held_out("id")), "id", ["n_chars", "voters"], 2 * sample).select("voters", "uses", "speak", "n_chars").toPandas()
        p = posterior(votes_matrix(chosen["speak"], m), prior, weight, shared)
        w, bias = fit_linear(features(chosen["voters"], chosen["uses"], chosen["speak"], chosen["n_chars"], m), p)
    else:
        w, bias = np.zeros(2 * m + 2), -30.0

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            z = features(frame["voters"], frame["uses"], frame["speak"], frame["n_chars"], m) @ w + bias
            yield pd.DataFrame({"id": frame["id"], "score": 1 / (1 + np.exp(-np.clip(z, -500, 500))) if lexicon else np.zeros(len(frame)), "n_voters": frame["speak"].str.len()} | {k: frame[k] for k in carried})

    kind = docs.schema[id_col].dataType.simpleString()
    done = votes.mapInPandas(score, f"id {kind}, score double, n_voters int{more}").withColumnRenamed("id", id_col)
    return done.select(id_col, is_held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_voters", *(F.col(k).alias(k.removeprefix("_carry_")) for k in taken))


def clean_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose own text isn't called toxic, with or without an id, whatever other rows share that id; in their columns.

    A verdict depends on the text alone, so it is handed back by 128 bits of hash of the text: equal texts go or stay together. Texts that
    can't be toxic stay where they are, by a filter of the toxic ones; only the others are joined.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text)).cast("struct<a: bigint, b: bigint>")
    toxic = score_toxicity(docs, labels, id_col, text_col, carry={"a": key["a"], "b": key["b"]}, **options).where("predicted = 1").select(F.col("a").alias("_toxic_a"), F.col("b").alias("_toxic_b")).distinct()
    toxic = checkpointed(toxic)
    near, rest = sifted(docs, key["a"], toxic.select("_toxic_a"))
    return near.join(small(toxic, toxic.count()), (key["a"] == F.col("_toxic_a")) & (key["b"] == F.col("_toxic_b")), "left_anti").union(rest)
