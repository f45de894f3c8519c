"""Near copies by bands of MinHashes and the exact Jaccard similarity of shingle sets.

Each set of shingles has ``BANDS`` keys, each the hash of ``ROWS`` of its least hashes under as many permutations; sets that share a key
are candidates, whatever their size and number. A cluster of candidates is decided set by set, so no pair below the
similarity is linked. The fingerprints of operator 3, at a width for texts that share four fifths of their shingles, say which first
comparisons in large clusters are worth while.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_runs, checkpointed, components, fitted, sifted, small, small_batches, starts
from .simhash import bit_counts, near_duplicates

#: 64-bit words of a fingerprint.
WORDS = 8
#: Keys of a set, and least hashes in each: a pair shares a key with probability 1 - (1 - J^ROWS)^BANDS, 0.9994 at J = 0.8.
BANDS, ROWS = 40, 8
#: Sets of a cluster in one part; sets sent from Python at a time.
PART, SEND = 512, 256
#: Hashes of a cluster's sets in one part at most; first nodes that each node of a cut cluster is compared with beforehand.
HASHES, STARS = 500_000, 3
#: Standard deviations by which the distance of a similar pair may exceed its mean in a first comparison.
SIGMAS = 4.5
#: Sets in one task at least where their keys are dealt out.
TASK_SETS = 4096
#: Columns of a dense product at a time; hashes permuted at a time.
COLUMNS, AT_ONCE = 4096, 1 << 16
_RNG = np.random.default_rng(5)
#: The permutations x -> a * x + b of 64 bits, a odd; and odd factors that fold a band into its key.
FACTORS, SHIFTS = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64)
FOLD = _RNG.integers(0, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct XXH64 (seed 42) of all runs of ``shingle`` words, sorted; fewer words make one shingle, none an empty set."""
    w = (text or "").encode().lower().split()
    cut = zip(*(w[k:] for k in range(shingle))) if len(w) >= shingle else [w] if w else []
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(s), 42) for s in cut], dtype=np.uint64))


def differing(similar: float) -> float:
    """The expected share of differing bits of two sets of equal size with that Jaccard similarity."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def reach(similar: float, words: int) -> int:
    """The Hamming distance within ``words`` 64-bit words that similar pairs stay in."""
    p = differing(similar)
    return round(64 * words * p + SIGMAS * math.sqrt(64 * words * p * (1 - p)))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Sets by ``BANDS`` keys, none of the sets empty. All sets are permuted together, some hashes at a time."""
    least = np.full((len(sets), BANDS * ROWS), np.iinfo(np.uint64).max, np.uint64)
    row, begin = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), 0
    hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    while begin < len(hashes):
        x, r = hashes[begin : begin + AT_ONCE], row[begin : begin + AT_ONCE]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        for k in range(BANDS * ROWS):
            y = x * FACTORS[k] + SHIFTS[k]
            least[r[first], k] = np.minimum(least[r[first], k], np.minimum.reduceat(y, first))
        begin += AT_ONCE
    banded = least.reshape(len(sets), BANDS, ROWS)
    key = np.zeros((len(sets), BANDS), np.uint64)
    for k in range(ROWS):
        key = (key ^ banded[:, :, k]) * FOLD[k]
        key ^= key >> np.uint64(29)
    return (key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def set_print(hashes: np.ndarray) -> bytes:
    """The fingerprint of a set of hashes; none for an empty one."""
    return np.packbits(2 * bit_counts(hashes, WORDS) > len(hashes)).tobytes() if len(hashes) else b""


def grouped(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first of n rows in each row's connected component over the links (i, j)."""
    group = np.arange(n)
    while len(i):
        m = np.minimum(group[i], group[j])
        if (group[i] == m).all() and (group[j] == m).all():
            break
        np.minimum.at(group, i, m)
        np.minimum.at(group, j, m)
    return group


def similar_groups(sets: list[np.ndarray], similar: float) -> np.ndarray:
    """The first set of each set's group, groups being connected over pairs of that Jaccard similarity or more, all exact.

    Shared elements are counted for all pairs at once: elements in many of the sets by products of 0/1 matrices, the others
    by walking through the sets that hold them.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(n), size)
    _, column, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros((n, n), np.int64)
    dense = np.flatnonzero(holders > max(n // 8, 16))
    place = np.full(len(holders), -1)
    place[dense] = np.arange(len(dense))
    at = place[column]
    for k in range(0, len(dense), COLUMNS):
        mine = (at >= k) & (at < k + COLUMNS)
        held = np.zeros((n, min(COLUMNS, len(dense) - k)), np.float32)
        held[row[mine], at[mine] - k] = 1
        common += (held @ held.T).astype(np.int64)
    rest = np.flatnonzero((at < 0) & (holders[column] > 1))
    rest = rest[np.argsort(column[rest], kind="stable")]
    column, row, d = column[rest], row[rest], 1
    live = np.flatnonzero(column[:-1] == column[1:])
    while len(live):
        np.add.at(common, (row[live], row[live + d]), 1)
        d += 1
        live = live[live + d < len(column)]
        live = live[column[live] == column[live + d]]
    i, j = np.nonzero(np.triu(common, 1))
    both = common[i, j]
    ok = both / (size[i] + size[j] - both) >= similar
    return grouped(n, i[ok], j[ok])


def row_key(docs: DataFrame) -> Column:
    """128 bits of hash over all columns, as text: equal for repeated rows only. Maps count by their entries in the order of their keys."""

    def plain(f) -> Column:
        if f.dataType.typeName() == "map":
            return F.to_json(F.transform(F.array_sort(F.map_keys(f.name)), lambda k: F.struct(k.alias("k"), F.element_at(F.col(f.name), k).alias("v"))))
        return F.to_json(F.struct(f.name)) if re.search("map<|variant", f.dataType.simpleString()) else F.col(f.name)

    columns = [plain(f) for f in docs.schema]
    return F.concat(F.hex(F.xxhash64(*columns)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *columns)))


def candidates(nodes: DataFrame) -> DataFrame:
    """(node, firsts array<long>) of ``nodes(node, keys array<long>)``: the smallest node of each bucket that a node is in, a bucket being the
    nodes that share a key. No node has more of them than there are bands.

    The smallest node of a key is an aggregate, combined before the shuffle, and only keys of two nodes or more are joined back: a
    frequent key is a skewed join and not a group of its own.
    """
    rows = nodes.select("node", F.explode("keys").alias("key"))
    heads = rows.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head != last").select("key", "head")
    found = rows.join(heads, "key").where("node != head")
    return found.groupBy("node").agg(F.collect_set("head").alias("firsts"))


def _fingerprint_heads(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, firsts): the smallest node of each node's class of operator 3, by its fingerprints in pigeonhole blocks. No text is shuffled."""
    at = F.xxhash64("row").alias("at")
    classes = near_duplicates(keyed.select(at, "text"), "at", "text").select("at", "component_id").distinct()
    held = nodes.select("node", at).join(classes, "at")
    heads = held.groupBy("component_id").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head != last")
    return held.join(heads, "component_id").where("node != head").select("node", F.array("head").alias("firsts"))


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = 0.8, shingle: int = 5, fingerprints: bool = False) -> DataFrame:
    """(row, id, node, component) for every row of ``docs``: row its ``row_key``, node the hash of its shingle set,
    component the smallest node reachable over pairs whose Jaccard similarity is ``similar`` at least.

    With ``fingerprints``, the classes of operator 3 (SimHash in pigeonhole blocks) are candidates beside those of the bands.

    Equal sets are one node, so copies never meet each other. Clusters are the connected components of the candidates; the
    sets of a cluster meet in one task, which decides all its pairs exactly and returns a link for each set and not for each
    pair. A cluster of more than ``PART`` sets or ``HASHES`` hashes is first thinned: its nodes are compared with some of
    their first nodes, and pairs inside its largest group need no more. The others are dealt in parts, and each pair of parts is a
    task's group of its own, so that none holds more than two parts and no pair of the cluster goes undecided.
    """
    small_batches(docs)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingle_set(t, shingle) for t in frame["text"]]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            some = [k for k, s in enumerate(sets) if len(s)]
            keys = [[]] * len(sets)
            for k, mine in zip(some, band_keys([sets[k] for k in some])):
                keys[k] = mine
            yield pd.DataFrame({"row": frame["row"], "id": frame["id"], "node": node, "n": [len(s) for s in sets], "print": [set_print(s) for s in sets], "keys": keys})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), SEND):
                part = frame.iloc[at : at + SEND]
                yield part.drop(columns="text").assign(hashes=[shingle_set(t, shingle).view(np.int64) for t in part["text"]])

    keyed = docs.select(row_key(docs).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = checkpointed(keyed.mapInPandas(sign, "row string, id long, node long, n long, print binary, keys array<long>"))
    nodes = signed.where(F.length("print") > 0).groupBy("node").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("n", "print", "keys")))
    nodes = checkpointed(fitted(nodes, signed.count(), TASK_SETS))
    number = nodes.count()
    nodes = fitted(nodes, number, TASK_SETS)
    found = fitted(candidates(nodes.select("node", "keys")), number)
    if fingerprints:
        found = found.union(fitted(_fingerprint_heads(keyed, nodes), number))
        found = found.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("firsts"))).alias("firsts"))
    found = checkpointed(fitted(found, number))

    clusters = components(_cluster_edges(found)).withColumnRenamed("component", "cluster")
    clusters = clusters.union(clusters.select(F.col("cluster").alias("node"), "cluster").distinct())  # its smallest node too
    members = checkpointed(fitted(clusters.join(nodes.select("node", "row", "n"), "node"), number))

    def sets(of: DataFrame, columns: str) -> DataFrame:
        """``of(node, row, ...)`` with the hashes of each node's set. Only the texts of those rows, and few others, are shuffled."""
        near, _ = sifted(keyed.select("row", "text"), F.col("row"), of.select("row"))
        texts = of.join(near, "row").dropDuplicates(["row"])
        return texts.select(*columns.split(), "text").mapInPandas(cut, ", ".join(f"{c} long" for c in columns.split()) + ", hashes array<long>")

    def parts(of) -> Column:
        return F.ceil(F.greatest(F.count(of) / PART, F.sum(of) / HASHES))

    large = checkpointed(fitted(members.groupBy("cluster").agg(parts(F.col("n")).alias("parts")).where("parts > 1").select("cluster"), number))
    many = large.count()
    dealt = sets(members.join(small(large, many), "cluster", "left_anti"), "node cluster").select("cluster", "node", "hashes", *(F.lit(0).cast("long").alias(c) for c in ("lo", "hi")))
    links = None
    if many:
        inside = members.join(small(large, many), "cluster", "left_semi")
        inside_sets = checkpointed(fitted(sets(inside, "node"), number, TASK_SETS))
        links = checkpointed(fitted(_star_links(found.join(inside.select("node"), "node", "left_semi"), nodes, inside_sets, similar), number, TASK_SETS))
        met = _dealt(inside, components(links), parts).join(inside_sets, "node")
        dealt = dealt.union(met.select(*dealt.columns))

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in by_runs(frames, ["cluster", "lo", "hi"]):
            at = np.r_[np.flatnonzero(starts(rows, ["cluster", "lo", "hi"])), len(rows)]
            node, hashes = rows["node"].to_numpy(np.int64), rows["hashes"].to_list()
            first = np.concatenate([i + similar_groups(hashes[i:j], similar) for i, j in zip(at, at[1:])])
            linked = first != np.arange(len(rows))
            yield pd.DataFrame({"a": node[linked], "b": node[first[linked]]})

    keys = ("cluster", "lo", "hi")
    verified = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(decide, "a long, b long")
    group = components(verified if links is None else verified.union(links))
    return signed.join(group, "node", "left").select("row", "id", "node", F.coalesce("component", "node").alias("component"))


def _cluster_edges(found: DataFrame) -> DataFrame:
    """(a, b) that connect what ``found(node, firsts)`` connects: each node and its smallest first node, and that one with the node's others.
    The nodes of a large group have their first nodes in common, so its second kind of edge is few different ones."""
    least = F.array_min("firsts")
    own, shared = F.array(F.struct(F.col("node").alias("a"), least.alias("b"))), F.transform("firsts", lambda x: F.struct(x.alias("a"), least.alias("b")))
    return found.select(F.inline(F.concat(own, shared))).where("a != b").distinct()


def _star_links(found: DataFrame, nodes: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(a, b): the similar ones of the pairs of a node and one of its ``STARS`` smallest first nodes."""
    pairs = found.select(F.col("node").alias("a"), F.explode(F.slice(F.array_sort("firsts"), 1, STARS)).alias("b"))
    for c in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(c), F.col("print").alias(f"{c}_print")), c)
    far = sum((F.bit_count(_word("a_print", k).bitwiseXOR(_word("b_print", k))) for k in range(WORDS)), F.lit(0))
    pairs = pairs.where(far <= reach(similar, WORDS)).select("a", "b")
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_set")), c)
    common = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.where(common / (F.size("a_set") + F.size("b_set") - common) >= similar).select("a", "b")


def _dealt(inside: DataFrame, group: DataFrame, parts: Callable) -> DataFrame:
    """(cluster, node, lo, hi) of large clusters ``inside(cluster, node, n)``: each node with every part that it must meet.

    The nodes of a cluster's largest ``group`` have the parts 0 to p - 1, the loose ones p to p + q - 1. Nodes of the
    group meet the loose ones only; where none is loose, nothing is left to compare.
    """
    own = inside.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = own.groupBy("cluster", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("size", "component"))["component"].alias("main"))
    many = main.count()
    own = own.join(small(main, many), "cluster").select("cluster", "node", "n", (F.col("component") != F.col("main")).alias("loose"))
    own = checkpointed(fitted(own, inside.count()))
    count = own.groupBy("cluster").agg(*(parts(F.when(c, F.col("n"))).alias(name) for name, c in (("p", ~F.col("loose")), ("q", F.col("loose")))))
    own = own.join(small(count.where("q > 0"), many), "cluster")
    hashed = F.xxhash64("node")
    own = own.withColumn("mine", F.when(F.col("loose"), F.col("p") + F.pmod(hashed, "q")).otherwise(F.pmod(hashed, "p")))
    other = F.explode(F.sequence(F.when(F.col("loose"), F.lit(0).cast("long")).otherwise(F.col("p")), F.col("p") + F.col("q") - 1))
    return own.withColumn("other", other).select("cluster", "node", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))


def _word(column: str, k: int):
    """The k-th word of a fingerprint."""
    return F.conv(F.hex(F.substring(column, 8 * k + 1, 8)), 16, -10).cast("long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, rows without an id last, and of
    equal ids that of the smallest row key. Each row is judged by its own text, whatever its id."""
    found = similar_sets(docs, id_col, text_col, **options)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))["row"].alias("first"), F.count("*").alias("n"))
    rows = docs.count()
    inside = checkpointed(fitted(found.join(first.where("n > 1"), "component").select("row", (F.col("row") != F.col("first")).alias("gone")), rows))
    gone = inside.where("gone").select(F.col("row").alias("_row")).distinct()
    again = inside.where("not gone").groupBy(F.col("row").alias("_row")).agg(F.count("*").alias("n")).where("n > 1").select("_row")
    # rows that stay and have no equal stay where they are; only the others, and few taken for them, meet in a shuffle
    near, rest = sifted(docs.withColumn("_row", row_key(docs)), F.col("_row"), fitted(gone.union(again), rows))
    return near.join(gone, "_row", "left_anti").dropDuplicates(["_row"]).select(*docs.columns).union(rest.select(*docs.columns))
