"""Merkle manifest of a data set, with proofs by a butterfly exchange.

Each group of rows is a binary tree over its leaves in order. The leaves are dealt in aligned blocks of 2^bits; a task hashes
the subtree of its block and so knows the lower part of every proof. Blocks then meet in pairs whose numbers differ in one bit, a higher
one each round: both sides hand over the root they have reached and both hash the common ancestor. After the last round
every block has the root and the upper part of its proofs, and nothing is sent down again. A second tree over the groups' roots is made in
the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_runs, checkpointed, small

#: Leaves of a block, as powers of two: at least, at most, and how many blocks there are to be about (as a power) between the two.
LEAST, MOST, BLOCKS = 8, 16, 12
#: Rounds of the exchange after which the lineage is cut.
CUT = 6


def framed(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text: no two lists of values give the same text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*(framed(c) for c in columns)), 256)


def fold(node: Column, pos: Column, siblings: Column) -> Column:
    """The root that a node at ``pos`` leads to; ``siblings`` level by level, an empty string where a node has none."""
    joined = lambda up, s: F.sha2(F.when(up["pos"] % 2 == 1, F.concat(s, up["node"])).otherwise(F.concat(up["node"], s)), 256)
    start = F.struct(node.alias("node"), pos.cast("long").alias("pos"))
    return F.aggregate(siblings, start, lambda up, s: F.struct(joined(up, s).alias("node"), F.shiftright(up["pos"], 1).alias("pos")))["node"]


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows(tree, ...)`` with ``pos``, the place in the tree by ``order``; and (tree, n).

    One range partitioning sorts all trees together, so a tree may span any number of tasks. Places are row numbers of the
    partition plus what the partitions before hold, less where the tree begins: only counts by partition meet in one place.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = checkpointed(dealt.withColumn("at", F.monotonically_increasing_id()))
    split = dealt.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(2**33 - 1))
    counts = split.groupBy("part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part")) - F.col("rows")
    parts = checkpointed(counts.select("part", before.alias("before")))
    split = split.join(small(parts, parts.count()), "part").withColumn("at", F.col("at") + F.col("before"))
    trees = checkpointed(split.groupBy("tree").agg(F.min("at").alias("begin"), F.count("*").alias("n")))
    placed = split.join(small(trees.select("tree", "begin", F.col("n").alias("tree_rows")), trees.count()), "tree")
    return placed.withColumn("pos", F.col("at") - F.col("begin")).drop("part", "at", "before", "begin"), trees.select("tree", "n")


def subtrees(frames: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Rows by (tree, block, pos) -> with the siblings inside the block and, at a block's first row, the root of the block."""
    for rows in by_runs(frames, ["tree", "block"]):
        rows = rows.reset_index(drop=True)
        low: list[list[str]] = [[] for _ in range(len(rows))]
        tops: list[str | None] = [None] * len(rows)
        for at in rows.groupby(["tree", "block"], sort=False).indices.values():
            nodes = rows["node"].iloc[at].to_list()
            n = int(rows["tree_rows"].iloc[at[0]])
            for level in range(min(bits, (n - 1).bit_length())):
                for k, row in enumerate(at):
                    other = (k >> level) ^ 1
                    low[row].append(nodes[other] if other < len(nodes) else "")
                nodes = [sha256("".join(nodes[k : k + 2]).encode()).hexdigest() for k in range(0, len(nodes), 2)]
            tops[at[0]] = nodes[0]
        yield rows.drop(columns=["tree_rows"]).assign(low=low, top=tops)


def exchanged(blocks: DataFrame) -> DataFrame:
    """(tree, block, node, high) of ``blocks(tree, block, node)``: the root and the siblings above every block.

    Round r pairs the blocks whose numbers differ in bit r alone; both get the other's node and hash the ancestor. Trees are padded with
    empty blocks up to a power of two, so that every pair is complete (an ancestor of nothing is nothing): a round is one
    grouping of two rows a key, whatever the shape of the tree.
    """
    trees = checkpointed(blocks.groupBy("tree").agg((F.max("block") + 1).alias("blocks")))
    rounds = F.when(F.col("blocks") > 1, F.length(F.bin(F.col("blocks") - 1))).otherwise(0)
    trees = trees.withColumn("rounds", rounds)
    many = trees.count()
    most = trees.agg(F.max("rounds")).first()[0] or 0
    full = F.expr("1L << rounds")
    empty = trees.where(F.col("blocks") < full).select("tree", F.explode(F.sequence(F.col("blocks"), full - 1)).alias("block"), F.lit(None).cast("string").alias("node"))
    state = blocks.select("tree", "block", "node").union(empty).join(small(trees, many), "tree").withColumn("high", F.array().cast("array<string>"))
    for r in range(most):
        bit = 1 << r
        live = F.col("rounds") > r
        upper = live & (F.col("block").bitwiseAND(bit) != 0)
        pair = F.when(upper, F.col("block") - bit).otherwise(F.col("block"))
        held = F.struct("block", "node", "high")
        met = state.groupBy("tree", "rounds", "blocks", pair.alias("pair")).agg(F.max(F.when(~upper, held)).alias("lo"), F.max(F.when(upper, held)).alias("hi"))
        other = lambda side: F.when(live, F.array(F.coalesce(F.col(f"{side}.node"), F.lit("")))).otherwise(F.array())
        node = F.when(live, F.sha2(F.concat("lo.node", F.coalesce("hi.node", F.lit(""))), 256)).otherwise(F.col("lo.node"))
        sides = [F.when(F.col(a).isNotNull(), F.struct(F.col(f"{a}.block").alias("block"), F.concat(f"{a}.high", other(b)).alias("high"))) for a, b in (("lo", "hi"), ("hi", "lo"))]
        met = met.select("tree", "rounds", "blocks", node.alias("node"), F.explode(F.array_compact(F.array(*sides))).alias("side"))
        state = met.select("tree", F.col("side.block").alias("block"), "node", "rounds", "blocks", F.col("side.high").alias("high"))
        if r % CUT == CUT - 1:
            state = checkpointed(state)
    return state.where(F.col("block") < F.col("blocks")).select("tree", "block", "node", "high")


def forest(rows: DataFrame, order: list[str], bits: int | None = None) -> DataFrame:
    """``rows(tree, node, ...)`` with ``pos``, ``siblings`` (array<string>) and ``root`` of each row's tree.

    ``tree`` and ``node`` are strings, not null; leaves of a tree stand by ``order``.
    """
    placed, trees = numbered(rows, order)
    n = trees.agg(F.sum("n")).first()[0] or 0
    if bits is None:
        bits = min(MOST, max(LEAST, math.ceil(math.log2(max(n, 1))) - BLOCKS))
    placed = placed.withColumn("block", F.shiftright("pos", bits))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.drop("tree_rows").schema)
    dealt = placed.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    done = checkpointed(dealt.mapInPandas(lambda frames: subtrees(frames, bits), f"{out}, low array<string>, top string"))
    tops = checkpointed(exchanged(done.where(F.col("top").isNotNull()).select("tree", "block", F.col("top").alias("node"))))
    joined = done.drop("top").join(small(tops.select("tree", "block", F.col("node").alias("root"), "high"), tops.count()), ["tree", "block"])
    return joined.withColumn("siblings", F.concat("low", "high")).drop("low", "high", "block")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), carry: dict[str, Column] | None = None, bits: int | None = None) -> DataFrame:
    """(id_col, *carry, leaf, pos, siblings, subroot, group_pos, group_siblings, root) for every row of ``docs``.

    A row's leaf is the hash of ``columns``; rows of a group stand by id (null first), rows of equal id by leaf; groups stand by name (null first,
    bytewise). Null values have a mark of their own, so they differ from empty ones. Equal rows are leaves of their own with
    equal hashes. One group or one row is its own root, and an empty table has no rows and no root. ``carry`` columns are taken along
    under their names; other columns don't matter, whatever their names.

    Only ids, hashes and what is carried are shuffled, never texts. ``verify`` folds a leaf up again.
    """
    carried = {f"carry_{k}": c for k, c in (carry or {}).items()}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf(*(F.col(c) for c in columns)).alias("node"), *(c.alias(k) for k, c in carried.items()))
    placed = checkpointed(forest(rows, ["id", "node"], bits))
    subroots = placed.groupBy("tree").agg(F.first("root").alias("node")).select(F.lit("").alias("tree"), F.col("tree").alias("group"), "node")
    upper = checkpointed(forest(subroots, ["group"], bits).select("group", "node", F.col("pos").alias("group_pos"), F.col("siblings").alias("group_siblings"), "root"))
    joined = placed.drop("root").withColumnRenamed("node", "leaf").join(small(upper.withColumnRenamed("node", "subroot").withColumnRenamed("group", "tree"), upper.count()), "tree")
    return joined.select(F.col("id").alias(id_col), *(F.col(k).alias(k.removeprefix("carry_")) for k in carried), "leaf", "pos", "siblings", "subroot", "group_pos", "group_siblings", "root")


def verify(node: Column) -> Column:
    """The root that a leaf leads to by a row of ``manifest``."""
    return fold(fold(node, F.col("pos"), F.col("siblings")), F.col("group_pos"), F.col("group_siblings"))


def proof_hash() -> Column:
    """The hash of all siblings of a row of ``manifest``, from the leaf up to the root."""
    return F.sha2(F.concat(F.array_join("siblings", ""), F.array_join("group_siblings", "")), 256)


def audited(docs: DataFrame, tampered: Column, altered: dict[str, Column], **options) -> DataFrame:
    """``manifest`` with ``folded_root`` and ``verified``: rows where ``tampered`` holds are folded from the hash of their ``altered`` columns."""
    names = options.get("columns", ("doc_id", "source", "lang", "n_chars", "text"))
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf(*(altered.get(c, F.col(c)) for c in names)))
    rows = manifest(docs, carry={"altered": other}, **options)
    rows = rows.withColumn("folded_root", verify(F.coalesce("altered", "leaf")))
    return rows.withColumn("proof_sha256", proof_hash()).withColumn("verified", F.col("folded_root") == F.col("root")).drop("altered")
