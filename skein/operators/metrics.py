"""Detector metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(df: DataFrame, label: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall, F1 and false-positive rate, in groups if asked for. Empty denominators count as 1."""
    cells = {"tp": predicted & label, "fp": predicted & ~label, "fn": ~predicted & label, "tn": ~predicted & ~label}
    counts = df.groupBy(*(by or [])).agg(*(F.count_if(v).alias(k) for k, v in cells.items()))
    over = lambda a, b: a / F.greatest(b, F.lit(1))
    p, r = over(F.col("tp"), F.col("tp") + F.col("fp")), over(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(over(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"), F.round(over(F.col("fp"), F.col("fp") + F.col("tn")), 6).alias("fpr"))


def running(df: DataFrame, by: list[str], score: str, sums: list[str]) -> DataFrame:
    """``df`` with every column of ``sums`` replaced by its running sum within ``by``, from the highest score down.

    In two steps, so that no task holds a whole group: sums over ranges of scores 1/1024 wide first, then the order within
    each range. One row per score and group is expected.
    """
    cut = F.floor(F.col(score) * 1024)
    parts = df.withColumn("_cut", cut)
    down = Window.partitionBy(*by).orderBy(F.desc("_cut")).rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy(*by, "_cut").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    before = before.select(*by, "_cut", *(F.coalesce(F.sum(f"_t_{c}").over(down), F.lit(0)).alias(f"_b_{c}") for c in sums))
    inside = Window.partitionBy(*by, "_cut").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    both = parts.join(before, [*by, "_cut"])
    return both.select(*(((F.sum(c).over(inside) + F.col(f"_b_{c}")).alias(c)) if c in sums else F.col(c) for c in df.columns))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC AUC by average ranks, from counts per distinct score."""
    counts = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    ranked = running(counts.withColumn("above", F.col("p")), [], score, ["above"])
    pairs = ranked.select("p", "n", (F.col("n") * (F.col("above") - F.col("p") / 2)).alias("won"))
    return pairs.agg(F.round(F.sum("won") / (F.sum("p") * F.sum("n")), 6).alias("auc"))


def operating_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """True and false positives at every distinct score as the threshold: counts first, then a running sum."""
    counts = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("tp"), F.count_if(F.col(label) == 0).alias("fp"))
    return running(counts, [], score, ["tp", "fp"]).withColumnRenamed(score, "threshold")


def nearest_rank(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """(by, value): the value at the index nearest to ``share`` of each group, halves to even; from counts per value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    upto = running(counts.withColumn("_s", -F.col(value)), by, "_s", ["n"]).join(total, by)
    at = F.bround((F.col("_all") - 1) * share) + 1
    return upto.where(F.col("n") >= at).groupBy(*by).agg(F.round(F.min(value), 3).alias(value))


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, *shares): interpolated percentiles of each group, from counts per distinct value: no task holds the values of a whole group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    upto = running(counts.withColumn("_s", -F.col(value)), by, "_s", ["n"]).join(total, by)
    at = {k: (F.col("_all") - 1) * share for k, share in shares.items()}
    least = lambda rank: F.min(F.when(F.col("n") >= rank + 1, F.col(value)))
    ends = [c for k, r in at.items() for c in (least(F.floor(r)).alias(f"_lo_{k}"), least(F.ceil(r)).alias(f"_hi_{k}"))]
    both = upto.groupBy(*by, "_all").agg(*ends)
    return both.select(*by, *((F.col(f"_lo_{k}") + (r - F.floor(r)) * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))).alias(k) for k, r in at.items()))


def weights(first: float, last: float, n: int = 17) -> list[float]:
    return [round(first + (last - first) * k / (n - 1), 6) for k in range(n)]


def _fused(df: DataFrame, grid: list[float]) -> DataFrame:
    """A row per row and weight of the text score: the fused score, counted per distinct value afterwards."""
    each = F.explode(F.array(*map(F.lit, grid))).alias("weight")
    return df.select("*", each).withColumn("score", F.round((1 - F.col("weight")) * F.col("features") + F.col("weight") * F.col("text"), 9))


def grid_point(df: DataFrame, least_recall: float, most_fpr: float) -> DataFrame:
    """Weight and threshold of a grid (17 x 981) for ``df(label, features, text)``: the best F1 among those that satisfy recall
    and false-positive rate, else the least violation; then recall, rate, precision, higher threshold, lower weight.

    Scores fall into the grid's cells, counted before the shuffle: at most 982 rows per weight move.
    """
    cell = F.least(F.floor(F.round((F.col("score") - 0.01) * 1000, 6)), F.lit(980))
    cells = _fused(df, weights(0.6, 1.0)).withColumn("cell", cell).groupBy("weight", "cell").agg(F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("fp"))
    down = Window.partitionBy("weight").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("weight")
    points = cells.select("weight", "cell", F.sum("tp").over(down).alias("tp"), F.sum("fp").over(down).alias("fp"), F.sum("tp").over(whole).alias("p"), F.sum("fp").over(whole).alias("n"))
    over = lambda a, b: a / F.greatest(b, F.lit(1))
    points = points.where("cell >= 0").select("weight", F.round(F.col("cell") / 1000 + 0.01, 3).alias("threshold"), F.round(over(F.col("tp"), F.col("p")), 9).alias("recall"), F.round(over(F.col("fp"), F.col("n")), 9).alias("fpr"), F.round(over(F.col("tp"), F.col("tp") + F.col("fp")), 9).alias("precision"), F.round(over(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")), 9).alias("f1"))
    off = F.round(F.greatest(F.lit(0.0), least_recall - F.col("recall")) + F.greatest(F.lit(0.0), F.col("fpr") - most_fpr), 9)
    return points.withColumn("violation", off).orderBy("violation", F.desc("f1"), F.desc("recall"), "fpr", F.desc("precision"), F.desc("threshold"), "weight").limit(1)


def robust_point(df: DataFrame, least_recall: float, most_fpr: float, grid: list[float] | None = None) -> DataFrame:
    """Weight and threshold among all distinct scores for ``df(label, features, text, kind, hard)``: the best of 0.45 F1 +
    0.35 macro recall over kinds + 0.20 recall of hard positives, subject to recall and false-positive rate. ``grid`` of one
    weight judges a single model."""
    ones = F.col("label") == 1
    totals = df.where(ones).groupBy("kind").agg(F.count("*").alias("_k"))
    whole = df.agg(F.count_if(ones).alias("p"), F.count_if(~ones).alias("n"), F.count_if(ones & F.col("hard")).alias("h"), F.count_distinct(F.when(ones, F.col("kind"))).alias("kinds"))
    rows = _fused(df.join(totals, "kind", "left"), grid or weights(0.5, 0.9))
    counts = rows.groupBy("weight", "score").agg(F.count_if(ones).alias("tp"), F.count_if(~ones).alias("fp"), F.count_if(ones & F.col("hard")).alias("ht"), F.coalesce(F.sum(F.when(ones, 1 / F.col("_k"))), F.lit(0.0)).alias("m"))
    points = running(counts, ["weight"], "score", ["tp", "fp", "ht", "m"]).crossJoin(F.broadcast(whole))  # one row
    over = lambda a, b: a / F.greatest(b, F.lit(1))
    r9 = lambda c: F.round(c, 9)
    points = points.select("weight", F.col("score").alias("threshold"), r9(over(F.col("tp"), F.col("p"))).alias("recall"), r9(over(F.col("fp"), F.col("n"))).alias("fpr"), r9(over(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p"))).alias("f1"), r9(over(F.col("m"), F.col("kinds"))).alias("macro_recall"), r9(F.when(F.col("h") > 0, F.col("ht") / F.greatest(F.col("h"), F.lit(1))).otherwise(over(F.col("tp"), F.col("p")))).alias("hard_recall"))
    points = points.where((F.col("recall") >= least_recall) & (F.col("fpr") <= most_fpr))
    points = points.withColumn("composite", F.round(0.45 * F.col("f1") + 0.35 * F.col("macro_recall") + 0.20 * F.col("hard_recall"), 8))
    return points.orderBy(F.desc("composite"), F.desc("macro_recall"), F.desc("hard_recall"), F.desc("f1"), "fpr", F.desc("threshold"), "weight").limit(1)


def by_system(df: DataFrame, label: Column, systems: dict[str, Column]) -> DataFrame:
    """Metrics of several systems' predictions on the same rows, a row each."""
    rows = df.select(label.alias("_y"), F.inline(F.array(*(F.struct(F.lit(k).alias("system"), p.alias("_p")) for k, p in systems.items()))))
    return confusion(rows, F.col("_y"), F.col("_p"), ["system"])


def outperformers(report: DataFrame, base: str) -> DataFrame:
    """The systems of a report (one row per system) whose F1 is above the base's, with their differences."""
    b = report.where(F.col("system") == base).select(F.col("f1").alias("_f1"), F.col("recall").alias("_r"), F.col("fpr").alias("_p"))
    both = report.crossJoin(F.broadcast(b)).where(F.col("f1") > F.col("_f1") + 1e-12)  # one row
    diff = lambda a, c: F.round(F.col(a) - F.col(c), 6)
    return both.select("system", diff("f1", "_f1").alias("f1_delta"), diff("recall", "_r").alias("recall_delta"), diff("fpr", "_p").alias("fpr_delta"))


def best_point(points: DataFrame, positives: int, negatives: int, least_recall: float, most_fpr: float) -> DataFrame:
    """The feasible threshold of best F1; then recall, lower false-positive rate, higher threshold."""
    r, f = F.col("tp") / max(positives, 1), F.col("fp") / max(negatives, 1)
    f1 = 2 * F.col("tp") / F.greatest(F.col("tp") + F.col("fp") + positives, F.lit(1))
    scored = points.select("threshold", "tp", "fp", r.alias("recall"), f.alias("fpr"), f1.alias("f1"))
    return scored.where((F.col("recall") >= least_recall) & (F.col("fpr") <= most_fpr)).orderBy(F.desc("f1"), F.desc("recall"), "fpr", F.desc("threshold")).limit(1)
