"""Training of the detector: a chosen vocabulary of character n-grams, all features, early stopping, and a search that never sees the test part."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decode import let
from ..functions.features import densest_window, entropy, text_features
from ..functions.normalize import decode_features, normalize_fields
from . import curate, learn, metrics

#: n-grams of the vocabulary at most, rows that must hold one, shortest and longest.
VOCABULARY, LEAST_ROWS, SHORTEST, LONGEST = 140_000, 2, 2, 5
#: Sampling policies and class weights that the search goes through.
POLICIES = ["all", "cap_8000", "cap_6000", "cap_5000", "cap_4000", "cap_3000", "sqrt", "log"]
MODES = ["ratio", "sqrt_ratio"]


def model_text(payload: Column, restored: Column) -> Column:
    """What the text model reads: the value as it came and what it restores to."""
    return F.concat_ws(" __normalized__ ", F.coalesce(payload, F.lit("")), F.coalesce(restored, F.lit("")))


def chosen_payload(obfuscated: Column, payload: Column) -> Column:
    return F.coalesce(F.nullif(obfuscated, F.lit("")), payload, F.lit(""))


def eligible(level: Column, allowed: Column, payload: Column, duplicate: Column | None = None) -> Column:
    """Whether a record may train the field model: a field, allowed, not empty, 8,192 characters at most, and no known duplicate."""
    fits = (level == "field") & F.coalesce(allowed, F.lit(False)) & F.length(payload).between(1, 8192)
    return F.coalesce(fits if duplicate is None else fits & ~F.coalesce(duplicate, F.lit(False)), F.lit(False))


def gram_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, gram, n): how often each n-gram stands in the texts of an id. They are counted inside a row: neither shuffled nor held by a task."""
    return _grams(df, id_col, text_col).select("id", F.inline(_counted(F.col("grams"))))


def _grams(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, times, grams): the rows of each id and the n-grams of their texts. Of these only the texts are shuffled."""
    texts = df.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("times"), F.collect_list(text_col).alias("texts"))
    return texts.select("id", "times", F.flatten(F.transform("texts", lambda t: learn.char_ngrams(t, SHORTEST, LONGEST))).alias("grams"))


def _counted(grams: Column) -> Column:
    """array<struct(gram, n)> of the different elements of an array, by the runs of the sorted one; null for an empty one."""

    def runs(held: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: (i == 0) | (F.get(held, i) != F.get(held, i - 1)))
        length = lambda at, i, k: F.coalesce(F.get(at, k + 1), F.size(held)) - i
        return let(begins, lambda at: F.transform(at, lambda i, k: F.struct(F.get(held, i).alias("gram"), length(at, i, k).cast("long").alias("n"))))

    return F.when(F.size(grams) > 0, let(F.sort_array(grams), runs))


def vocabulary(counts: DataFrame, rows: int, most: int = VOCABULARY, least: int = LEAST_ROWS) -> DataFrame:
    """(gram, at, idf): the ``most`` commonest n-grams that ``least`` rows hold, numbered; the smoothed weight of each.

    No hashing: two n-grams never share a column. What is sorted and numbered in one task is the vocabulary itself, whose size is bounded.
    """
    totals = counts.groupBy("gram").agg(F.sum("n").alias("total"), F.count("*").alias("documents")).where(F.col("documents") >= least)
    chosen = totals.orderBy(F.desc("total"), "gram").limit(most)
    at = F.row_number().over(Window.orderBy(F.desc("total"), "gram")) - 1
    return chosen.select("gram", at.alias("at"), (F.log((1 + F.lit(rows)) / (1 + F.col("documents"))) + 1).alias("idf"))


def weighed_texts(counts: DataFrame, words: DataFrame, size: int, ids: DataFrame) -> DataFrame:
    """(id, x): rows as sparse vectors of length 1 of (1 + ln n) * idf over the vocabulary; rows of ``ids`` without any of it are empty vectors."""
    found = counts.join(F.broadcast(words), "gram").select("id", "at", ((1 + F.log("n")) * F.col("idf")).alias("w"))  # the vocabulary's bound
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("cells"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vector = F.udf(lambda at, w: Vectors.sparse(size, at or [], w or []), VectorUDT())
    both = ids.select("id").join(lists, "id", "left").withColumn("w", F.transform("cells", lambda c: c["w"] / F.col("norm")))
    return both.select("id", vector(F.col("cells.at"), F.col("w")).alias("x"))


def text_vectors(df: DataFrame, id_col: str, text_col: str, words: DataFrame, size: int) -> DataFrame:
    """(id, x) for every row of ``df``: ``weighed_texts`` straight from the texts. A row's n-grams are looked up and weighed inside it, in the
    vocabulary, whose size is bounded and which goes through the driver."""
    known = words.select("gram", "idf").orderBy("at").collect()
    idf = np.array([r["idf"] for r in known])
    grams = _grams(df, id_col, text_col).withColumn("grams", F.when(F.col("id").isNotNull() & F.lit(bool(known)), F.col("grams")).otherwise(F.array().cast("array<string>")))
    counted = CountVectorizerModel.from_vocabulary([r["gram"] for r in known] or [""], inputCol="grams", outputCol="n").transform(grams)

    def weighed(n):
        w = (1 + np.log(n.values)) * idf[n.indices] if n.indices.size else n.values
        return Vectors.sparse(size, n.indices, w / np.sqrt(w @ w) if w.size else w)

    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return counted.select("id", F.udf(weighed, VectorUDT())("n").alias("x"), each.alias("_time")).drop("_time")


def all_features(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """``df`` with the 38 features of a text: counts and ratios, entropies, the densest window, and how it decodes. Their names too."""
    value = F.coalesce(F.col(text_col), F.lit(""))
    done = normalize_fields(df.withColumn("_value", value), "_value", None)
    made = text_features(F.col("_value")) | {"keyword_density": densest_window(F.col("_value"))} | decode_features(F.col("_value"), F.col("restored"), F.col("meta"))
    plain = done.select(F.col(id_col), *(F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)).alias(k) for k, c in made.items()))
    chars = F.filter(F.split(value, ""), lambda x: x != "")
    tokens = F.filter(F.split(value, r"""[\s'"<>()\[\]{},;:]+"""), lambda x: x != "")
    names = [*made, "shannon_entropy", "token_entropy"]
    for parts, name in ((chars, "shannon_entropy"), (tokens, "token_entropy")):
        plain = plain.join(entropy(df, id_col, parts, name), id_col, "left")
    return df.join(plain.fillna(0.0, names), id_col), names


def boosted_trees(train: DataFrame, names: list[str], held: str, weight: float, trees: int = 60) -> PipelineModel:
    """Boosted trees; rows marked by ``held`` don't train but stop the growth once they no longer gain. ``weight`` is that of a positive row."""
    rows = VectorAssembler(inputCols=names, outputCol="v").transform(train).withColumn("_w", F.when(F.col("label") == 1, float(weight)).otherwise(1.0))
    gbt = GBTClassifier(featuresCol="v", labelCol="label", weightCol="_w", maxIter=trees, maxDepth=4, stepSize=0.2, seed=42, validationIndicatorCol=held, validationTol=0.005)
    return PipelineModel([VectorAssembler(inputCols=names, outputCol="v"), gbt.setProbabilityCol("p").setRawPredictionCol("raw").setPredictionCol("hat").fit(rows)])


def logistic_model(train: DataFrame, c: float) -> PipelineModel:
    n = train.count()
    lr = LogisticRegression(featuresCol="x", labelCol="label", regParam=1.0 / (c * max(n, 1)), maxIter=60, probabilityCol="p", rawPredictionCol="raw", predictionCol="hat")
    return PipelineModel([lr.fit(train)])


@dataclass
class Detector:
    """Both models, the weight of the text model's score in the fused one, and what was measured on the validation part (and, once, on the test part)."""

    text: PipelineModel
    features: PipelineModel
    names: list[str]
    weight: float
    threshold: float
    trees: int
    policy: str = "all"
    mode: str = "ratio"
    validation: dict = field(default_factory=dict)
    test: dict = field(default_factory=dict)

    def scored(self, prepared: DataFrame) -> DataFrame:
        """(id, label, kind, hard, features, text, fused) of prepared rows."""
        both = learn.scored(self.features, learn.scored(self.text, prepared, "_by_text"), "_by_features")
        return both.select("id", "label", "kind", "hard", F.col("_by_features").alias("features"), F.col("_by_text").alias("text"), F.round((1 - self.weight) * F.col("_by_features") + self.weight * F.col("_by_text"), 9).alias("fused"))

    def judged(self, prepared: DataFrame) -> dict:
        return metrics.confusion(self.scored(prepared), F.col("label") == 1, F.col("fused") >= self.threshold).first().asDict()


@dataclass
class Prepared:
    """Rows with both inputs of the models, one frame a part."""

    parts: dict[str, DataFrame]
    names: list[str]
    words: int


def prepare(rows: DataFrame, most: int = VOCABULARY) -> Prepared:
    """``rows(id, text, label, split, kind, hard)`` with features and vectors. The vocabulary and its weights come from the training part alone."""
    text = rows.select("id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("double").alias("label"), "split", "kind", "hard").persist()
    featured, names = all_features(text, "id", "text")
    counts = gram_counts(text, "id", "text").persist()
    inside = text.where("split = 'train'")
    words = vocabulary(counts.join(inside.select("id"), "id", "left_semi"), inside.count(), most).persist()
    size = words.count()
    both = featured.join(weighed_texts(counts, words, max(size, 1), text), "id").drop("text").persist()
    parts = {p: both.where(F.col("split") == p).drop("split") for p in ("train", "validation", "test")}
    both.count()
    for used in (text, counts, words):
        used.unpersist()
    return Prepared(parts, names, size)


def _fitted(train: DataFrame, validation: DataFrame, names: list[str], c: float, mode: str, least_recall: float, most_fpr: float, text: PipelineModel | None = None) -> tuple[Detector, PipelineModel]:
    n = train.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    ratio = n["n"] / max(n["p"], 1)
    text = text or logistic_model(train, c)
    both = train.withColumn("held", F.lit(False)).unionByName(validation.withColumn("held", F.lit(True)))
    trees = boosted_trees(both, names, "held", ratio if mode == "ratio" else ratio**0.5)
    found = Detector(text, trees, names, 0.7, 0.5, trees.stages[1].getNumTrees, mode=mode)
    scored = found.scored(validation).persist()
    point = metrics.robust_point(scored, least_recall, most_fpr).first() or metrics.grid_point(scored, least_recall, most_fpr).first()
    if point:
        found.weight, found.threshold = float(point["weight"]), float(point["threshold"])
        found.validation = point.asDict()
    scored.unpersist()
    return found, text


def train(rows: DataFrame, c: float = 6.0, least_recall: float = 0.95, most_fpr: float = 0.001, most: int = VOCABULARY) -> Detector:
    """Trains on the part ``train``, stops and chooses the operating point on ``validation``, and measures ``test`` once at the end.

    ``rows(id, text, label, split, kind, hard)``: kind is the class of a positive row for the macro recall, hard marks positives whose recall
    counts on its own. Where no point keeps both bounds, the one that breaks them least is taken.
    """
    ready = prepare(rows, most)
    found, _ = _fitted(ready.parts["train"], ready.parts["validation"], ready.names, c, "ratio", least_recall, most_fpr)
    found.test = found.judged(ready.parts["test"])
    return found


def search(train: DataFrame, validation: DataFrame, names: list[str], policies: list[str] = POLICIES, modes: list[str] = MODES, rare: int = 2000, c: float = 2.0, least_recall: float = 0.95, most_fpr: float = 0.001) -> tuple[Detector, list[dict]]:
    """The best of all policies and class weights on prepared rows, and what each reached. It isn't given the test part.

    ``kind`` names the class that a policy caps; normal rows all stay. Better is the higher composite among points that keep the bounds, then the
    smaller violation.
    """
    best, reached = None, []
    for policy in policies:
        caps = train.where("label = 1").groupBy("kind").agg(F.count("*").alias("_n")).withColumn("_cap", curate.class_cap(F.col("_n"), policy, rare))
        order = Window.partitionBy("kind").orderBy(F.sha2(F.concat(F.lit("42|"), F.col("id").cast("string")), 256))
        positives = train.where("label = 1").join(F.broadcast(caps.select("kind", "_cap")), "kind").withColumn("_r", F.row_number().over(order)).where("_r <= _cap").drop("_r", "_cap")  # a row a class
        sampled = train.where("label = 0").unionByName(positives).persist()
        text = None
        for mode in modes:
            found, text = _fitted(sampled, validation, names, c, mode, least_recall, most_fpr, text)
            found.policy = policy
            rank = (found.validation.get("composite") or -1.0, -(found.validation.get("violation") or 0.0))
            reached.append({"policy": policy, "mode": mode, "weight": found.weight, "threshold": found.threshold, "composite": rank[0], "violation": -rank[1], "trees": found.trees})
            if best is None or rank > best[0]:
                best = (rank, found)
        sampled.unpersist()
    return best[1], reached
