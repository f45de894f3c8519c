"""Text and feature models with Spark ML: character n-grams, logistic regression, boosted trees, evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import let
from ..functions.features import text_features
from . import metrics


def char_ngrams(text: Column, least: int = 2, most: int = 5) -> Column:
    """All n-grams of the lower-cased characters, repeats included, white space squeezed."""
    chars = F.filter(F.split(F.lower(F.regexp_replace(text, r"\s+", " ")), ""), lambda x: x != "")

    def grams(held: Column, n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(held) - n), lambda i: F.concat(*(F.get(held, i + k) for k in range(n))))
        return F.when(F.size(held) >= n, cut).otherwise(F.array().cast("array<string>"))

    return let(chars, lambda held: F.concat(*(grams(held, n) for n in range(least, most + 1))))  # the characters are cut once


def ngram_frequencies(df: DataFrame, text_col: str, n: int, least: int = 2) -> DataFrame:
    """(gram, documents): in how many rows an n-gram is, from ``least`` rows on."""
    grams = F.explode(F.array_distinct(char_ngrams(F.col(text_col), n, n))).alias("gram")
    return df.select(grams).groupBy("gram").agg(F.count("*").alias("documents")).where(F.col("documents") >= least)


def text_model(train: DataFrame, label: str, c: float = 6.0, width: int = 1 << 18) -> PipelineModel:
    """Logistic regression on weighted n-grams (column ``grams``), hashed to ``width`` columns, rows at length 1."""
    n = train.count()
    stages = [
        HashingTF(inputCol="grams", outputCol="tf", numFeatures=width), IDF(inputCol="tf", outputCol="tfidf", minDocFreq=2), Normalizer(inputCol="tfidf", outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol=label, regParam=1.0 / (c * max(n, 1)), maxIter=30, probabilityCol="p", rawPredictionCol="raw", predictionCol="hat"),
    ]
    return Pipeline(stages=stages).fit(train)


FEATURES = [
    "payload_byte_len", "digit_ratio", "alpha_ratio", "special_char_ratio", "upper_lower_ratio", "whitespace_ratio", "non_printable_ratio", "max_token_len", "sql_keyword_hits",
    "xss_keyword_hits", "cmdi_keyword_hits", "path_traversal_hits", "balanced_quote_ratio", "balanced_paren_ratio", "ip_addr_hits",
]


def with_features(df: DataFrame, text_col: str) -> DataFrame:
    made = text_features(F.col(text_col))
    return df.select("*", *(F.coalesce(F.nanvl(made[k].cast("double"), F.lit(0.0)), F.lit(0.0)).alias(k) for k in FEATURES))


def feature_model(train: DataFrame, label: str, held: str | None = None, trees: int = 20) -> PipelineModel:
    """Boosted trees on the counting features, classes weighing the same; ``held`` marks rows that stop the growth early."""
    share = train.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    weighed = train.withColumn("_w", F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    gbt = GBTClassifier(featuresCol="v", labelCol=label, weightCol="_w", maxIter=trees, maxDepth=4, seed=42, **({"validationIndicatorCol": held} if held else {}))
    gbt.setProbabilityCol("p").setRawPredictionCol("raw").setPredictionCol("hat")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="v"), gbt]).fit(weighed)


def scored(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """``df`` with the probability of class 1."""
    return model.transform(df).withColumn(name, vector_to_array("p")[1]).select(*df.columns, name)


def evaluate(df: DataFrame, label: str, scores: dict[str, str], threshold: float = 0.5) -> DataFrame:
    """Metrics of each score column at a threshold, a row each."""
    return metrics.by_system(df, F.col(label) == 1, {k: F.col(c) >= threshold for k, c in scores.items()})
