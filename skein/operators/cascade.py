"""Field verdicts: context, signatures on the raw and the restored value, and model scores where there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gates
from ..functions import patterns as P
from ..functions.normalize import normalize_fields
from ..functions.rule_index import RuleIndex, read_rules, rule_hits

LOW, HIGH = 0.05, 0.5


# Names whose values are never benign at sight, literals and shapes that are.
WARY_NAMES = ["url", "uri", "redirect", "redirect_url", "return", "return_url", "next", "continue", "callback", "file", "path", "template", "cmd", "command", "exec", "query", "sql", "xml", "filename", "upload", "log", "message"]
PLAIN_VALUES = ["true", "false", "null", "none", "asc", "desc", "zh-cn", "en-us"]
PLAIN_NUMBER = r"(?U)^[+-]?\d+(?:\.\d+)?\z"
PLAIN_TEXT = r"^[\p{L}\p{N}_\-.\u3400-\u9fff ]{1,128}\z"
CONTROLS = "[<>'\"%\r\n`]"


def obviously_benign(name: Column, value: Column, location: Column) -> Column:
    """Numbers, literals, browser agents and short or spaced plain text, unless the name calls for a closer look."""
    v = F.regexp_replace(value, r"(?U)^\s+|\s+\z", "")
    agent = (location == "header") & F.startswith(v, F.lit("Mozilla/5.0")) & ~F.rlike(v, F.lit(CONTROLS))
    text = ~F.contains(v, F.lit("..")) & F.rlike(v, F.lit(PLAIN_TEXT)) & (F.contains(v, F.lit(" ")) | (F.length(v) <= 6))
    plain = F.lower(v).isin(PLAIN_VALUES) | F.rlike(v, F.lit(PLAIN_NUMBER)) | agent | text
    return (v != "") & (F.length(v) <= 256) & ~F.lower(name).isin(WARY_NAMES) & plain


def thresholds(location: Column, low: float = LOW, high: float = HIGH) -> tuple[Column, Column]:
    """Headers and cookies need more to be called either way."""
    strict = location.isin("header", "cookie")
    return F.when(strict, F.lit(min(low, 0.05))).otherwise(low), F.when(strict, F.lit(max(high, 0.95))).otherwise(high)


def fused(features: Column, text: Column, weight: float = 0.7) -> Column:
    """The weighted score; either alone where the other is null."""
    return F.coalesce((1 - weight) * features + weight * text, text, features)


def logistic(decision: Column) -> Column:
    return 1 / (1 + F.exp(-decision))


def detect_fields(fields: DataFrame, score: Column | None = None, low: float = LOW, high: float = HIGH, rules: DataFrame | RuleIndex | None = None) -> DataFrame:
    """Adds verdict, confidence, layer and rule_hits; the first stage that decides wins. ``score`` is a model's (or fused)
    probability of an attack; where it is null or not given, what no stage decides stays uncertain. ``rules`` (id, family, severity,
    pattern) are tried after the built-in ones, on the raw and on the restored value."""
    extra = RuleIndex(read_rules(rules)) if isinstance(rules, DataFrame) else rules
    found = lambda v: rule_hits(v) if extra is None else F.concat(rule_hits(v), extra.hits(v))
    verdict = lambda hits: P.verdict_of(hits, P.RULES if extra is None else [*P.RULES, *extra.rules])
    name, value, location, restored = F.col("name"), F.col("value"), F.col("location"), F.col("restored")
    df = normalize_fields(fields if score is None else fields.withColumn("_score", score), "value", "location")
    s = F.col("_score") if score is not None else F.lit(None).cast("double")
    df = df.withColumn("raw_hits", found(value)).withColumn("coded", gates.encoded_hits(value, location))
    df = df.withColumn("hits", found(restored)).withColumn("context", P.context_hits(name, value, location, restored))
    made = lambda v, c, layer, hits: F.struct(F.lit(v).alias("verdict"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("confidence"), F.lit(layer).alias("layer"), hits.alias("rule_hits"))
    none = F.array().cast("array<string>")
    least, most = thresholds(location, low, high)
    decided = (
        F.when(gates.may_be_safe_context(value) & gates.safe_context(name, value, location, restored), made("benign", 0.995, "L0-Context", none))
        .when(verdict(F.col("raw_hits")) == "attack", made("attack", 0.99, "L1-Raw", F.col("raw_hits")))
        .when(F.size("coded") > 0, made("attack", 0.99, "L1-Raw", F.col("coded")))
        .when(obviously_benign(name, value, location), made("benign", 0.999, "L0", none))
        .when(verdict(F.col("hits")) == "attack", made("attack", 0.99, "L1", F.col("hits")))
        .when(F.size("context") > 0, made("attack", 0.99, "L1-Context", F.col("context")))
        .when(gates.security_discussion(name, value, location, restored), made("benign", 0.995, "L0-Context", none))
        .when(s >= most, made("attack", s, "L2+Text", F.col("hits")))
        .when(s <= least, made("benign", 1 - s, "L2+Text", none))
        .when(s.isNotNull(), made("benign", F.greatest(s, 1 - s), "L2+Text", F.col("hits")))
        .otherwise(made("uncertain", 0.5, "L1", F.col("hits")))
    )
    # unpacked by a generator: a filter on the verdict then stays above it, and isn't pushed down as the whole expression
    return df.withColumn("d", decided).select(*fields.columns, F.inline(F.array("d")))


def detect_distinct(fields: DataFrame, **options) -> DataFrame:
    """As ``detect_fields``, every distinct (name, value, location) judged once and joined back: for logs that repeat."""
    keys = ["name", "value", "location"]
    judged = detect_fields(fields.select(*keys).distinct(), **options).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return fields.join(judged, same, "left").drop(*(f"_{k}" for k in keys))


def request_verdicts(detections: DataFrame, id_col: str) -> DataFrame:
    """attack if any field is, else uncertain if any is, else benign; and the counts."""
    is_ = lambda v: F.col("verdict") == v
    counts = detections.groupBy(id_col).agg(F.count("*").alias("fields"), F.count_if(is_("attack")).alias("attacks"), F.count_if(is_("uncertain")).alias("uncertain"))
    return counts.withColumn("verdict", F.when(F.col("attacks") > 0, "attack").when(F.col("uncertain") > 0, "uncertain").otherwise("benign"))


def threats(detections: DataFrame, id_col: str, hits: int = 5) -> DataFrame:
    """(id, threats): the attacks of each request with place, name, confidence, layer and the first rules."""
    one = F.struct("location", "name", "confidence", "layer", F.slice("rule_hits", 1, hits).alias("rule_hits"))
    return detections.where("verdict = 'attack'").groupBy(id_col).agg(F.array_sort(F.collect_list(one)).alias("threats"))


def outcome(attacks: Column, failed: Column, blocking: Column, fail_closed: Column) -> Column:
    """What a gateway does with a request: error, blocked, monitored_attack or forwarded."""
    return F.when(failed & fail_closed, "error").when((attacks > 0) & blocking, "blocked").when(attacks > 0, "monitored_attack").otherwise("forwarded")


def excluded(fields: DataFrame, entries: list[tuple[str, str, str]], path_col: str) -> DataFrame:
    """``fields`` without those that an allow-list names by path, place and name; the list is a parameter, not data."""
    listed = fields.sparkSession.createDataFrame(entries or [("", "", "")], "_path string, _place string, _name string")
    same = (F.col(path_col) == F.col("_path")) & (F.col("location") == F.col("_place")) & (F.lower("name") == F.col("_name"))
    return fields.join(F.broadcast(listed), same, "left_anti")
