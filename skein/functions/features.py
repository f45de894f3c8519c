"""Counting features of a text as columns; entropies by exploding and counting, so long texts need no per-row maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P


def ratio(c: Column, chars: str) -> Column:
    """The share of the characters of a class, by what is left without their runs: no match is made for each of them."""
    n = F.length(c)
    return F.when(n > 0, (n - F.length(F.regexp_replace(c, f"{chars}++", ""))) / n).otherwise(0.0)


def text_features(c: Column) -> dict[str, Column]:
    n = F.length(c)
    tokens = F.filter(F.split(c, r"""[\s'"<>()\[\]{},;:]+"""), lambda t: t != "")
    singles, doubles, opens, closes = (F.regexp_count(c, F.lit(p)) for p in ("'", '"', r"\(", r"\)"))
    flag = lambda test, w: F.when(test, w).otherwise(0.0)
    has = lambda p: P.has(c, p)
    sql_score = flag(F.contains(c, F.lit("'")), 0.2) + flag(has(r"--|#|/\*"), 0.15) + flag(has(r"\b(AND|OR|NOT)\b"), 0.2) + flag(has(P.SQL_WORDS), 0.25) + flag((opens > 0) & (closes > 0), 0.1) + flag(F.contains(c, F.lit("=")), 0.1)
    xss_score = flag(F.contains(c, F.lit("<")) & F.contains(c, F.lit(">")), 0.3) + flag(has(P.XSS_TAGS) | has(P.XSS_WORDS), 0.3) + flag(has(r"javascript\s*:"), 0.2) + flag((singles > 0) | (doubles > 0), 0.1) + flag(opens > 0, 0.1)
    return {
        "payload_byte_len": F.octet_length(c).cast("double"),
        "digit_ratio": ratio(c, r"\p{Nd}"),
        "alpha_ratio": ratio(c, r"\p{L}"),
        "special_char_ratio": ratio(c, r"""['";<>()/\\%|&`*?$!]"""),
        "upper_lower_ratio": F.regexp_count(c, F.lit(r"\p{Lu}")) / F.greatest(F.regexp_count(c, F.lit(r"\p{Ll}")), F.lit(1)),
        "url_encoded_char_ratio": F.when(n > 0, 3 * F.regexp_count(c, F.lit("%[0-9A-Fa-f]{2}")) / n).otherwise(0.0),
        "html_entity_count": F.regexp_count(c, F.lit("&#?[a-zA-Z0-9]+;")).cast("double"),
        "comment_pattern_count": P.times(c, r"/\*|--|#|<!--").cast("double"),
        "max_token_len": F.coalesce(F.array_max(F.transform(tokens, lambda t: F.length(t))), F.lit(0)).cast("double"),
        "whitespace_ratio": ratio(c, r"[ \t\n\r]"),
        "non_printable_ratio": ratio(c, r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ \n\r\t]]"),
        "sql_keyword_hits": (P.times(c, P.SQL_WORDS, first="ABCDEFGHILOSUW") + P.times(c, P.SQL_FUNCTIONS)).cast("double"),
        "xss_keyword_hits": (P.times(c, P.XSS_WORDS) + P.times(c, P.XSS_TAGS)).cast("double"),
        "cmdi_keyword_hits": P.times(c, P.SHELL_WORDS).cast("double"),
        "ssti_pattern_hits": P.times(c, P.TEMPLATES, False).cast("double"),
        "path_traversal_hits": P.times(c, P.TRAVERSAL).cast("double"),
        "database_function_hits": P.times(c, P.DB_FUNCTIONS).cast("double"),
        "sql_structure_score": F.round(F.least(sql_score, F.lit(1.0)), 6),
        "xss_structure_score": F.round(F.least(xss_score, F.lit(1.0)), 6),
        "balanced_quote_ratio": F.lit(1.0) - 0.5 * (singles % 2) - 0.5 * (doubles % 2),
        "balanced_paren_ratio": F.when(opens == closes, 1.0).otherwise(F.least(opens, closes) / F.greatest(opens, closes, F.lit(1))),
        "sensitive_path_hits": P.times(c, P.SENSITIVE_PATHS, first="/C").cast("double"),
        "ip_addr_hits": P.times(c, P.INTERNAL_IPS, False, first="1").cast("double"),
    }


def entropy(df: DataFrame, key: str, parts: Column, name: str) -> DataFrame:
    """(key, name): entropy in bits over the parts of each row; rows without parts have none, and an empty string, which ``split`` makes of an empty text, is no part.

    Parts are counted before the shuffle; every key then holds one row per distinct part."""
    counts = df.select(key, F.explode(parts).alias("part")).where("part != ''").groupBy(key, "part").agg(F.count("*").alias("n"))
    sums = counts.groupBy(key).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(key, F.round(F.log2("total") - F.col("s") / F.col("total"), 6).alias(name))


def densest_window(c: Column, window: int = 50, step: int = 10) -> Column:
    """Most keywords per character in any window of ``window`` characters; 0 for fewer than 10."""
    low = F.lower(c)
    starts = F.sequence(F.lit(0), F.greatest(F.length(c) - step - 1, F.lit(0)), F.lit(step))
    chunk = lambda i: F.substr(low, i + 1, F.lit(window))
    hits = lambda x: P.times(x, P.SQL_WORDS) + P.times(x, P.XSS_WORDS) + P.times(x, P.SHELL_WORDS)
    return F.when(F.length(c) < 11, 0.0).otherwise(F.array_max(F.transform(starts, lambda i: hits(chunk(i)) / F.greatest(F.length(chunk(i)), F.lit(1)))))
