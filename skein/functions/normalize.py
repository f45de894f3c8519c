"""The iterative normaliser: rounds of decoders and structural steps until nothing changes, as one column expression.

The state of a value is a struct; a round is a chain of steps over it; ``aggregate`` runs the rounds, so the plan holds the
chain once. Values that no step could change don't enter it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decode as D
from . import patterns as P

STATE = {
    "value": "string", "depth": "int", "attempted": "int", "succeeded": "int", "layers": "int", "unicode": "int", "entities": "int", "base64": "boolean",
    "hex": "boolean", "comments": "int", "concats": "int", "spaces": "boolean", "folded": "boolean", "converged": "boolean", "mark": "int",
}
_TRAVERSAL = r"(?i)(?:\.\.[/\\]|%2e%2e|%252e)"
#: A well-formed character reference: without any, none is decoded.
_ENTITY = "&(?:[a-zA-Z]+|#[0-9]+|#x[0-9a-fA-F]+);"
#: A value without any of these is left as it is by every step.
_MAY_CHANGE = r"[%\\&'/\t\n\r]|[^\x20-\x7E]|  |<!--|^ *[A-Za-z0-9+/_=-]{8,} *$"


# What makes a decoded text an attack at sight.
REVEALED = [
    r"\b(?:sleep|pg_sleep|benchmark)\s*\(", r"\bunion\s+(?:all\s+)?select\b", r"<\s*(?:script|svg|img)\b", r"(?:^|[;&|])\s*(?:cat|id|whoami|curl|wget|bash|sh)\b",
    r"\{\{[^{}]+\}\}", r"\.\.[/\\]", r"<!doctype|<!entity", r"(?:127\.0\.0\.1|169\.254\.169\.254|metadata\.google\.internal)", r"(?:(?:%(?:\d+\$|\d+)?[spxXdn])){3,}",
]


def entropy_bits(c: Column) -> Column:
    """Entropy over the characters of a short value, without a shuffle; for long texts use ``features.entropy``."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.length(c)
    of = lambda x: D.let(F.size(F.filter(chars, lambda y: y == x)) / n, lambda p: -p * F.log2(p))
    return F.when(n > 0, F.aggregate(F.transform(F.array_distinct(chars), of), F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def opaque_base64(c: Column) -> Column:
    """Whether a value looks like Base64 rather than an identifier: a sign of the encoding in it, or length and entropy."""
    bare = F.trim(c)
    shaped = (F.length(bare) >= 8) & F.rlike(bare, F.lit("^[A-Za-z0-9+/=_-]+$")) & (F.length(F.regexp_replace(bare, "=+$", "")) % 4 != 1)
    return shaped & (F.rlike(bare, F.lit("[+/=_-]")) | F.when(F.length(bare) >= 24, entropy_bits(bare) >= 3.5).otherwise(False))


def base64_reveal(c: Column) -> Column:
    """What a value that looks like Base64 decodes to, if that is text worth reading; else null.

    Candidates are the value without the signs of the URL alphabet, and with them translated, each as it is and padded. The first one
    that is an attack at sight or scores over 0.85 is taken, else the best over 0.72; the score is 0.7 for printable text (0.65 of it at
    least), plus 0.3 of the share by which the entropy fell.
    """
    bare = F.trim(c)
    count = lambda v: F.length(F.regexp_replace(v, "=+$", ""))
    pads = F.length(bare) - count(bare)
    missing = F.pmod(-F.length(bare), F.lit(4))

    def read(v: Column, given: Column) -> Column:
        need = F.pmod(-count(v), F.lit(4))
        padded = F.concat(F.regexp_replace(v, "=+$", ""), F.repeat(F.lit("="), need.cast("int")))
        raw = F.try_to_binary(F.when((need < 3) & (given >= need), padded), F.lit("base64"))
        return D.let(raw, lambda b: F.decode(F.when(F.is_valid_utf8(b.cast("string")), b), "UTF-8"))

    dropped, url = F.regexp_replace(bare, "[-_]", ""), F.translate(bare, "-_", "+/")
    texts = F.array_distinct(F.array_compact(F.array(read(dropped, pads), read(url, pads), read(dropped, pads + missing), read(url, pads + missing))))

    def judged(before: Column) -> Column:
        ratio = lambda t: F.regexp_count(t, F.lit(D._PRINTABLE)) / F.length(t)
        seen = lambda t: F.rlike(t, F.lit("(?s)" + P.java("|".join(REVEALED))))
        fell = lambda t: F.greatest(F.lit(0.0), (before - entropy_bits(t)) / F.greatest(before, F.lit(0.01)))
        score = lambda t: F.when(seen(t), 2.0).otherwise(0.7 * ratio(t) + 0.3 * fell(t))
        usable = F.filter(texts, lambda t: (F.length(F.regexp_replace(t, r"(?U)\s", "")) > 0) & (ratio(t) >= 0.65))
        scored = F.transform(usable, lambda t, i: F.struct(score(t).alias("score"), (-i).alias("place"), t.alias("text")))

        def chosen(all_: Column) -> Column:
            early = F.filter(all_, lambda x: x["score"] > 0.85)
            best = F.array_max(all_)
            return F.when(F.size(early) > 0, F.get(early, F.lit(0))["text"]).when(best["score"] > 0.72, best["text"])

        return D.let(scored, chosen)

    return F.when(opaque_base64(c), D.let(entropy_bits(c), judged))


def _set(s: Column, **changes: Column) -> Column:
    return F.struct(*(changes.get(k, s[k]).cast(kind).alias(k) for k, kind in STATE.items()))


def _decoder(new, **more):
    """A decoding step: ``new(value)`` or null where it doesn't apply; ``more`` are state changes where it changed something."""

    def step(s: Column) -> Column:
        def done(x: Column) -> Column:
            hit = x.isNotNull() & (x != s["value"])
            changes = {k: F.when(hit, f(s)).otherwise(s[k]) for k, f in more.items()}
            return _set(s, value=F.coalesce(x, s["value"]), attempted=s["attempted"] + 1, succeeded=s["succeeded"] + hit.cast("int"), **changes)

        return D.let(new(s["value"]), done)

    return step


def _percent(s: Column) -> Column:
    """Up to three layers, one attempt."""
    once = lambda s: D.let(D.percent_decode(s["value"]), lambda x: _set(s, value=x, layers=s["layers"] + (x != s["value"]).cast("int")))
    s = _set(s, mark=s["layers"])
    for _ in range(3):
        s = D.let(s, once)
    return D.let(s, lambda s: _set(s, attempted=s["attempted"] + 1, succeeded=s["succeeded"] + (s["layers"] > s["mark"]).cast("int")))


def _structural(gate, new, field: str, flag: bool = False):
    """A structural step behind its gate; it adds its count to ``field``, or sets it."""

    def step(s: Column) -> Column:
        x, n = new(s["value"])
        n = F.when(x != s["value"], F.lit(1)).otherwise(0) if n is None else n
        made = D.let(F.struct(x.alias("x"), n.alias("n")), lambda m: _set(s, value=m["x"], **{field: (s[field] | (m["n"] > 0)) if flag else s[field] + m["n"]}))
        return F.when(gate(s["value"]), made).otherwise(s)

    return step


def restored(c: Column, location: Column | None = None, rounds: int = 5, unicode: bool = True) -> Column:
    """The state of ``c`` after at most ``rounds`` rounds: what it restores to (``value``) and what happened. Null stays null.
    ``unicode`` brings NFKC into each round.

    ``converged`` tells whether the last round changed nothing."""
    place = F.lit(False) if location is None else F.coalesce(location == "path", F.lit(False))
    steps = [
        _decoder((lambda v: D.strip_invisible(D.nfkc(v))) if unicode else D.strip_invisible),
        _percent,
        _decoder(D.hex_decode, hex=lambda s: F.lit(True)),
        _decoder(base64_reveal, base64=lambda s: F.lit(True)),
        _decoder(D.unicode_unescape, unicode=lambda s: s["unicode"] + F.regexp_count(s["value"], F.lit(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"))),
        _decoder(lambda v: F.when(F.rlike(v, F.lit(_ENTITY)), D.html_decode_all(v)), entities=lambda s: s["entities"] + F.regexp_count(s["value"], F.lit(_ENTITY))),
        _structural(lambda v: place | F.rlike(v, F.lit(_TRAVERSAL)), lambda v: (D.fold_path(v), None), "folded", True),
        _structural(lambda v: F.contains(v, F.lit("/*")), D.sql_comments, "comments"),
        _structural(lambda v: F.rlike(v, F.lit(r"<!--|/\*|//")) & ~F.rlike(v, F.lit(r"(?i)^[a-z][a-z0-9+.-]*://")), D.general_comments, "comments"),
        _structural(lambda v: F.contains(v, F.lit("'")), D.string_concat, "concats"),
        _structural(lambda v: F.lit(True), lambda v: (D.squeeze_space(v), None), "spaces", True),
    ]

    def one_round(s: Column, _: Column) -> Column:
        now = _set(s, depth=s["depth"] + 1)
        for step in steps:
            now = D.let(now, step)
        return F.when(s["converged"], s).otherwise(D.let(now, lambda n: _set(n, converged=n["value"] == s["value"])))

    zero = {"string": c, "int": F.lit(0), "boolean": F.lit(False)}
    start = F.struct(*(zero[kind].cast(kind).alias(k) for k, kind in STATE.items()))
    kept = {"depth": F.lit(1), "attempted": F.lit(6), "converged": F.lit(True)}
    same = F.struct(*(kept.get(k, zero[kind]).cast(kind).alias(k) for k, kind in STATE.items()))
    changing = F.rlike(c, F.lit(_MAY_CHANGE)) | place
    return F.when(c.isNull(), F.lit(None)).when(changing, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, one_round)).otherwise(same)


def normalize_fields(df: DataFrame, value: str = "value", location: str | None = "location", unicode: bool = True) -> DataFrame:
    """``df`` with ``restored`` and ``meta`` (the counters of the normaliser)."""
    done = df.withColumn("_state", restored(F.col(value), F.col(location) if location else None, unicode=unicode))
    meta = F.struct(*(F.col("_state")[k].alias(k) for k in STATE if k not in ("value", "mark")))
    return done.select(*df.columns, F.col("_state")["value"].alias("restored"), meta.alias("meta"))


def decode_features(value: Column, restored_to: Column, meta: Column) -> dict[str, Column]:
    """The features that tell how a value was decoded."""
    before, after = F.length(value), F.length(restored_to)
    return {
        "decode_depth": meta["depth"].cast("double"),
        "len_before_after_ratio": F.when(after == 0, 1.0).otherwise(before / F.greatest(after, F.lit(1))),
        "entropy_delta": entropy_bits(value) - entropy_bits(restored_to),
        "converged": meta["converged"].cast("double"),
        "decode_steps_attempted": meta["attempted"].cast("double"),
        "successful_decode_steps": meta["succeeded"].cast("double"),
        "url_decode_layers": meta["layers"].cast("double"),
        "base64_decode_success": meta["base64"].cast("double"),
        "comment_blocks_removed": meta["comments"].cast("double"),
        "concat_patterns_removed": meta["concats"].cast("double"),
        "whitespace_normalized": meta["spaces"].cast("double"),
        "payload_grew": (after > before).cast("double"),
    }
