"""Policies over requests and their surroundings: header lists, observed against allowed, redaction, serialized payloads, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import let
from ..functions.normalize import entropy_bits

# How serialized objects begin, by ecosystem and format, and how each is carried.
MAGIC = [("java", "java_serialization", "ACED0005"), ("dotnet", "BinaryFormatter", "00010000"), ("python", "pickle", "80")]
MARKS = [("python", "pyyaml", "!!python/object/apply:subprocess.Popen"), ("python", "jsonpickle", "py/reduce")]
REDACTED = "<redacted:"
#: Shapes of secrets: name, pattern with the secret as its first group, entropy in bits a character from which it counts.
SECRETS = [
    ("access_key", r"\b(AKIA[0-9A-Z]{16})\b", 0.0), ("private_key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 0.0),
    ("credential", r"""(?i)\b(?:password|passwd|secret|token|api[_-]?key)["']?\s*[=:]\s*["']?([^\s"'&,;]{8,})""", 2.5),
]


def header_violations(headers: Column) -> Column:
    """What a list of HTTP/2 headers (array<struct<name, value>>, in order) does against the policy, by name; empty if nothing.

    Order is judged by a fold that remembers whether a regular header has gone by.
    """
    low = F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))

    def judged(hs: Column) -> Column:
        pseudo = F.filter(F.transform(hs, lambda h: h["name"]), lambda n: F.startswith(n, F.lit(":")))
        state = lambda regular, late: F.struct(regular.alias("regular"), late.alias("late"))
        colon = lambda h: F.startswith(h["name"], F.lit(":"))
        order = F.aggregate(hs, state(F.lit(False), F.lit(False)), lambda s, h: state(s["regular"] | ~colon(h), s["late"] | (s["regular"] & colon(h))))
        values = lambda name: F.transform(F.filter(hs, lambda h: h["name"] == name), lambda h: F.lower(F.trim(h["value"])))
        first = lambda name: F.get(values(name), F.lit(0))
        named = [
            ("duplicate_pseudo_header", F.size(pseudo) > F.size(F.array_distinct(pseudo))), ("pseudo_header_after_regular", order["late"]),
            ("conflicting_content_length", F.size(F.array_distinct(values("content-length"))) > 1), ("forbidden_transfer_encoding", F.size(values("transfer-encoding")) > 0),
            ("authority_host_mismatch", first(":authority") != first("host")), ("extended_connect_not_allowed", (first(":method") == "connect") & (F.size(values(":protocol")) > 0)),
        ]
        return F.array_compact(F.array(*(F.when(test, F.lit(n)) for n, test in named)))

    return let(low, judged)


def context_mismatches(requests: DataFrame, policies: DataFrame, on: str) -> DataFrame:
    """``requests`` with ``mismatches``: which of role, owner, method and origin differ from what the policy of their ``on`` allows.

    One lookup serves all four. ``policies(on, roles, methods, origins)`` holds arrays of what is allowed, null allowing anything; an owner is
    allowed if it is the caller or the policy is ``shared``. A request without a policy has the mismatch ``policy``; a null that was observed is
    allowed nothing but a null policy.
    """
    allowed = policies.withColumnsRenamed({c: f"_{c}" for c in policies.columns})
    both = requests.join(allowed, F.col(on) == F.col(f"_{on}"), "left")
    outside = lambda c, of: F.col(of).isNotNull() & ~F.coalesce(F.array_contains(of, F.col(c)), F.lit(False))
    named = [
        ("policy", F.col(f"_{on}").isNull()), ("role", outside("role", "_roles")), ("owner", ~F.coalesce(F.col("_shared"), F.lit(True)) & ~F.col("owner").eqNullSafe(F.col("caller"))),
        ("method", outside("method", "_methods")), ("origin", F.col("origin").isNotNull() & outside("origin", "_origins")),
    ]
    return both.withColumn("mismatches", F.array_compact(F.array(*(F.when(test, F.lit(n)) for n, test in named)))).select(*requests.columns, "mismatches")


def serialized_as(ecosystem: Column, form: Column, encoding: Column, payload: Column) -> Column:
    """Whether a serialized payload is what it says: binary forms by their first bytes in Base64, text forms by their mark."""
    raw = F.hex(F.try_to_binary(F.when(F.rlike(payload, F.lit("^[A-Za-z0-9+/]+={0,2}$")) & (F.length(payload) % 4 == 0), payload), F.lit("base64")))
    binary = [(ecosystem == e) & (form == f) & (encoding == "base64_transport") & F.startswith(raw, F.lit(m)) for e, f, m in MAGIC]
    text = [(ecosystem == e) & (form == f) & (encoding == "utf8_text") & F.contains(payload, F.lit(m)) for e, f, m in MARKS]
    boxed = F.when(form == "jsonpickle", F.try_variant_get(F.try_parse_json(payload), '$["py/reduce"]', "variant").isNotNull()).otherwise(F.lit(True))
    found = F.lit(False)
    for test in (*binary, *text):
        found = found | F.coalesce(test, F.lit(False))
    return found & F.coalesce(boxed, F.lit(False))


def secrets_in(text: Column) -> Column:
    """The names of the shapes of secrets that a text still holds: a value that isn't redacted and, where the shape asks for it, has the entropy of one."""

    def held(pattern: str, bits: float) -> Column:
        values = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: ~F.startswith(v, F.lit(REDACTED)))
        return F.exists(F.array_distinct(values), lambda v: (entropy_bits(v) >= bits) if bits else F.lit(True))

    return F.array_compact(F.array(*(F.when(held(p, b), F.lit(n)) for n, p, b in SECRETS)))


def redaction(df: DataFrame, text_col: str, literals: list[str]) -> DataFrame:
    """One row: how many texts hold one of the known ``literals``, a secret by its shape, or a mark of redaction; and whether the table passes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = F.lit(False)
    for x in literals:
        known = known | F.contains(text, F.lit(x))
    counts = df.agg(F.count_if(known).alias("literals"), F.count_if(F.size(secrets_in(text)) > 0).alias("secrets"), F.count_if(F.contains(text, F.lit(REDACTED))).alias("redacted"))
    return counts.withColumn("passed", (F.col("literals") == 0) & (F.col("secrets") == 0))


def look_back(df: DataFrame, ts: str, as_of: Column, hours: int) -> DataFrame:
    """Rows of the last ``hours`` before ``as_of``, which is given, so that a rerun gives the same rows."""
    return df.where(F.col(ts) >= as_of - F.expr(f"interval {hours} hours"))


def threat_names(threats: Column) -> Column:
    """What a request's threats are called: the first three rules of each, else its name, else its layer."""
    plain = lambda x: F.coalesce(F.nullif(x["name"], F.lit("")), F.nullif(x["layer"], F.lit("")), F.lit("model_detected"))
    return F.flatten(F.transform(threats, lambda x: F.when(F.size(x["rule_hits"]) > 0, F.slice(x["rule_hits"], 1, 3)).otherwise(F.array(plain(x)))))


def activity(log: DataFrame) -> DataFrame:
    """(kind, name, n): requests by outcome and by method, and threats by name, of ``log(outcome, method, threats)``, in one pass over it."""
    one = lambda kind, c, other: F.array(F.struct(F.lit(kind).alias("kind"), F.coalesce(c, F.lit(other)).alias("name")))
    names = F.transform(threat_names(F.col("threats")), lambda x: F.struct(F.lit("threat").alias("kind"), x.alias("name")))
    rows = log.select(F.inline(F.concat(one("outcome", F.col("outcome"), "unknown"), one("method", F.col("method"), "UNKNOWN"), F.coalesce(names, F.array().cast("array<struct<kind: string, name: string>>")))))
    return rows.groupBy("kind", "name").agg(F.count("*").alias("n"))


def detection_stats(detections: DataFrame) -> DataFrame:
    """(kind, name, n, mean_ms): ``detections(verdict, layer, rule_hits, elapsed_ms)`` by verdict, by layer, and attacks by their first rule."""
    first = F.when(F.size("rule_hits") > 0, F.get("rule_hits", F.lit(0))).otherwise("ml_detected")
    kinds = [("verdict", F.col("verdict")), ("layer", F.col("layer")), ("type", F.when(F.col("verdict") == "attack", first))]
    rows = detections.select("elapsed_ms", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in kinds)))).where("name is not null")
    return rows.groupBy("kind", "name").agg(F.count("*").alias("n"), F.round(F.avg("elapsed_ms"), 6).alias("mean_ms"))
