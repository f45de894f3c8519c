"""Queries of policies, audits and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policies, training
from .queries import query, t

_PSEUDO = [":method", "GET"], [":path", "/"]
#: Header lists, each with what it violates.
HEADERS = [
    ([*_PSEUDO, ["accept", "x"]], ""),
    ([*_PSEUDO, [":METHOD", "POST"]], "duplicate_pseudo_header"),
    ([[":method", "GET"], ["accept", "x"], [":path", "/"]], "pseudo_header_after_regular"),
    ([*_PSEUDO, ["content-length", "4"], ["Content-Length", "9"]], "conflicting_content_length"),
    ([*_PSEUDO, ["content-length", "4"], ["content-length", " 4"]], ""),
    ([*_PSEUDO, ["transfer-encoding", "chunked"]], "forbidden_transfer_encoding"),
    ([*_PSEUDO, [":authority", "a.example"], ["host", "b.example"]], "authority_host_mismatch"),
    ([*_PSEUDO, [":authority", "a.example"], ["host", "A.example"]], ""),
    ([[":method", "CONNECT"], [":protocol", "websocket"], [":path", "/"]], "extended_connect_not_allowed"),
    ([["x", "1"], *_PSEUDO, [":path", "/b"], ["transfer-encoding", "x"]], "duplicate_pseudo_header,pseudo_header_after_regular,forbidden_transfer_encoding"),
]


def _picked(key, cases):
    return F.element_at(F.array(*cases), (key % len(cases) + 1).cast("int"))


@query("select event_id, ([" + ", ".join(f"'{v}'" for _, v in HEADERS) + f"])[event_id % {len(HEADERS)} + 1] as violations from events")
def x_header_policy(spark, d):
    """Header lists of events against the gateway's policy; seven in ten violate something."""
    lists = [F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in hs)) for hs, _ in HEADERS]
    e = t(spark, d, "events").select("event_id", _picked(F.col("event_id"), lists).alias("headers"))
    return e.select("event_id", F.array_join(policies.header_violations(F.col("headers")), ",").alias("violations"))


@query("""with r as (select o_orderkey, (['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[o_custkey % 5 + 1] as place, cast(o_orderkey % 6 as varchar) as role, o_custkey as owner, case when o_orderkey % 4 = 0 then o_custkey else o_custkey + 1 end as caller,
    case when o_orderkey % 3 = 0 then 'DELETE' else 'GET' end as method, case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then 'evil.example' else 'own.example' end as origin from orders),
  m as (select o_orderkey, list_filter([case when place = '5-LOW' then 'policy' end, case when place = '1-URGENT' and role not in ('0', '1', '2', '3') then 'role' end, case when place in ('1-URGENT', '2-HIGH') and owner <> caller then 'owner' end,
    case when place in ('1-URGENT', '2-HIGH', '3-MEDIUM') and method <> 'GET' then 'method' end, case when place <> '5-LOW' and origin = 'evil.example' then 'origin' end], lambda x: x is not null) as found from r)
  select o_orderkey, array_to_string(found, ',') as mismatches from m""")
def x_context_policy(spark, d):
    """Role, owner, method and origin of a request against the policy of its place: four comparisons from one lookup."""
    k = F.col("o_orderkey")
    o = t(spark, d, "orders").select("o_orderkey", _picked(F.col("o_custkey"), [*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))]).alias("place"), (k % 6).cast("string").alias("role"), F.col("o_custkey").alias("owner"), F.when(k % 4 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1).alias("caller"),
        F.when(k % 3 == 0, "DELETE").otherwise("GET").alias("method"), F.when(k % 5 == 0, None).when(k % 7 == 0, "evil.example").otherwise("own.example").alias("origin"))
    rows = [("1-URGENT", ["0", "1", "2", "3"], ["GET"], ["own.example"], False), ("2-HIGH", None, ["GET"], ["own.example"], False), ("3-MEDIUM", None, ["GET"], ["own.example"], True), ("4-NOT SPECIFIED", None, None, ["own.example"], True)]
    table = spark.createDataFrame(rows, "place string, roles array<string>, methods array<string>, origins array<string>, shared boolean")
    return policies.context_mismatches(o, table, "place").select("o_orderkey", F.array_join("mismatches", ",").alias("mismatches"))


@query("select p_partkey, p_partkey % 9 in (0, 2, 4, 6, 7) as valid from part")
def q_serialized_payloads(spark, d):
    """Serialized payloads by their first bytes or marks; failing ones are planted."""
    k = F.col("p_partkey")
    b64 = lambda start: F.base64(F.unhex(F.concat(F.lit(start), F.hex(F.encode("p_name", "UTF-8")))))
    plain = lambda c: F.regexp_replace(c, r"\s", "")
    cases = [
        ("java", "java_serialization", "base64_transport", b64("ACED0005")), ("java", "java_serialization", "base64_transport", b64("ACED0006")), ("dotnet", "BinaryFormatter", "base64_transport", b64("00010000")),
        ("dotnet", "BinaryFormatter", "utf8_text", b64("00010000")), ("python", "pickle", "base64_transport", b64("80")), ("python", "pickle", "base64_transport", F.concat(F.lit("*"), b64("80"))),
        ("python", "pyyaml", "utf8_text", F.concat(F.lit("!!python/object/apply:subprocess.Popen [x, "), F.col("p_name"), F.lit("]"))), ("python", "jsonpickle", "utf8_text", F.to_json(F.struct(F.col("p_name").alias("py/reduce")))),
        ("python", "jsonpickle", "utf8_text", F.to_json(F.struct(F.lit("py/reduce").alias("other")))),
    ]
    made = [_picked(k, [F.lit(c[n]) for c in cases]) for n in range(3)]
    return t(spark, d, "part").select("p_partkey", policies.serialized_as(*made, _picked(k, [plain(c[3]) if n < 6 else c[3] for n, c in enumerate(cases)])).alias("valid"))


_SECRET = """case c_custkey % 5 when 0 then 'password=' || c_name when 1 then 'password: <redacted:password>' when 2 then 'key AKIA' || lpad(cast(c_custkey as varchar), 16, '0') || ' end' when 3 then 'token=aaaaaaaaaaaa' else 'known-' || c_name end"""


@query(f"""with r as (select {_SECRET} as text from customer), v as (select text, regexp_extract(text, '(?i)(?:password|passwd|secret|token|api[_-]?key)[\"'']?\\s*[=:]\\s*[\"'']?([^\\s\"''&,;]{{8,}})', 1) as v from r),
  s as (select text, regexp_matches(text, 'AKIA[0-9A-Z]{{16}}') or (v <> '' and not starts_with(v, '<redacted:') and (select entropy(c) from (select unnest(string_split(v, '')) as c)) >= 2.5) as secret from v)
  select count(*) filter (where contains(text, 'known-Customer')) as literals, count(*) filter (where secret) as secrets, count(*) filter (where contains(text, '<redacted:')) as redacted, false as passed from s""")
def q_redaction(spark, d):
    """Customers' notes with known literals, secrets by shape and entropy, and redacted ones among them."""
    k = F.col("c_custkey")
    cases = [F.concat(F.lit("password="), F.col("c_name")), F.lit("password: <redacted:password>"), F.concat(F.lit("key AKIA"), F.lpad(k.cast("string"), 16, "0"), F.lit(" end")), F.lit("token=aaaaaaaaaaaa"), F.concat(F.lit("known-"), F.col("c_name"))]
    return policies.redaction(t(spark, d, "customer").select(_picked(k, cases).alias("text")), "text", ["known-Customer"])


@query("""with l as (select event_type as outcome, case when user_id % 3 = 0 then 'GET' end as method, event_id % 4 as k, 'r' || (event_id % 5) as r from events where ts >= timestamp '2024-01-20' - interval 240 hour),
  n as (select unnest(case k when 0 then [r, 'second', 'third', 'behaviour'] when 1 then ['body'] when 2 then ['model_detected'] else [] end) as name from l)
  select 'outcome' as kind, outcome as name, count(*) as n from l group by 2 union all select 'method', coalesce(method, 'UNKNOWN'), count(*) from l group by 2 union all select 'threat', name, count(*) from n group by 2""")
def g_activity(spark, d):
    """Outcomes, methods and threats of the ten days before a given moment."""
    k, hit = F.col("event_id") % 4, F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string"))
    threat = lambda name, layer, *hits: F.struct(F.lit(name).cast("string").alias("name"), F.lit(layer).alias("layer"), (F.array(*hits) if hits else F.array().cast("array<string>")).alias("rule_hits"))
    none = F.array().cast("array<struct<name: string, layer: string, rule_hits: array<string>>>")
    threats = F.when(k == 0, F.array(threat("q", "L1", hit, F.lit("second"), F.lit("third"), F.lit("fourth")), threat("", "behaviour"))).when(k == 1, F.array(threat("body", "L2"))).when(k == 2, F.array(threat(None, ""))).otherwise(none)
    log = policies.look_back(t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", F.lit("2024-01-20").cast("timestamp"), 240)
    return policies.activity(log.select(F.col("event_type").alias("outcome"), F.when(F.col("user_id") % 3 == 0, "GET").alias("method"), threats.alias("threats")))


@query("""with r as (select case when event_type = 'error' then 'attack' else 'benign' end as verdict, 'L' || (user_id % 3) as layer, case when event_id % 2 = 0 then 'rule' || (event_id % 3) else 'ml_detected' end as kind, value from events)
  select 'verdict' as kind, verdict as name, count(*) as n, round(avg(value), 6) as mean_ms from r group by 2 union all select 'layer', layer, count(*), round(avg(value), 6) from r group by 2 union all select 'type', kind, count(*), round(avg(value), 6) from r where verdict = 'attack' group by 2""")
def g_detection_stats(spark, d):
    hits = F.when(F.col("event_id") % 2 == 0, F.array(F.concat(F.lit("rule"), (F.col("event_id") % 3).cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = t(spark, d, "events").select(F.when(F.col("event_type") == "error", "attack").otherwise("benign").alias("verdict"), F.concat(F.lit("L"), (F.col("user_id") % 3).cast("string")).alias("layer"), hits.alias("rule_hits"), F.col("value").alias("elapsed_ms"))
    return policies.detection_stats(rows)


@query("""with r as (select d.doc_id, case d.doc_id % 3 when 0 then 'request' else 'field' end as level, d.doc_id % 5 <> 0 as allowed, case when d.doc_id % 4 = 0 then '' else substr(d.text, 1, 40) end as obfuscated, d.text, l.toxic = 1 as duplicate from documents d left join labels l using (doc_id)),
  p as (select *, coalesce(nullif(obfuscated, ''), text, '') as payload from r)
  select doc_id, level = 'field' and allowed and length(payload) between 1 and 8192 and not coalesce(duplicate, false) as eligible, sha256(payload || ' __normalized__ ' || lower(payload)) as input from p""")
def p_model_eligible(spark, d):
    """Which records may train the field model, the payload that counts, and the text that the model reads."""
    k = F.col("doc_id")
    rows = t(spark, d, "documents").join(t(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    rows = rows.withColumn("payload", training.chosen_payload(F.when(k % 4 == 0, "").otherwise(F.substring("text", 1, 40)), F.col("text")))
    may = training.eligible(F.when(k % 3 == 0, "request").otherwise("field"), k % 5 != 0, F.col("payload"), F.col("toxic") == 1)
    return rows.select("doc_id", may.alias("eligible"), F.sha2(training.model_text(F.col("payload"), F.lower("payload")), 256).alias("input"))
