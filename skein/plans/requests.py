"""Queries of requests: bodies to fields, rules as data, and verdicts beside what is known of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.extension_rules import EXTENSION_RULES
from ..functions.rule_index import measured_index, read_rules
from ..operators import cascade, fields
from .queries import query, spread, t


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _picked(key, cases: list):
    """The case whose number is the key's remainder: a column over plain literals."""
    return F.element_at(F.array(*map(F.lit, cases)), (key % len(cases) + 1).cast("int"))


# --- bodies ---------------------------------------------------------------------------------------------------------
_NESTED = """'{"a":[' || '{"a":[' || '{"a":[' || '{"a":[' || '{"a":[' || '{"a":[' || '{"user":' || user_id || ',"kind":"' || event_type || '","ok":true,"none":null,"props":' || props || ',"text":"]}{["}' || ']}]}]}]}]}]}'"""


@query(f"""select e.event_id, substr(l.fullkey, 3) as name, case when l.type = 'NULL' then 'None' when l.type = 'BOOLEAN' then 'True' else json_extract_string(l.value, '$') end as value
  from (select event_id, {_NESTED} as body from events) e, json_tree(e.body) l where l.type not in ('OBJECT', 'ARRAY')""")
def rq_json_bodies(spark, d):
    """The leaves of bodies that nest 13 deep and more, out of whole requests."""
    open_, close = '{"a":[' * 6, "]}" * 6
    body = F.concat(F.lit(open_ + '{"user":'), F.col("user_id").cast("string"), F.lit(',"kind":"'), F.col("event_type"), F.lit('","ok":true,"none":null,"props":'), F.col("props"), F.lit(',"text":"]}{["}' + close))
    raw = F.concat(F.lit("POST /x HTTP/1.1\r\nHost: h\r\nContent-Type: application/json\r\n\r\n"), body)
    found = fields.explode_requests(t(spark, d, "events").select("event_id", raw.alias("raw")), "event_id", "raw")
    return found.where("location = 'body'").select("event_id", "name", "value")


@query("""select event_id, idx, name, value from (
  select event_id, 0 as idx, 'kind' as name, event_type as value from events where event_id % 3 = 0
  union all select event_id, 1, 'user', cast(user_id as varchar) from events where event_id % 3 = 0
  union all select event_id, 0, 'body', 'kind ' || event_type from events where event_id % 3 = 1
  union all select event_id, 0, '', cast(user_id as varchar) from events where event_id % 3 = 2)""")
def rq_plain_bodies(spark, d):
    """Forms give the first value of each name, other texts a field of their own, a bare JSON number one without a name."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    form = F.concat(F.lit("kind="), kind, F.lit("&user="), user, F.lit("&kind=later&user="))
    body = F.when(F.col("event_id") % 3 == 0, form).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" kind "), kind, F.lit("\n"))).otherwise(user)
    raw = F.concat(F.lit("POST / HTTP/1.1\r\nHost: h\r\n\r\n"), body)
    found = fields.explode_requests(t(spark, d, "events").select("event_id", raw.alias("raw")), "event_id", "raw")
    return found.where("location = 'body'").select("event_id", "idx", "name", "value")


@query("select page_id, regexp_replace(split_part(url, '#', 1), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') as target, 'probe/' || page_id as agent from pages")
def rq_targets_and_agents(spark, d):
    raw = F.concat(F.lit("GET "), fields.target_of(F.col("url")), F.lit(" HTTP/1.1\r\nHost: h\r\nUSER-AGENT:  probe/"), F.col("page_id").cast("string"), F.lit(" \r\n\r\nUser-Agent: body"))
    return t(spark, d, "pages").select("page_id", F.inline(F.array(fields.target_and_agent(raw))))


# --- rules as data --------------------------------------------------------------------------------------------------
_SNIPPETS = [
    "", " 1 UNION ALL SELECT 2", " '  or '1'='1", "; wget x", "`id`", " $(id)", " > /dev/null", " && ping h", " %0a id", " ${IFS}x", " /bin/c?t /e*", " eval( x )", "<video src=x onerror =1>", " load_file ('x')", " floor( rand(0)*2)",
    " data:text/html,x", " group_concat(a)", "<iframe srcdoc=x>", " unionselect drop tables", " x.innerHTML = 1", " /etc/shadow", " alert(1)", " JAVASCRIPT :x",
]
_VALUES = f"(select c_custkey, c_name || ([{', '.join(map(_lit, _SNIPPETS))}])[c_custkey % {len(_SNIPPETS)} + 1] as value from customer)"
_RULE_ROWS = "(values " + ", ".join(f"({_lit(i)}, {_lit(s)}, {_lit('(?i)' + p)})" for i, _, s, p in sorted(EXTENSION_RULES)) + ") r(id, severity, pattern)"


def rules_table(spark):
    return spark.createDataFrame(EXTENSION_RULES, "id string, family string, severity string, pattern string")


def _values(spark, d):
    return spread(t(spark, d, "customer").select("c_custkey", "c_name")).select("c_custkey", F.concat("c_name", _picked(F.col("c_custkey"), _SNIPPETS)).alias("value"))


@query(f"select v.c_custkey, string_agg(r.id, ',' order by r.id) as hits from {_VALUES} v join {_RULE_ROWS} on regexp_matches(v.value, r.pattern) group by v.c_custkey")
def p_rules_as_data(spark, d):
    """Rules of a table, by the rarest literal that each needs in these very values."""
    values = _values(spark, d)
    index = measured_index(read_rules(rules_table(spark)), values, "value")
    return values.select("c_custkey", F.array_join(index.hits(F.col("value")), ",").alias("hits")).where("hits <> ''")


@query(f"select p.page_id, r.id as rule from pages p join {_RULE_ROWS} on regexp_matches(p.html, r.pattern)")
def p_page_extension_rules(spark, d):
    index = measured_index(read_rules(rules_table(spark)), t(spark, d, "pages"), "html")
    return t(spark, d, "pages").select("page_id", F.explode(index.hits(F.col("html"))).alias("rule"))


@query(f"""select c_custkey % {len(_SNIPPETS)} as kind, count(*) as n, count(*) filter (where hits is not null) as with_rules from (
  select v.c_custkey, (select string_agg(r.id, ',') from {_RULE_ROWS} where regexp_matches(v.value, r.pattern)) as hits from {_VALUES} v) group by 1""")
def c_rules_as_data(spark, d):
    """The cascade with a rules table: values that one of its rules matches carry its id, however they are judged."""
    names = [r[0] for r in EXTENSION_RULES]
    df = _values(spark, d).select("c_custkey", F.lit("x;").alias("name"), "value", F.lit("query").alias("location"))
    found = cascade.detect_fields(df, rules=rules_table(spark))
    own = F.arrays_overlap("rule_hits", F.array(*map(F.lit, names)))
    return found.groupBy((F.col("c_custkey") % len(_SNIPPETS)).alias("kind")).agg(F.count("*").alias("n"), F.count_if(own).alias("with_rules"))


# --- verdicts that are known ----------------------------------------------------------------------------------------
#: name, value, location, verdict, layer, confidence, rules.
KNOWN = [
    ("q", "hello world", "query", "benign", "L0", 0.999, ""),
    ("page", "-2.5", "query", "benign", "L0", 0.999, ""),
    ("agent", "Mozilla/5.0 (X11; Linux x86_64)", "header", "benign", "L0", 0.999, ""),
    ("q", "x²", "query", "benign", "L0", 0.999, ""),
    ("q", "zxqv;2026", "query", "uncertain", "L1", 0.5, ""),
    ("q", "sleep(1.1)", "query", "attack", "L1-Raw", 0.99, "sqli_sleep"),
    ("q", "%73%6c%65%65%70%28%31%2e%31%29", "query", "attack", "L1", 0.99, "sqli_sleep"),
    ("q", "%2527%20OR%201=1", "query", "attack", "L1", 0.99, "sqli_or_tautology"),
    ("q", "1; cat /etc/passwd", "query", "attack", "L1-Raw", 0.99, "cmdi_semicolon_cmd"),
    ("q", "drop‍ table users", "query", "attack", "L1", 0.99, "sqli_drop_table"),
    ("q", "union‍ all select 1", "query", "attack", "L1", 0.99, "sqli_union"),
    ("q", "%EF%BC%9Cscript src='a'%EF%BC%9E", "query", "attack", "L1", 0.99, "xss_script_open,xss_script_src"),
    ("q", "&ltscript src='a'&gt &amp;", "query", "attack", "L1", 0.99, "xss_script_open,xss_script_src"),
    ("q", "MSB1bmlvbiBzZWxlY3QgMg==", "query", "attack", "L1", 0.99, "sqli_union"),
    ("x", "%p%p%p%p", "query", "attack", "L1-Raw", 0.99, "encoded_format_string"),
    ("x", "JTBkJTBh", "query", "attack", "L1-Raw", 0.99, "encoded_control_character_injection"),
    ("redirect", "//3627734734", "query", "attack", "L1-Context", 0.99, "context_external_redirect"),
    ("page", "//3627734734", "query", "uncertain", "L1", 0.5, ""),
    ("file", "a/../b", "query", "attack", "L1-Context", 0.99, "context_path_traversal"),
    ("webhook", "http://169.254.169.254/latest", "body", "attack", "L1-Context", 0.99, "context_ssrf_target"),
    ("Authorization", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTYifQ.", "header", "attack", "L1-Raw", 0.99, "jwt_empty_signature"),
    ("v", "select a, b from t where id = ?", "body", "benign", "L0-Context", 0.995, ""),
    ("note", "example: &lt;script&gt;alert&lt;/script&gt;", "body", "benign", "L0-Context", 0.995, ""),
    ("content", "Was ist der Unterschied zwischen SELECT und JOIN? Wie nutzt man UNION?", "body", "benign", "L0-Context", 0.995, ""),
    ("content", "How should I use sleep(1.1) in this tutorial?", "body", "attack", "L1-Raw", 0.99, "sqli_sleep"),
    ("value", "SELECT 和 JOIN 的区别是什么？; DROP TABLE users", "query", "attack", "L1-Raw", 0.99, "sqli_drop_table"),
]


def _fields(spark, d):
    key = F.col("c_custkey")
    return t(spark, d, "customer").select("c_custkey", (key % len(KNOWN)).cast("int").alias("kind"), *(_picked(key, [c[k] for c in KNOWN]).alias(n) for k, n in enumerate(("name", "value", "location"))))


_KNOWN = "(values " + ", ".join(f"({k}, {_lit(v)}, {_lit(layer)}, {c}, {_lit(r)})" for k, (_, _, _, v, layer, c, r) in enumerate(KNOWN)) + ") k(kind, verdict, layer, confidence, rules)"


@query(f"select c_custkey, verdict, layer, cast(confidence as double) as confidence, rules from customer join {_KNOWN} on c_custkey % {len(KNOWN)} = kind")
def c_known_verdicts(spark, d):
    """Verdict, layer, confidence and rules of fields whose outcome is known."""
    return cascade.detect_distinct(_fields(spark, d)).select("c_custkey", "verdict", "layer", "confidence", F.array_join("rule_hits", ",").alias("rules"))


@query(f"select layer, verdict, count(*) as fields from customer join {_KNOWN} on c_custkey % {len(KNOWN)} = kind group by all")
def c_known_layers(spark, d):
    """How many of these fields each stage decides."""
    return cascade.detect_distinct(_fields(spark, d)).groupBy("layer", "verdict").agg(F.count("*").alias("fields"))


#: raw request, verdict, attacks, uncertain fields, threats as place:name:layer:rules.
REQUESTS = [
    ("GET /search?q=hello%20world&page=2 HTTP/1.1\r\nHost: h\r\n\r\n", "benign", 0, 0, ""),
    ("GET /search?q=sleep%281.1%29 HTTP/1.1\r\nHost: h\r\n\r\n", "attack", 1, 0, "query:q:L1-Raw:sqli_sleep"),
    ('POST /a HTTP/1.1\r\nHost: h\r\nContent-Type: application/json\r\n\r\n{"a":[{"b":{"c":["x","1 UNION SELECT 2"]}}],"ok":true}', "attack", 1, 0, "body:a[0].b.c[1]:L1-Raw:sqli_union"),
    ("POST /a HTTP/1.1\r\nHost: h\r\n\r\nnext=%2F%2Fevil.example&note=zx%3Bqv", "attack", 1, 1, "body:next:L1-Context:context_external_redirect"),
    ("GET /a HTTP/1.1\r\nHost: h\r\nCookie: s=abc123; theme=dark\r\nX-Note: zx;qv\r\n\r\n", "uncertain", 0, 1, ""),
]


@query("select c_custkey, verdict, attacks, uncertain, threats from customer join (values " + ", ".join(f"({k}, {_lit(v)}, {a}, {u}, {_lit(x)})" for k, (_, v, a, u, x) in enumerate(REQUESTS)) + f") k(kind, verdict, attacks, uncertain, threats) on c_custkey % {len(REQUESTS)} = kind")
def c_known_requests(spark, d):
    """The verdict and the threats of whole requests whose outcome is known; paths are left out."""
    raw = t(spark, d, "customer").select("c_custkey", _picked(F.col("c_custkey"), [r[0] for r in REQUESTS]).alias("raw"))
    found = cascade.detect_distinct(fields.explode_requests(raw, "c_custkey", "raw").where("location <> 'path'"))
    told = cascade.threats(found, "c_custkey").select("c_custkey", F.array_join(F.transform("threats", lambda x: F.concat_ws(":", x["location"], x["name"], x["layer"], F.array_join(x["rule_hits"], ","))), " ").alias("threats"))
    verdicts = cascade.request_verdicts(found, "c_custkey").select("c_custkey", "verdict", "attacks", "uncertain")
    return verdicts.join(told, "c_custkey", "left").select("c_custkey", "verdict", "attacks", "uncertain", F.coalesce("threats", F.lit("")).alias("threats"))


@query("select conv_id, turn, role = 'user' as discussion from conversations")
def p_known_discussions(spark, d):
    """A question about SQL is a discussion, in a field of text and without anything executable; the same with a delay in it isn't."""
    from ..functions import gates

    asked = F.concat(F.lit("What is the difference between SELECT and JOIN? How is UNION used? "), F.col("turn").cast("string"))
    text = F.when(F.col("role") == "user", asked).otherwise(F.concat(asked, F.lit(" sleep(1.1)")))
    made = gates.security_discussion(F.lit("content"), text, F.lit("body"), text)
    return t(spark, d, "conversations").select("conv_id", "turn", made.alias("discussion"))
