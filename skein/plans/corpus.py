"""Queries of corpora: operating points, comparisons, curation, files, models, stateful streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.rule_index import rule_hits
from ..operators import curate, learn, metrics
from ..sources import corpus
from ..streaming import traffic
from .queries import _CELLS, _FIELDS, _HITS, _RATES, ORACLE_SQL, query, t

# --- operating points and comparisons -------------------------------------------------------------------------------
_SCORED = "(select l.doc_id, toxic as label, source as kind, quality = 0 as hard, (n_chars % 97) / 96.0::double as features, (l.doc_id * 31 % 89) / 88.0::double as text from labels l join documents d using (doc_id))"


def _scored(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("source").alias("kind"), ((F.col("n_chars") % 97) / 96.0).cast("double").alias("features"))
    lab = t(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"), (F.col("quality") == 0).alias("hard"), ((F.col("doc_id") * 31 % 89) / 88.0).cast("double").alias("text"))
    return docs.join(lab, "doc_id")


def _weights(first: float, last: float) -> str:
    return f"(select unnest({metrics.weights(first, last)!r}::double[]) as weight)"


@query(f"""with s as (select label, weight, round((1 - weight) * features + weight * text, 9) as score from {_SCORED} cross join {_weights(0.6, 1.0)}),
 k as (select label, weight, least(floor(round((score - 0.01) * 1000, 6)), 980) as cell from s),
 g as (select weight, c.cell, count(*) filter (where label = 1 and k.cell >= c.cell) as tp, count(*) filter (where label = 0 and k.cell >= c.cell) as fp, count(*) filter (where label = 1) as p, count(*) filter (where label = 0) as n from k cross join (select unnest(range(0, 981)) as cell) c group by weight, c.cell),
 m as (select weight, round(cell / 1000.0 + 0.01, 3) as threshold, round(tp / greatest(p, 1), 9) as recall, round(fp / greatest(n, 1), 9) as fpr, round(tp / greatest(tp + fp, 1), 9) as precision, round(2 * tp / greatest(tp + fp + p, 1), 9) as f1 from g)
 select weight, threshold::double as threshold, recall, fpr, precision, f1, round(greatest(0, 0.5 - recall) + greatest(0, fpr - 0.45), 9) as violation from m order by violation, f1 desc, recall desc, fpr, precision desc, threshold desc, weight limit 1""")
def g_grid_point(spark, d):
    return metrics.grid_point(_scored(spark, d), 0.5, 0.45)


def _robust_sql(weights: str) -> str:
    return f"""with s as (select label, kind, hard, weight, round((1 - weight) * features + weight * text, 9) as score from {_SCORED} cross join {weights}),
 b as (select distinct weight, score as threshold from s),
 k as (select b.weight, threshold, kind, count(*) filter (where label = 1 and score >= threshold) as tp, count(*) filter (where label = 1) as p, count(*) filter (where label = 0 and score >= threshold) as fp, count(*) filter (where label = 0) as n, count(*) filter (where label = 1 and hard and score >= threshold) as ht, count(*) filter (where label = 1 and hard) as h from b join s on s.weight = b.weight group by all),
 m as (select weight, threshold, round(sum(tp) / greatest(sum(p), 1), 9) as recall, round(sum(fp) / greatest(sum(n), 1), 9) as fpr, round(2 * sum(tp) / greatest(sum(tp) + sum(fp) + sum(p), 1), 9) as f1, round(sum(tp / p) filter (where p > 0) / greatest(count(*) filter (where p > 0), 1), 9) as macro_recall, round(case when sum(h) > 0 then sum(ht) / sum(h) else sum(tp) / greatest(sum(p), 1) end, 9) as hard_recall from k group by weight, threshold)
 select *, round(0.45 * f1 + 0.35 * macro_recall + 0.20 * hard_recall, 8) as composite from m where recall >= 0.4 and fpr <= 0.6 order by composite desc, macro_recall desc, hard_recall desc, f1 desc, fpr, threshold desc, weight limit 1"""


@query(_robust_sql(_weights(0.5, 0.9)))
def g_robust_point(spark, d):
    return metrics.robust_point(_scored(spark, d), 0.4, 0.6)


@query(_robust_sql("(select 1::double as weight)"))
def g_single_model_point(spark, d):
    return metrics.robust_point(_scored(spark, d), 0.4, 0.6, [1.0])


_SYSTEMS = {"features": "features >= 0.5", "text": "text >= 0.5", "fused": "round(0.3 * features + 0.7 * text, 9) >= 0.5", "all": "true"}
_REPORT = f"with r as ({' union all '.join(f'select {k!r} as system, label = 1 as y, {v} as p from {_SCORED}' for k, v in _SYSTEMS.items())}), c as (select system, {_CELLS} from r group by system), rep as (select *, {_RATES} from c)"


def _systems():
    fused = F.round(0.3 * F.col("features") + 0.7 * F.col("text"), 9)
    return {"features": F.col("features") >= 0.5, "text": F.col("text") >= 0.5, "fused": fused >= 0.5, "all": F.lit(True)}


@query(f"{_REPORT} select * from rep")
def g_systems(spark, d):
    return metrics.by_system(_scored(spark, d), F.col("label") == 1, _systems())


@query(f"{_REPORT} select r.system, round(r.f1 - b.f1, 6) as f1_delta, round(r.recall - b.recall, 6) as recall_delta, round(r.fpr - b.fpr, 6) as fpr_delta from rep r, rep b where b.system = 'features' and r.f1 > b.f1 + 1e-12")
def g_outperformers(spark, d):
    return metrics.outperformers(metrics.by_system(_scored(spark, d), F.col("label") == 1, _systems()), "features")


@query("select event_type, round(list_sort(list(value))[cast(round_even((count(*) - 1) * 0.95, 0) as bigint) + 1], 3) as value from events group by event_type")
def g_nearest_rank(spark, d):
    return metrics.nearest_rank(t(spark, d, "events"), ["event_type"], "value", 0.95)


@query(f"select coalesce(kind, 'union') as source, count(*) filter (where label = 1 and text >= 0.5) / greatest(count(*) filter (where label = 1), 1) as recall, count(*) as n from {_SCORED} group by rollup(kind)")
def g_union_recall(spark, d):
    """Recall of every source, and over the union of all."""
    y, hit = F.col("label") == 1, F.col("text") >= 0.5
    made = _scored(spark, d).rollup("kind").agg((F.count_if(y & hit) / F.greatest(F.count_if(y), F.lit(1))).alias("recall"), F.count("*").alias("n"))
    return made.select(F.coalesce("kind", F.lit("union")).alias("source"), "recall", "n")


@query(f"select doc_id, kind from (select *, row_number() over (partition by label order by doc_id) as k from {_SCORED} where (label = 0 and text >= 0.5)) where k <= 30")
def g_false_positive_examples(spark, d):
    """The first 30 false positives by id: a report's excerpt."""
    return _scored(spark, d).where("label = 0 and text >= 0.5").orderBy("doc_id").limit(30).select("doc_id", "kind")


_NORMAL_HITS = " union all ".join(f"select '{i}' as rule from normal where regexp_matches(text, {P.sql(p)})" for i, _, _, p in P.RULES)


@query(f"with normal as (select text from documents where doc_id in (select doc_id from labels where toxic = 0) union all select html from pages), h as ({_NORMAL_HITS}) select rule, count(*) as false_positives from h group by rule")
def g_rule_false_positives(spark, d):
    """Hits of each rule on ordinary traffic: pages, and texts of documents labelled as clean."""
    clean = t(spark, d, "labels").where("toxic = 0").select("doc_id")
    normal = t(spark, d, "documents").join(clean, "doc_id", "left_semi").select("text").union(t(spark, d, "pages").select("html"))
    return normal.select(F.explode(rule_hits(F.col("text"))).alias("rule")).groupBy("rule").agg(F.count("*").alias("false_positives"))


# --- curation -------------------------------------------------------------------------------------------------------
@query("""with r as (select doc_id, case doc_id % 6 when 0 then 'obfuscated_attack_traffic' when 1 then 'validation' when 2 then 'enriched_traffic' else 'other' end as source_dataset, case when doc_id % 4 = 1 then 'sqli_obf_' || doc_id else 'row_' || doc_id end as id, case when doc_id % 5 = 0 then 'url' end as variant from documents),
 b as (select doc_id, case when source_dataset = 'obfuscated_attack_traffic' then 'dedicated_obfuscated_attack_dataset' when source_dataset = 'enriched_traffic' and coalesce(variant, 'raw') <> 'raw' then 'contrastive_non_raw_variant' when source_dataset = 'validation' and id like '%\\_obf\\_%' escape '\\' then 'validation_obfuscation_id' end as b from r)
 select doc_id, case when b is null then 'original' else 'obfuscated' end as representation, coalesce(b, 'no_explicit_obfuscation_derivation') as basis from b""")
def d_representation(spark, d):
    k = F.col("doc_id")
    r = {
        "source_dataset": F.when(k % 6 == 0, "obfuscated_attack_traffic").when(k % 6 == 1, "validation").when(k % 6 == 2, "enriched_traffic").otherwise("other"),
        "id": F.concat(F.when(k % 4 == 1, "sqli_obf_").otherwise("row_"), k.cast("string")), "variant": F.when(k % 5 == 0, "url"), "pair_role": F.lit("attack"),
    }
    return t(spark, d, "documents").select("doc_id", F.inline(F.array(curate.representation(r))))


@query("select level, count(*) as n from (select case when event_id % 5 = 0 then 'protocol' when event_id % 5 = 1 then 'llm_context' when event_id % 5 = 2 then 'context' when event_id % 5 = 3 then 'request' else 'field' end as level from events) group by level")
def d_data_levels(spark, d):
    k = F.col("event_id") % 5
    r = {"protocol_event": F.when(k == 0, F.col("props")), "conversation": F.when(k == 1, F.col("props")), "detection_scope": F.when(k == 2, "authorization_or_request_sequence"), "url": F.when(k == 3, F.lit("/x")), "data_level": F.lit("?")}
    return t(spark, d, "events").groupBy(curate.data_level(r).alias("level")).agg(F.count("*").alias("n"))


@query("select o_orderkey, o_orderpriority || '|' || case when o_orderkey % 3 = 0 then 'organized:' || o_custkey when o_orderkey % 3 = 1 then 'group:' || o_orderstatus else 'content:' || o_orderkey end as grp from orders")
def d_group_identity(spark, d):
    k = F.col("o_orderkey") % 3
    made = curate.group_identity(F.col("o_orderpriority"), F.when(k == 0, F.col("o_custkey")), F.when(k == 1, F.col("o_orderstatus")), F.lit(""), F.col("o_orderkey"))
    return t(spark, d, "orders").select("o_orderkey", made.alias("grp"))


@query("""with recursive g as (select o_orderpriority as kind, cast(o_custkey as varchar) as grp, count(*) as n from orders group by 1, 2),
 c as (select kind, sum(n) as available, least(sum(n), greatest(20, 300)) as cap from g group by kind),
 o as (select g.kind, grp, n, cap, row_number() over (partition by g.kind order by sha256('42|' || grp)) as r from g join c on c.kind = g.kind),
 f as (select kind, r, case when n > 0 then n end as taken, true as kept, grp from o where r = 1
  union all select o.kind, o.r, case when f.taken < cap and f.taken + n <= cap then f.taken + n else f.taken end, f.taken < cap and f.taken + n <= cap, o.grp from f join o on o.kind = f.kind and o.r = f.r + 1)
 select kind, count(*) as groups, max(taken) as n from f where kept group by kind""")
def d_filled_groups(spark, d):
    """Orders by priority: whole customers up to 300 orders of each priority."""
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_custkey").cast("string").alias("grp"))
    return curate.fill_groups(o, "kind", "grp", "cap_300").groupBy("kind").agg(F.count_distinct("grp").alias("groups"), F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, case when o_orderdate < timestamp '1996-01-01' then 'train' else 'test' end as split from lineitem left join orders on l_orderkey = o_orderkey")
def d_inherited_split(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"), "train").otherwise("test").alias("split"))
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return curate.inherit_split(lines, o, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "split")


@query("with g as (select doc_id % 50 as grp, list_sort(list(distinct toxic)) as labels from labels group by 1) select grp from g where labels <> [0, 1]")
def q_contrast(spark, d):
    """Groups that lack one of the two labels."""
    g = t(spark, d, "labels").groupBy((F.col("doc_id") % 50).alias("grp")).agg(F.array_sort(F.collect_set("toxic")).alias("labels"))
    return g.where(~((F.size("labels") == 2) & F.array_contains("labels", 0) & F.array_contains("labels", 1))).select("grp")


# --- files ----------------------------------------------------------------------------------------------------------
@query("select source, count(*) as n, sum(n_chars) as chars from documents group by source")
def io_json_lines(spark, d):
    """Documents written as JSON lines and read back under their schema."""
    docs = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    place = corpus.scratch(spark)
    docs.write.json(place)
    return corpus.read_lines(spark, [place], docs.schema).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("select source, count(*) as n, 0 as misplaced from documents where lang = 'en' group by source")
def io_partitions(spark, d):
    """Documents written by language and source; only one language's folders are read back."""
    place = corpus.scratch(spark)
    docs = t(spark, d, "documents").select("doc_id", "lang", "source", F.col("lang").alias("declared"))
    corpus.write_shards(docs, place, ["lang", "source"])
    back = spark.read.parquet(place).where("lang = 'en'")
    return back.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") != F.col("declared")).alias("misplaced"))


@query("select event_type, count(*) as n from events group by event_type")
def io_access_log(spark, d):
    """A log with a malformed line after every entry: those lines go."""
    e = t(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("value"))
    place = corpus.scratch(spark)
    e.withColumn("value", F.explode(F.array("value", F.concat(F.lit("{broken "), F.col("value"))))).write.text(place)
    log = corpus.read_log(spark, [place], t(spark, d, "events").select("event_id", "event_type").schema)
    return log.groupBy("event_type").agg(F.count("*").alias("n"))


@query("select count(*) as files, count(*) filter (where doc_id % 10 = 0) as placeholders, count(*) filter (where doc_id % 10 <> 0 and trim(text) = '') as empty from documents")
def io_placeholders(spark, d):
    text = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(corpus.POINTER), F.lit("v1\noid x"))).otherwise(F.col("text"))
    why = t(spark, d, "documents").select(corpus.unreadable(text).alias("why"))
    return why.agg(F.count("*").alias("files"), F.count_if(F.col("why") == "placeholder").alias("placeholders"), F.count_if(F.col("why") == "empty").alias("empty"))


@query("select doc_id, source, case when doc_id % 3 = 0 then 'test' when doc_id % 3 = 1 then 'validation' else 'unspecified' end as split from documents where source is not null")
def io_origins(spark, d):
    k = F.col("doc_id") % 3
    path = F.concat(F.lit("file:/data/"), F.col("source"), F.when(k == 1, "/validation/part.json").otherwise("/part.json"))
    made = corpus.origin(path, F.when(k == 0, "TEST").otherwise("odd"))
    return t(spark, d, "documents").where("source is not null").select("doc_id", F.inline(F.array(made)))


@query("select event_id, ts as at from events where event_id % 3 <> 2")
def w_iso_times(spark, d):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise("soon")
    return t(spark, d, "events").select("event_id", corpus.parse_time(text).alias("at")).where("at is not null")


# --- sequences ------------------------------------------------------------------------------------------------------
@query("select conv_id, bool_or(role = 'user' and regexp_matches(lower(text), 'ignore|system prompt|reveal')) as asked, bool_or(role = 'assistant' and contains(lower(text), 'ok')) as answered from conversations group by conv_id")
def x_conversation_checks(spark, d):
    """Markers in the user's turns, and a canary in the answers."""
    low = F.lower("text")
    asked, answered = (F.col("role") == "user") & F.rlike(low, F.lit("ignore|system prompt|reveal")), (F.col("role") == "assistant") & F.contains(low, F.lit("ok"))
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.bool_or(asked).alias("asked"), F.bool_or(answered).alias("answered"))


@query("select doc_id, len(regexp_extract_all(text, '[A-Za-z]+:')) as aliases from documents where len(regexp_extract_all(text, '[A-Za-z]+:')) > 0")
def x_batch_size(spark, d):
    return t(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[A-Za-z]+:")).cast("long").alias("aliases")).where("aliases > 0")


@query("select o_orderkey, c_nationkey <> o_custkey % 25 as foreign_owner from orders join customer on o_custkey = c_custkey")
def x_context_mismatch(spark, d):
    """Observed against allowed: the owner's nation and the one that a request claims."""
    both = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.select("o_orderkey", (F.col("c_nationkey") != F.col("o_custkey") % 25).alias("foreign_owner"))


# --- models ---------------------------------------------------------------------------------------------------------
@query("with b as (select doc_id, lower(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as s from documents), g as (select distinct doc_id, substr(s, cast(i as int), 3) as gram from (select doc_id, s, unnest(range(1, length(s) - 1)) as i from b)) select gram, count(*) as documents from g group by gram having count(*) >= 2")
def l_ngram_frequencies(spark, d):
    return learn.ngram_frequencies(t(spark, d, "documents"), "text", 3)


@query()
def l_models(spark, d):
    """Both models and their fusion, trained on hash-split labelled documents, judged on the test part."""
    docs = t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.join(t(spark, d, "labels").where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("double").alias("label")), "doc_id")
    rows = learn.with_features(rows, "text").withColumn("split", curate.hash_split(F.col("doc_id").cast("string")))
    rows = rows.persist()  # both fits pass over it; the n-grams, many times the text, are cut anew and neither shuffled nor kept
    grams = learn.char_ngrams(F.col("text"), 4, 4)
    train, test = (rows.where(part).withColumn("grams", grams) for part in ("split <> 'test'", "split = 'test'"))
    text, feats = learn.text_model(train, "label"), learn.feature_model(train.drop("grams", "text"), "label")
    done = learn.scored(feats, learn.scored(text, test, "by_text").drop("grams", "text"), "by_features").withColumn("fused", 0.3 * F.col("by_features") + 0.7 * F.col("by_text"))
    return learn.evaluate(done, "label", {"text": "by_text", "features": "by_features", "fused": "fused"})


# --- streams --------------------------------------------------------------------------------------------------------
@query(ORACLE_SQL["w_scanner_score"])
def s_scanner(spark, d):
    """The stateful detector over the event stream; the same scores as the batch windows."""
    return traffic.drain(traffic.scanner_stream(traffic.event_stream(spark, d)), "append")


@query(f"with {_FIELDS} select page_id, count(*) as fields from f group by page_id")
def s_detections(spark, d):
    """Requests as a stream to the detection log, then counted."""
    log = traffic.drain(traffic.detection_stream(traffic.page_stream(spark, d)), "append")
    return log.groupBy("page_id").agg(F.count("*").alias("fields"))
