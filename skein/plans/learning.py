"""Queries of what the text model is trained on."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import training
from .queries import query, t

WORDS = 400
_GRAMS = """g as (select p_partkey as id, substr(s, i, n) as gram, count(*) as n from (select p_partkey, lower(p_name) as s, n, unnest(range(1, length(p_name) - n + 2)) as i from part, (values (2), (3), (4), (5)) v(n)) group by all),
  v as (select gram, row_number() over (order by sum(n) desc, gram) - 1 as place, ln((1 + (select count(*) from part)) / (1 + count(*))) + 1 as idf from g group by gram having count(*) >= 2 order by place limit 400)"""


def _counts(spark, d):
    return training.gram_counts(t(spark, d, "part"), "p_partkey", "p_name")


@query(f"with {_GRAMS} select gram, cast(place as int) as place, round(idf, 9) as idf from v")
def l_vocabulary(spark, d):
    """The commonest n-grams of two to five characters, numbered, with their weights: no hashing."""
    words = training.vocabulary(_counts(spark, d), t(spark, d, "part").count(), WORDS)
    return words.select("gram", F.col("at").alias("place"), F.round("idf", 9).alias("idf"))


@query(f"with {_GRAMS}, w as (select g.id, (1 + ln(g.n)) * v.idf as w from g join v using (gram)), s as (select id, sqrt(sum(w * w)) as norm, max(w) as most, sum(w) as total, count(*) as cells from w group by id) select p_partkey, coalesce(cells, 0) as cells, coalesce(round(most / norm, 9), 0) as most, coalesce(round(total / norm, 9), 0) as total from part left join s on id = p_partkey")
def l_text_weights(spark, d):
    """Rows as vectors of length 1 over that vocabulary."""
    parts = t(spark, d, "part")
    words = training.vocabulary(_counts(spark, d), parts.count(), WORDS)
    x = training.text_vectors(parts, "p_partkey", "p_name", words, WORDS).select("id", vector_to_array("x").alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, w: a + w)
    return x.select(F.col("id").alias("p_partkey"), F.size(F.filter("x", lambda w: w != 0)).cast("long").alias("cells"), F.round(F.array_max("x"), 9).alias("most"), F.round(total, 9).alias("total"))
