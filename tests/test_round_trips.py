"""The five encodings of the u_*_round_trip queries over texts of any alphabet, not the ASCII ones only."""

import pytest
from pyspark.sql import functions as F

from skein.functions import decode as D

WAYS = {
    "percent": (D.percent_encode_all, D.percent_decode),
    "double_percent": (lambda c: F.replace(D.percent_encode_all(c), F.lit("%"), F.lit("%25")), lambda c: D.percent_decode_layers(c)[0]),
    "base64": (lambda c: F.base64(F.encode(c, "UTF-8")), lambda c: D.base64_decode(F.regexp_replace(c, r"\s", ""))),
    "hex": (lambda c: F.lower(F.hex(F.encode(c, "UTF-8"))), D.hex_decode),
    "unicode": (D.unicode_escape_all, D.unicode_unescape),
}


@pytest.mark.parametrize("way", WAYS)
def test_round_trip_of_all_documents(spark, data, way):
    encode, decode = WAYS[way]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text")
    df = docs.union(spark.createDataFrame([("plain words and é ü ñ 中文 €",), ("plain words and \U0001f600 x \U00010348",)], "text string"))
    assert df.where(F.rlike("text", F.lit(r"[^\x00-\x7F]"))).count() > 100
    assert df.where(~F.col("text").eqNullSafe(decode(encode(F.col("text"))))).count() == 0
