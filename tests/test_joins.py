"""Addresses against the standard library, interval joins and late rows against plain loops."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import addresses, intervals
from skein.streaming import late


def read(text):
    try:
        return ipaddress.ip_address(text.strip())
    except ValueError:
        return None


def drawn():
    rng = random.Random(4)
    fixed = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "1:::2", ":1", "1:", "::ffff:1.2.3.4", "::1.2.3.256", "1:2:3:4:5:6:1.2.3.4", "g::", "12345::", "", "FE80::A", "0:0:1:0:0:0:1:0", "1:0:0:2:0:0:0:3", " 10.0.0.1 "]
    made = []
    for _ in range(300):
        groups = [rng.choice(["0", "0", "0000", "1", "ab", "FFFF"]) for _ in range(8)]
        made += [":".join(groups), str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))), ".".join(str(rng.randrange(260)) for _ in range(4))]
    return fixed + made


def test_addresses_read_and_written(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(drawn())], "i int, a string").withColumn("d", addresses.address_digits(F.col("a")))
    for r in df.withColumn("t", addresses.address_text(F.col("d"))).collect():
        want = read(r["a"])
        assert (r["d"], r["t"]) == ((None, None) if want is None else (str(want.version) + want.packed.hex(), str(want))), r["a"]


def test_longest_prefix(spark):
    rng = random.Random(8)
    nets = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.3/32", "10.1.2.0/23", "::/0", "2001:db8::/33", "2001:db8:8000::/47", "2001:db8::5", "bad", "1.2.3.4/40", "10.1.0.9/16"]
    hosts = [f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(5)}" for _ in range(200)] + [f"2001:db8:{rng.choice(['', '8000:', '8001:', '8002:', '7fff:'])}:{rng.randrange(9)}" for _ in range(200)] + [None, "x"]
    usable = [(n, ipaddress.ip_network(n, strict=False)) for n in sorted(nets) if n not in ("bad", "1.2.3.4/40")]
    found = addresses.longest_prefix(spark.createDataFrame([(h,) for h in hosts], "h string"), "h", spark.createDataFrame([(n,) for n in nets], "cidr string"), "cidr").collect()
    assert len(found) == len(hosts)
    for r in found:
        a = read(r["h"]) if r["h"] else None
        holding = [(-net.prefixlen, n) for n, net in usable if a is not None and a.version == net.version and a in net]
        assert (r["network"], r["prefix_length"]) == ((min(holding)[1], -min(holding)[0]) if holding else (None, None)), r
    assert addresses.longest_prefix(spark.createDataFrame([("1.1.1.1",)], "h string"), "h", spark.createDataFrame([("bad",)], "cidr string"), "cidr").first()["network"] is None


def test_intervals(spark):
    rng = random.Random(9)
    points = [(k, rng.choice("ab"), rng.choice([None, rng.randrange(-200, 5000)])) for k in range(300)]
    held = [(k, rng.choice("ab"), b := rng.randrange(-300, 5000), b + rng.choice([-1, 0, 1, 7, 64, 4000])) for k in range(200)]
    p, i = spark.createDataFrame(points, "p int, key string, at long"), spark.createDataFrame(held, "i int, key string, begin long, end long")
    got = intervals.interval_join(p, i, ["key"], "at", "begin", "end").select("p", "i").collect()
    want = [(x[0], y[0]) for x in points for y in held if x[1] == y[1] and x[2] is not None and y[2] <= x[2] <= y[3]]
    assert sorted(map(tuple, got)) == sorted(want) and want
    assert intervals.interval_join(p, i.where("false"), ["key"], "at", "begin", "end").count() == 0
    assert "Cartesian" not in (plan := intervals.interval_join(p, i, ["key"], "at", "begin", "end")._jdf.queryExecution().toString()) and "NestedLoop" not in plan


@pytest.mark.parametrize("delay, late_ids", [("10 seconds", {4}), ("0 seconds", {4, 5}), ("1 hour", set())])
def test_no_late_row_is_lost(spark, tmp_path, delay, late_ids):
    batches = [[(1, 100), (2, 160)], [(3, 200), (4, 120), (5, 155)], [(6, 195), (7, None)]]
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, "id int, s long").withColumn("at", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return late.split_late(stream, "at", delay, str(tmp_path / "out"))

    in_time, behind = run()
    more = {6} if delay == "0 seconds" else set()  # 195 is behind 200
    assert {r["id"] for r in behind.collect()} == late_ids | more | {7}
    assert sorted(r["id"] for r in in_time.union(behind).collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert sorted(r["id"] for d in run() for r in d.collect()) == [1, 2, 3, 4, 5, 6, 7]  # nothing new: nothing twice
    assert {r["late"] for r in late.corrected(in_time, behind, [F.lit("all").alias("of")], n=F.count("*")).collect()} == {len(late_ids | more) + 1}
