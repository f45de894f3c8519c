"""Addresses and networks of both families: reading, canonical text, and the longest prefix that holds an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import let

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _v4_digits(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, r"\."), lambda x: F.lpad(F.lower(F.hex(x.cast("int"))), 2, "0")), "")


def address_digits(c: Column) -> Column:
    """``4`` or ``6`` and the address in hexadecimal digits (8 or 32); null for anything that isn't an address. Zones aren't read."""
    low = F.lower(F.trim(c))
    tail = F.regexp_extract(low, rf"^[0-9a-f:]*:({_V4})$", 1)
    digits = _v4_digits(F.when(tail != "", tail).otherwise("0.0.0.0"))
    whole = F.when(tail != "", F.concat(F.regexp_replace(low, rf"{_V4}$", ""), F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4))).otherwise(low)

    def groups(s: Column) -> Column:
        return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":"))

    def read(s: Column) -> Column:
        short = F.contains(s, F.lit("::"))
        left, right = groups(F.substring_index(s, "::", 1)), F.when(short, groups(F.substring_index(s, "::", -1))).otherwise(F.array().cast("array<string>"))
        n = F.size(left) + F.size(right)
        good = F.forall(F.concat(left, right), lambda g: F.rlike(g, F.lit("^[0-9a-f]{1,4}$"))) & F.when(short, n <= 7).otherwise(n == 8) & (F.regexp_count(s, F.lit("::")) <= 1) & ~F.contains(s, F.lit(":::"))
        wide = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")
        return F.when(good, F.concat(F.lit("6"), wide(left), F.repeat(F.lit("0"), 4 * (8 - n)), wide(right)))

    return F.when(F.rlike(low, F.lit(f"^{_V4}$")), F.concat(F.lit("4"), _v4_digits(low))).when(F.contains(low, F.lit(":")), let(whole, read))


def address_text(digits: Column) -> Column:
    """The canonical text of ``address_digits``: the first longest run of zero groups shortened, mapped IPv4 with its dots."""
    number = lambda at: F.conv(F.substr(digits, F.lit(at), F.lit(2)), 16, 10)
    dots = lambda first: F.concat_ws(".", *(number(first + 2 * k) for k in range(4)))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.regexp_replace(F.substr(digits, 4 * k + 2, F.lit(4)), "^0{1,3}", ""))

    def shortened(s: Column) -> Column:
        runs = [(k, rf"^(.*?)(?:^|:)0(?::0){{{k - 1}}}(?:$|:)(.*)$") for k in range(8, 1, -1)]
        return F.coalesce(*(F.when(F.rlike(s, F.lit(p)), F.regexp_replace(s, p, "$1::$2")) for _, p in runs), s)

    mapped = F.startswith(digits, F.lit("6" + "0" * 20 + "ffff"))
    return F.when(digits.isNull(), None).when(F.startswith(digits, F.lit("4")), dots(2)).when(mapped, F.concat(F.lit("::ffff:"), dots(26))).otherwise(let(F.array_join(groups, ":"), shortened))


def prefix_key(digits: Column, length: Column | int) -> Column:
    """The first ``length`` bits of an address, with its family and their number: equal for the addresses of one network."""
    n = F.lit(length) if isinstance(length, int) else length
    whole, rest = F.floor(n / 4).cast("int"), (n % 4).cast("int")
    nibble = F.conv(F.substr(digits, whole + 2, F.lit(1)), 16, 10).cast("int").bitwiseAND(F.get(F.array(*map(F.lit, (0, 8, 12, 14))), rest))
    return F.concat(F.substr(digits, F.lit(1), whole + 1), F.when(rest > 0, F.lower(F.hex(nibble))).otherwise(""), F.lit("/"), n.cast("string"))


def network(cidr: Column) -> Column:
    """struct(digits, length) of a network; host bits don't matter, an address alone is a network of its own. Null for anything else."""
    digits = address_digits(F.substring_index(cidr, "/", 1))
    bits = F.when(F.startswith(digits, F.lit("4")), 32).otherwise(128)
    told = F.when(F.contains(cidr, F.lit("/")), F.when(F.rlike(cidr, F.lit(r"/\d{1,3}$")), F.substring_index(cidr, "/", -1).cast("int"))).otherwise(bits)
    return let(F.struct(digits.alias("digits"), told.alias("length"), bits.alias("bits")), lambda x: F.when(x["digits"].isNotNull() & (x["length"] <= x["bits"]), F.struct(x["digits"].alias("digits"), x["length"].alias("length"))))


def longest_prefix(df: DataFrame, address: str, networks: DataFrame, cidr: str) -> DataFrame:
    """``df`` with ``network`` (the text in ``cidr`` of the smallest network that holds the address, or null) and ``prefix_length``.

    One equi-join on the prefixes of the lengths that occur among the networks, 162 at most: no address meets a network that doesn't hold
    it. Each distinct address is looked up once, so a busy client costs no more than a quiet one. Of networks that are written twice
    the smaller text counts; networks and addresses that can't be read hold and match nothing.
    """
    nets = networks.select(F.col(cidr).alias("network"), network(F.col(cidr)).alias("n")).where("n is not null")
    nets = nets.groupBy(prefix_key(F.col("n.digits"), F.col("n.length")).alias("_key"), F.col("n.length").alias("prefix_length")).agg(F.min("network").alias("network"))
    lengths = sorted((r[0], r[1]) for r in networks.select(network(F.col(cidr)).alias("n")).where("n is not null").select(F.substring("n.digits", 1, 1), "n.length").distinct().collect())
    once = df.select(F.col(address).alias("_address")).distinct().withColumn("_digits", address_digits(F.col("_address"))).where("_digits is not null")
    keys = F.array(*(F.when(F.startswith("_digits", F.lit(family)), prefix_key(F.col("_digits"), n)) for family, n in lengths)) if lengths else F.array().cast("array<string>")
    met = once.select("_address", F.explode(F.array_compact(keys)).alias("_key")).join(nets, "_key")
    best = met.groupBy("_address").agg(F.max_by(F.struct("network", "prefix_length"), "prefix_length").alias("_best"))
    return df.join(best, F.col(address) == F.col("_address"), "left").select(*df.columns, "_best.network", "_best.prefix_length")


def effective_client(peer: Column, forwarded: Column, trusted: list[str]) -> Column:
    """The client behind trusted proxies, in canonical text: forwarded hops from right to left until one isn't trusted; a bad one gives the
    peer. A peer that isn't an address is given back as it is."""
    import ipaddress

    nets = [ipaddress.ip_network(c, strict=False) for c in trusted]
    known = [(str(n.version), n.prefixlen, str(n.version) + n.network_address.packed.hex()) for n in nets]

    def inside(digits: Column) -> Column:
        tests = [F.startswith(digits, F.lit(family)) & (prefix_key(digits, n) == prefix_key(F.lit(net), n)) for family, n, net in known]
        return F.coalesce(F.array_max(F.array(*tests)), F.lit(False)) if tests else F.lit(False)

    def walked(peer_digits: Column) -> Column:
        hops = F.transform(F.reverse(F.split(forwarded, ",")), lambda h: address_digits(h))

        def chosen(hops: Column) -> Column:
            outside = F.filter(hops, lambda h: h.isNull() | ~inside(h))
            stop = F.when(F.size(outside) > 0, F.get(outside, F.lit(0))).otherwise(F.element_at(hops, -1))
            return address_text(F.coalesce(stop, peer_digits))

        direct = (F.coalesce(forwarded, F.lit("")) == "") | ~inside(peer_digits)
        return F.when(peer_digits.isNull(), peer).when(direct, address_text(peer_digits)).otherwise(let(hops, chosen))

    return let(address_digits(peer), walked)
