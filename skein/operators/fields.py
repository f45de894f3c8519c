"""Requests to fields: one row for every value of a request, with its name and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import form_decode, let, percent_decode
from ..functions.patterns import ROUTINE_HEADERS

FIELD = "array<struct<name:string,value:string,location:string,idx:int>>"


def target_of(url: Column) -> Column:
    """The request target: the URL without scheme, host and fragment."""
    bare = F.regexp_replace(F.substring_index(url, "#", 1), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    return F.when(bare == "", "/").otherwise(bare)


def query_of(target: Column) -> Column:
    return F.when(F.contains(target, F.lit("?")), F.regexp_replace(target, r"^[^?]*\?", "")).otherwise("")


def query_fields(query: Column, location: str = "query") -> Column:
    """One field per pair, blank values kept, form-decoded."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: form_decode(F.substring_index(p, "=", 1))
    value = lambda p: F.when(F.contains(p, F.lit("=")), form_decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("")
    return F.transform(pairs, lambda p, i: F.struct(name(p).alias("name"), value(p).alias("value"), F.lit(location).alias("location"), i.alias("idx")))


def path_fields(path: Column) -> Column:
    """The whole path, and one field per segment."""
    whole = F.array(F.struct(F.lit("path").alias("name"), path.alias("value"), F.lit("path").alias("location"), F.lit(0).alias("idx")))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.concat(whole, F.transform(segments, lambda s, i: F.struct(F.concat(F.lit("path_seg_"), i.cast("string")).alias("name"), s.alias("value"), F.lit("path").alias("location"), (i + 1).alias("idx"))))


def cookie_fields(header: Column) -> Column:
    """One field per cookie; a bare token has the empty value."""
    pairs = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.trim(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("")
    return F.transform(pairs, lambda p, i: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("name"), value(p).alias("value"), F.lit("cookie").alias("location"), i.alias("idx")))


def header_fields(headers: Column) -> Column:
    """Headers array<struct<name, value>> without cookies, routine ones and browser metadata."""
    named = F.transform(headers, lambda h, i: F.struct(h["name"].alias("name"), h["value"].alias("value"), F.lit("header").alias("location"), i.alias("idx")))
    low = lambda f: F.lower(f["name"])
    return F.filter(named, lambda f: ~low(f).isin(["cookie", *ROUTINE_HEADERS]) & ~F.startswith(low(f), F.lit("sec-fetch-")))


def parse_request(raw: Column) -> dict[str, Column]:
    """Method, target, headers and body of a raw request; headers stop at the first blank line."""
    text = F.replace(raw, F.lit("\r\n"), F.lit("\n"))
    head, body = F.substring_index(text, "\n\n", 1), F.when(F.contains(text, F.lit("\n\n")), F.regexp_replace(text, r"(?s)^.*?\n\n", "")).otherwise("")
    lines = F.split(head, "\n")
    headers = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.contains(x, F.lit(":")))
    headers = F.transform(headers, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    method = F.upper(F.regexp_extract(F.get(lines, F.lit(0)), r"(?i)^([A-Z]+)\s+(\S+)", 1))
    return {"method": method, "target": F.regexp_extract(F.get(lines, F.lit(0)), r"(?i)^[A-Z]+\s+(\S+)", 1), "headers": headers, "body": body}


def explode_urls(df: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, name, value, location, idx) of the URLs of a table: path, segments and query, in one pass."""
    target = target_of(F.col(url_col))
    path = percent_decode(F.substring_index(target, "?", 1))
    return df.select(id_col, F.inline(F.concat(path_fields(path).cast(FIELD), query_fields(query_of(target)).cast(FIELD))))


def explode_requests(df: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    """(id, name, value, location, idx) of raw requests: path, query, body (multipart, JSON, form or raw), headers and cookies."""
    r = parse_request(F.col(raw_col))
    df = df.select(id_col, *(v.alias(k) for k, v in r.items()))
    target = target_of(F.col("target"))
    path = percent_decode(F.substring_index(target, "?", 1))
    low = lambda h: F.lower(h["name"])
    cookies = F.array_join(F.transform(F.filter("headers", lambda h: low(h) == "cookie"), lambda h: h["value"]), ";")
    kind = F.array_join(F.transform(F.filter("headers", lambda h: low(h) == "content-type"), lambda h: h["value"]), ";")
    body = body_fields(F.col("body"), kind)
    return df.select(id_col, F.inline(F.concat(path_fields(path).cast(FIELD), query_fields(query_of(target)).cast(FIELD), body, header_fields(F.col("headers")).cast(FIELD), cookie_fields(cookies).cast(FIELD))))


def multipart_fields(body: Column, content_type: Column) -> Column:
    """Form fields of a multipart body with ``\\n`` line ends; a file gives ``<name>.filename``, its bytes are ignored."""
    of = lambda c, p, g=1: F.regexp_extract(c, p, g)
    edge = r'(?i)\bboundary\s*=\s*(?:"([^"]+)"|([^;\s]+))'
    boundary = F.coalesce(F.nullif(of(content_type, edge), F.lit("")), of(content_type, edge, 2))
    parts = F.transform(F.split(body, F.concat(F.lit("\\Q--"), boundary, F.lit("\\E"))), lambda p: F.regexp_replace(p, r"^[\r\n]+", ""))
    parts = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: (p != "") & ~F.startswith(p, F.lit("--")) & F.contains(p, F.lit("\n\n")))
    told = lambda p: of(F.substring_index(p, "\n\n", 1), r"(?im)^\s*content-disposition:\s*(.*?)\s*$")
    name = lambda p: of(told(p), r'(?i)(?:^|;)\s*name="([^"]*)"')
    file = r'(?i)(?:^|;)\s*filename="([^"]*)"'
    parts = F.filter(parts, lambda p: F.rlike(told(p), F.lit(r"(?i)^form-data(?:;|$)")) & (name(p) != "") & (~F.rlike(told(p), F.lit(file)) | (of(told(p), file) != "")))
    text = lambda p: F.regexp_replace(F.regexp_replace(p, r"(?s)^.*?\n\n", ""), r"[\r\n]+$", "")
    one = lambda p, i: F.when(F.rlike(told(p), F.lit(file)), F.struct(F.concat(name(p), F.lit(".filename")).alias("name"), of(told(p), file).alias("value"), F.lit("body").alias("location"), i.alias("idx"))).otherwise(F.struct(name(p).alias("name"), text(p).alias("value"), F.lit("body").alias("location"), i.alias("idx")))
    usable = (boundary != "") & (F.length(boundary) <= 200)
    return F.when(usable, F.transform(parts, one)).otherwise(F.array().cast(FIELD)).cast(FIELD)


def json_fields(text: Column) -> Column:
    """One body field for every leaf of a JSON text, named by its path (``a.b[0]``), however deep it lies; null where the text is no JSON or
    the bare ``null``.

    Boxes are opened level by level inside the row, as many times as the text's brackets nest (strings left out), so nothing is
    shuffled and no depth is too much. Leaves read as text: booleans as True and False, null as None; numbers lose trailing zeros. The
    fields of an object come in the order of their names.
    """
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]++", "")
    depth = F.struct(F.lit(0).alias("now"), F.lit(1).alias("most"))

    def nest(d: Column, sign: Column) -> Column:
        now = d["now"] + F.when(sign.isin("{", "["), 1).when(sign.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(d["most"], now).alias("most"))

    levels = F.aggregate(F.split(brackets, ""), depth, nest)["most"]

    def opened(x: Column) -> Column:
        kind, name = F.schema_of_variant(x["v"]), x["name"]
        inside = F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>"))
        pairs = F.transform(inside, lambda e: F.struct(F.when(name == "", e["key"]).otherwise(F.concat(name, F.lit("."), e["key"])).alias("name"), e["value"].alias("v")))
        items = F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), lambda e, i: F.struct(F.concat(name, F.lit("["), i.cast("string"), F.lit("]")).alias("name"), e.alias("v")))
        return F.when(F.startswith(kind, F.lit("OBJECT")), pairs).when(F.startswith(kind, F.lit("ARRAY")), items).otherwise(F.array(x))

    def read(v: Column) -> Column:
        plain = F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
        return F.when(F.is_variant_null(v), "None").when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(plain)).otherwise(plain)

    def leaves(parsed: Column) -> Column:
        start = F.array(F.struct(F.lit("").alias("name"), parsed.alias("v")))
        flat = F.aggregate(F.sequence(F.lit(1), levels), start, lambda level, _: F.flatten(F.transform(level, opened)))
        made = F.transform(flat, lambda x, i: F.struct(x["name"].alias("name"), read(x["v"]).alias("value"), F.lit("body").alias("location"), i.alias("idx")))
        return F.when(parsed.isNotNull() & ~F.is_variant_null(parsed), made)

    return let(F.try_parse_json(text), leaves).cast(FIELD)


def json_leaves(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, name, value): every leaf of a JSON text; texts that aren't JSON give nothing."""
    return df.select(id_col, F.inline(json_fields(F.col(json_col)))).select(id_col, "name", "value")


def first_of_each_name(fields: Column) -> Column:
    """``fields`` with the first one of each name, numbered anew."""
    named = F.array_sort(F.transform(fields, lambda f: F.struct(f["name"].alias("name"), f["idx"].alias("idx"), f["value"].alias("value"), f["location"].alias("location"))))
    first = let(named, lambda all_: F.filter(all_, lambda f, i: (i == 0) | (f["name"] != F.get(all_, F.greatest(i - 1, F.lit(0)))["name"])))
    ordered = F.array_sort(F.transform(first, lambda f: F.struct(f["idx"].alias("idx"), f["name"].alias("name"), f["value"].alias("value"), f["location"].alias("location"))))
    return F.transform(ordered, lambda f, i: F.struct(f["name"].alias("name"), f["value"].alias("value"), f["location"].alias("location"), i.alias("idx")))


def body_fields(body: Column, content_type: Column) -> Column:
    """The fields of a body: of a multipart form, else the leaves of JSON, else a form's first value of each name, else the whole text if it isn't blank."""
    text = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    whole = F.when(text == "", F.array().cast(FIELD)).otherwise(F.array(F.struct(F.lit("body").alias("name"), text.alias("value"), F.lit("body").alias("location"), F.lit(0).alias("idx"))).cast(FIELD))
    form = F.contains(body, F.lit("=")) & ~F.contains(body, F.lit("{"))
    parts = let(multipart_fields(body, content_type), lambda p: F.when(F.size(p) > 0, p).otherwise(whole))
    boxed = F.when(F.rlike(text, F.lit(r'^(?:[\[{"\-0-9tf])')), json_fields(body))
    plain = let(boxed, lambda j: F.coalesce(j, F.when(form, first_of_each_name(query_fields(body, "body")).cast(FIELD)).otherwise(whole)))
    return F.when(F.rlike(content_type, F.lit("(?i)^multipart/form-data")), parts).otherwise(plain)


def target_and_agent(raw: Column) -> Column:
    """struct(target, agent) of a raw request: what its first line asks for, and its first User-Agent header."""
    text = F.replace(raw, F.lit("\r\n"), F.lit("\n"))
    head = F.substring_index(text, "\n\n", 1)
    return F.struct(F.regexp_extract(head, r"^\S+[ \t]+(\S+)", 1).alias("target"), F.regexp_extract(head, r"(?im)^user-agent:[ \t]*(.*?)[ \t]*$", 1).alias("agent"))


def raw_request(method: Column, target: Column, host: Column, body: Column) -> Column:
    """The canonical text of a request: upper-case method, target without origin, host, length where there is a body."""
    head = [F.concat_ws(" ", F.upper(method), target_of(target), F.lit("HTTP/1.1")), F.concat(F.lit("Host: "), host)]
    length = F.when(body != "", F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(F.concat_ws("\r\n", *head, length), F.lit("\r\n\r\n"), body)


def input_kind(value: Column) -> Column:
    """What an undeclared input is: request, json, query or scalar."""
    request = F.rlike(value, F.lit(r"(?i)^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|CONNECT|TRACE|PROPFIND|PROPPATCH|MKCOL|COPY|MOVE|LOCK|UNLOCK|REPORT)\s+(.+?)\s+HTTP/\d\.\d"))
    boxed = F.rlike(value, F.lit(r"^\s*[\[{]")) & F.try_parse_json(value).isNotNull()
    return F.when(request, "request").when(boxed, "json").when(F.contains(value, F.lit("=")), "query").otherwise("scalar")


def carrier(location: Column, value: Column) -> Column:
    """struct(carrier, reason): where a value can legally travel; what a header can't hold falls back to the body."""
    fits = ~F.rlike(value, F.lit(r"[\x00-\x1F\x7F]|[^\x00-\xFF]"))
    told = lambda c, r=None: F.struct((F.lit(c) if isinstance(c, str) else c).alias("carrier"), (F.lit(r).cast("string") if not isinstance(r, Column) else r).alias("reason"))
    return (
        F.when(location.isin("query", "body", "path", "filename"), told(location))
        .when(location.isin("header", "cookie") & fits, told(location))
        .when(location.isin("header", "cookie"), told("body_fallback", F.concat(location, F.lit(" value is not representable as one valid HTTP/1.1 field"))))
        .otherwise(told("body_fallback", F.concat(F.lit("unsupported field location: "), location)))
    )


def framing_flags(raw: Column) -> Column:
    """Names of ambiguities in how a raw request frames its body."""
    n = lambda p: F.regexp_count(raw, F.lit(p))
    named = [
        ("CL_TE_ambiguity", (n(r"(?i)content-length:") > 0) & (n(r"(?i)transfer-encoding:") > 0)),
        ("duplicate_content_length", n(r"(?i)content-length:") > 1),
        ("unsupported_transfer_encoding", F.rlike(raw, F.lit(r"(?im)^transfer-encoding:[ \t]*+(?!chunked[ \t]*\r?$)\S"))),
        ("invalid_content_length", F.rlike(raw, F.lit(r"(?im)^content-length:[ \t]*+(?!\d+[ \t]*\r?$)"))),
    ]
    return F.array_compact(F.array(*(F.when(test, F.lit(k)) for k, test in named)))
