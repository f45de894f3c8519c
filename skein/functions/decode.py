"""Decoders and structural steps as column functions. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

def _quoted(text: str) -> str:
    for char, code in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = text.replace(char, code)
    return f"'{text}'"


#: The standard library's table of character references as one map literal.
_NAMED = "map(" + ", ".join(f"{_quoted(k[:-1])}, {_quoted(v)}" for k, v in html5.items() if k.endswith(";")) + ")"
#: Names that are also read without a semicolon, longest first.
_OLDEST = "^(" + "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))) + ")"
#: What the numbers 0, 13 and 128 to 159 stand for: read off the standard library's own decoder.
_REPLACED = "map(" + ", ".join(f"{n}, {_quoted(unescape(f'&#{n};'))}" for n in (0, 13, *range(128, 160)) if unescape(f"&#{n};")) + ")"
#: Characters of any script; controls, unassigned ones and separators but the space are not printable.
_PRINTABLE = r"[[\P{C}&&\P{Z}] \t\n\r]"


def percent_decode(c: Column) -> Column:
    """``+`` stays, malformed escapes stay, wrong UTF-8 becomes U+FFFD."""
    escaped = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.contains(c, F.lit("%")), F.try_url_decode(escaped)).otherwise(c)


def form_decode(c: Column) -> Column:
    """As ``percent_decode``, with ``+`` for a space."""
    return percent_decode(F.replace(c, F.lit("+"), F.lit(" ")))


def percent_decode_layers(c: Column, layers: int = 3) -> tuple[Column, Column]:
    """Decodes until nothing changes, ``layers`` times at most; and how many times something changed."""
    depth, now = F.lit(0), c
    for _ in range(layers):
        after = percent_decode(now)
        depth = depth + F.when(after != now, 1).otherwise(0)
        now = after
    return now, depth


def looks_percent_encoded(c: Column) -> Column:
    n = F.regexp_count(c, F.lit("%[0-9A-Fa-f]{2}"))
    return (n >= 2) | ((n > 0) & (3 * n >= 0.1 * F.length(F.regexp_replace(c, r"\s", ""))))


def looks_base64(c: Column) -> Column:
    """Alphabet, length and padding of Base64 (either alphabet); plain words of letters alone don't look like it."""
    bare = F.regexp_replace(c, "=+$", "")
    return (F.length(c) >= 8) & F.rlike(c, F.lit(r"^[A-Za-z0-9+/_-]+={0,2}$")) & (F.length(bare) % 4 != 1) & (F.rlike(c, F.lit(r"[0-9+/=_-]")) | (F.length(c) >= 24))


def _utf8(raw: Column) -> Column:
    return F.decode(F.when(F.is_valid_utf8(raw.cast("string")), raw), "UTF-8")


def base64_text(c: Column) -> Column:
    """The text of a value that is known to be Base64, however short; null if it is no Base64 of UTF-8. Both alphabets, padded or not."""
    bare = F.regexp_replace(F.translate(c, "-_", "+/"), "=+$", "")
    padded = F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4)).cast("int")))
    return _utf8(F.try_to_binary(padded, F.lit("base64")))


def base64_decode(c: Column, least: float = 0.65) -> Column:
    """The text, if the value looks like Base64 and decodes to UTF-8 that is mostly printable; else null."""
    text = base64_text(c)
    return F.when(looks_base64(c) & (F.regexp_count(text, F.lit(_PRINTABLE)) >= least * F.length(text)) & (F.length(text) > 0), text)


def hex_text(c: Column) -> Column:
    """The text of a value that is known to be hexadecimal, however short; null if it is no UTF-8 in hexadecimal digits."""
    return _utf8(F.try_to_binary(c, F.lit("hex")))


def hex_decode(c: Column, least: float = 0.7) -> Column:
    """The text, if the value looks like hexadecimal digits of mostly printable UTF-8; else null."""
    text = hex_text(c)
    return F.when((F.length(c) >= 8) & F.rlike(c, F.lit("^(?:[0-9A-Fa-f]{2})+$")) & (F.regexp_count(text, F.lit(_PRINTABLE)) > least * F.length(text)), text)


def html_decode(c: Column) -> Column:
    """The five basic entities, the apostrophe's number last of all the ampersand."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


_UNIT, _PAIR = r"\\u(?:[0-9A-CE-Fa-ce-f][0-9A-Fa-f]|[dD][0-7])[0-9A-Fa-f]{2}", r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}"
#: Escapes of characters; well-formed UTF-16 as one run, however long.
ESCAPES = rf"\\U00(?:10|0[0-9A-Fa-f])[0-9A-Fa-f]{{4}}|(?:{_UNIT}|{_PAIR})++|\\u[0-9A-Fa-f]{{4}}"


def unicode_unescape(c: Column) -> Column:
    """``\\uXXXX`` and ``\\UXXXXXXXX`` to characters, two units of a surrogate pair to one: the parts between escapes,
    zipped with the decoded escapes. Escapes that follow each other are one run of UTF-16 and decoded together."""
    parts, found = F.split(c, ESCAPES), F.regexp_extract_all(c, F.lit(f"({ESCAPES})"))
    chars = F.transform(found, lambda h: F.when(F.length(h) > 10, F.decode(F.unhex(F.replace(h, F.lit("\\u"), F.lit(""))), "UTF-16BE")).otherwise(F.decode(F.unhex(F.lpad(F.substring(h, 3, 8), 8, "0")), "UTF-32")))
    return F.array_join(F.zip_with(parts, chars, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")


# Soft hyphen, joiners, fillers, zero-width and bidirectional controls, byte order mark.
INVISIBLE = "[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff]"


def strip_invisible(c: Column) -> Column:
    """Without zero-width, bidirectional and soft-hyphen controls."""
    return F.regexp_replace(c, INVISIBLE, "")


def nfkc(c: Column) -> Column:
    """Unicode's form NFKC, by the ICU library that Spark brings along; values of ASCII alone don't reach it."""
    folded = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), folded).otherwise(c)


def fingerprint_form(c: Column) -> Column:
    """Two percent layers, white space squeezed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(percent_decode_layers(c, 2)[0], r"\s+", " ")))


def sql_comments(c: Column) -> tuple[Column, Column]:
    """Block comments: their text stays, blank ones go; and their number."""
    pattern = r"(?s)/\*!?\d*\s*(.*?)\s*\*/"
    return F.regexp_replace(F.regexp_replace(c, pattern, "$1"), r"(?s)/\*.*?\*/", ""), F.regexp_count(c, F.lit(pattern))


def general_comments(c: Column) -> tuple[Column, Column]:
    line, page, block = r"(?<!:)//[^\n\r]*", r"(?s)<!--.*?-->", r"(?s)/\*.*?\*/"
    n, now = F.lit(0), c
    for p in (line, page, block):
        n, now = n + F.regexp_count(now, F.lit(p)), F.regexp_replace(now, p, "")
    return now, n


def squeeze_space(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"[\n\r]{2,}", "\n")


#: Segments of a path that are walked together: what a walk carries along is copied at every step, so it must stay short.
_TOGETHER = 128


def _cancelled(text: Column) -> Column:
    """``text`` (a path's segments, each with its slash) without the names that a later ``..`` takes back; a ``..`` that finds no name moves to the front.

    Blocks of segments are walked from the right, a ``..`` dropping the next name that isn't dropped yet. What a block leaves
    over for the block before it is known from two counts of each block, so the blocks are walked apart, in linear time.
    """
    segments = lambda block: let(F.split(block, "/"), lambda x: F.reverse(F.slice(x, 1, F.size(x) - 1)))
    state = lambda a, b: F.struct(a.cast("int").alias("dots"), b.alias("rest"))

    def count(now: Column, segment: Column) -> Column:
        name = F.when(now["dots"] > 0, state(now["dots"] - 1, now["rest"])).otherwise(state(now["dots"], now["rest"] + 1))
        return F.when(segment == "..", state(now["dots"] + 1, now["rest"])).otherwise(name)

    def walk(now: Column, segment: Column) -> Column:
        name = F.when(now["dots"] > 0, state(now["dots"] - 1, now["rest"])).otherwise(state(now["dots"], F.concat(segment, F.lit("/"), now["rest"])))
        return F.when(segment == "..", state(now["dots"] + 1, now["rest"])).otherwise(name)

    def joined(blocks: Column) -> Column:
        counts = F.transform(blocks, lambda b: F.aggregate(segments(b), state(F.lit(0), F.lit(0)), count))
        passed = F.aggregate(counts, F.array(F.lit(0)), lambda now, c: F.concat(now, F.array(F.greatest(F.element_at(now, -1) - c["rest"], F.lit(0)) + c["dots"])))

        def made(passed: Column) -> Column:
            kept = F.transform(blocks, lambda b, k: F.aggregate(segments(b), state(F.get(passed, k), F.lit("")), walk)["rest"])
            return F.concat(F.repeat(F.lit("../"), F.element_at(passed, -1)), F.array_join(F.reverse(kept), ""))

        return let(passed, made)

    return let(F.reverse(F.regexp_extract_all(text, F.lit(rf"((?:[^/]*+/){{1,{_TOGETHER}}}+)"))), joined)


def fold_path(c: Column) -> Column:
    """Back-slashes, repeated slashes, ``/./``, ``/x/../`` and four dots before a slash, each until nothing is left to fold.

    The first segment is never taken back, and the last never takes one. Four or more dots lose two at a time, so that an even
    number leaves two and an odd one three.
    """
    c = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/{2,}", "/"), r"/(?:\./)+", "/")

    def folded(c: Column) -> Column:
        first, last = F.substring_index(c, "/", 1), F.substring_index(c, "/", -1)
        inner = F.substr(c, F.length(first) + 2, F.length(c) - F.length(first) - F.length(last) - 1)
        return F.concat(first, F.lit("/"), _cancelled(inner), last)

    c = let(c, lambda c: F.when(F.contains(c, F.lit("/../")), folded(c)).otherwise(c))
    return F.regexp_replace(F.regexp_replace(c, r"(?<!\.)\.\.(?:\.\.)+(\.?)/", "..$1/"), r"/\.$", "/")


def percent_encode_all(c: Column) -> Column:
    """Every byte escaped; white space stays as it is."""
    return F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")


def unicode_escape_all(c: Column) -> Column:
    """Every UTF-16 unit as \\uXXXX, so characters beyond U+FFFF as two."""
    return F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(....)", "\\\\u$1")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def from_code_point(n: Column) -> Column:
    """The character of a code point; null for surrogates and beyond U+10FFFF."""
    good = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(good, n)), 8, "0")), "UTF-32")


def numeric_reference(digits: Column, base: int) -> Column:
    """The character that a numeric reference names in HTML 5: Windows-1252 for the C1 range, U+FFFD for what is no character, nothing for
    controls and non-characters."""
    n = F.when(F.length(F.regexp_replace(digits, "^0+", "")) > 8, F.lit(0x110000)).otherwise(F.conv(digits, base, 10).cast("bigint"))

    def char(n: Column) -> Column:
        replaced = F.try_element_at(F.expr(_REPLACED), n.cast("int"))
        nothing = n.between(1, 8) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n == 0xB) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        unreal = n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        return F.when(unreal, "\ufffd").when(replaced.isNotNull(), replaced).when(nothing, "").otherwise(F.coalesce(from_code_point(n), F.lit("\ufffd")))

    return let(n, char)


def html_decode_all(c: Column) -> Column:
    """Every character reference as browsers read it: named ones, the oldest also without their semicolon and as the beginning of a longer word,
    decimal and hexadecimal ones. Unknown ones stay. One pass."""
    pattern = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
    parts, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern))

    def named(r: Column) -> Column:
        begin = F.regexp_extract(r, _OLDEST, 1)
        short = F.when(begin != "", F.concat(F.element_at(F.expr(_NAMED), F.when(begin != "", begin).otherwise("amp")), F.substr(r, F.length(begin) + 1)))
        whole = F.when(F.endswith(r, F.lit(";")), F.try_element_at(F.expr(_NAMED), F.regexp_replace(r, ";$", "")))
        return F.coalesce(whole, short, F.concat(F.lit("&"), r))

    def char(r: Column) -> Column:
        digits = F.regexp_replace(r, "^#[xX]?|;$", "")
        return F.when(F.rlike(r, F.lit("^#[xX]")), numeric_reference(digits, 16)).when(F.startswith(r, F.lit("#")), numeric_reference(digits, 10)).otherwise(named(r))

    whole = F.array_join(F.zip_with(parts, F.transform(found, char), lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    return F.when(F.contains(c, F.lit("&")), whole).otherwise(c)


def string_concat(c: Column) -> tuple[Column, Column]:
    """Adjacent quoted literals joined by ``+``, ``CONCAT`` or pipes become one; every join counts two."""
    n, now = F.lit(0), c
    for p in (r"'([^']*)'\s*\+\s*'([^']*)'", r"(?i)CONCAT\s*\(\s*'([^']*)'\s*,\s*'([^']*)'\s*\)", r"'([^']*)'\s*\|\|\s*'([^']*)'"):
        n, now = n + 2 * F.regexp_count(now, F.lit(p)), F.regexp_replace(now, p, "'$1$2'")
    return now, n


def peeled(c: Column) -> Column:
    """Array: the value, its URL-safe Base64 reading if there is one, and up to three percent layers of both."""
    bare = F.trim(c)
    shaped = F.length(bare).between(8, 8192) & F.rlike(bare, F.lit(r"^[A-Za-z0-9_+\-/]+={0,2}$"))
    padded = F.concat(F.regexp_replace(F.translate(bare, "-_", "+/"), "=+$", ""), F.repeat(F.lit("="), F.pmod(-F.length(F.regexp_replace(bare, "=+$", "")), F.lit(4)).cast("int")))
    read = let(F.try_to_binary(F.when(shaped, padded), F.lit("base64")), lambda raw: F.decode(F.when(F.is_valid_utf8(raw.cast("string")), raw), "UTF-8"))
    first = F.array_compact(F.array(c, read))
    layers = [first]
    for _ in range(2):
        layers.append(F.transform(layers[-1], percent_decode))
    return F.array_distinct(F.concat(*layers))
