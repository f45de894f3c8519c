"""Predicates of context: discussions, documentation, encoded primitives, routine values, exploit families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .decode import peeled

# Markers of a discussion, fields of human text, shapes that are active, technical terms.
DISCUSSION = [
    "怎么", "如何", "什么", "区别", "用法", "函数", "教程", "文档", "示例", "解释",
    "how ", "what ", "difference", " use ", "function", "tutorial", "documentation", "example", "explain",
    "違い", "使い", "使用", "方法", "教え", "何です", "차이", "사용", "방법", "무엇",
    "diferencia", "cómo", "como ", "usar", "función", "ejemplo",
    "différence", "comment ", "utiliser", "fonction", "exemple",
    "unterschied", "wie ", "verwenden", "funktion", "beispiel",
    "diferença", "função",
    "разниц", "как ", "использов", "функц", "пример",
    "الفرق", "كيف", "استخدام", "دالة", "مثال",
]
TECHNICAL_DISCUSSION = [
    "怎么", "如何", "什么", "区别", "用法", "函数", "教程", "文档", "示例", "解释", "how ", "what ", "difference", "tutorial",
    "documentation", "example", "explain", "차이점", "무엇", "어떻게", "사용", "教えて", "使い方", "違い", "diferencia", "cómo", "como ",
    "différence", "comment ", "unterschied", "wie ", "diferença", "الفرق", "كيف", "разниц", "как ",
]
DOCUMENTED = ["教程", "文档", "示例", "tutorial", "documentation", "example"]
TEXT_FIELDS = ["content", "question", "comment", "description", "title", "message", "body", "text", "post", "query", "q"]
TERMS = "select|join|union|insert|update|delete|where|script|iframe|onload|onerror|curl|wget|base64|jwt|sleep|benchmark|sql|xss|csrf|xxe|ssti"
DISCUSSION_TERMS = r"(?iU)\b(?:select|join|union|insert|update|delete|where|script|iframe|onload|onerror|curl|wget|base64|jwt|hs256|rs256|sleep|benchmark|sql|xss|csrf|xxe|ssti)\b"
DANGEROUS = [
    r"\b(?:sleep|pg_sleep|benchmark)\s*\(\s*[^\s)]",
    r"\bunion\s+(?:all\s+)?select\b",
    r"(?:'|\")\s*(?:or|and)\s+[^\r\n]{0,40}(?:=|like)\s*[^\r\n]{0,40}(?:--|#|/\*)?",
    r"\b(?:or|and)\s+\d+\s*=\s*\d+",
    r"<\s*(?:script|iframe|svg|img)\b",
    r"\bon\w+\s*=|javascript\s*:",
    r"(?:^|\s)[;&|]{1,2}\s*(?:cat|id|whoami|curl|wget|bash|sh|powershell|cmd)\b",
    r"\$\(|`[^`]+`|\.\.[/\\]|%0d|%0a|\{\{|\$\{",
]
ACTIVE = [
    r"\bunion\s+(?:all\s+)?select\b",
    r"\b(?:sleep|pg_sleep|benchmark)\s*\(\s*[^)\s]",
    r"['\"]\s*(?:or|and)\s+.{0,50}(?:=|like)",
    r"\b(?:or|and)\s+\d+\s*=\s*\d+",
    r"(?:^|\s)[;&|]{1,2}\s*(?:cat|id|whoami|curl|wget|bash|sh|cmd)\b",
    r"\$\(|`[^`]+`|\.\.[/\\]|%0d|%0a|\{\{|\$\{",
    r"<(?:script|iframe|svg|img)\b",
    r"(?:;\s*(?:drop|alter|truncate|insert|update|delete|create|grant|revoke)\b|\b(?:drop|truncate)\s+(?:table|database|schema)\b|\binsert\s+into\b|\bupdate\s+[a-z0-9_.]+\s+set\b|\bdelete\s+from\b)",
]
SAFE_SELECT = r"(?is)^\s*select\s+[a-z0-9_.*,\s]+\s+from\s+[a-z0-9_.]+\s+where\s+[a-z0-9_.]+\s*=\s*\?\s*;?\s*$"
# Routine values (id, pattern, the only place or None).
ROUTINE: list[tuple[str, str, str | None]] = [
    ("normalized_uuid", r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$", None),
    ("normalized_email", r"(?i)^[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+$", None),
    ("normalized_iso_datetime", r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$", None),
    ("normalized_safe_static_filename", r"(?i)^[a-z0-9][a-z0-9_-]{0,63}\.(?:jpe?g|png|gif|webp|pdf|txt|csv)$", None),
    ("normalized_session_preference_cookie", r"(?i)^session=[a-z0-9]{16,64};\s*theme=(?:light|dark|system);\s*locale=[a-z]{2}(?:-[a-z]{2})?$", "cookie"),
    ("normalized_pagination_query", r"(?i)^(?:(?:page|limit|offset|sort|order|cursor|batch|start|end|timezone)=[a-z0-9_.:+-]+)(?:&(?:page|limit|offset|sort|order|cursor|batch|start|end|timezone)=[a-z0-9_.:+-]+){1,10}$", "query"),
]
# Exploit families by order of preference, and what needs a tag.
SIGNALS: list[tuple[str, str]] = [
    ("sqli", r"(?is)(?:\bunion\s+(?:all\s+)?select\b|['\"]\s*(?:or|and)\s+(?:['\"\d]|true|false)|\b(?:sleep|pg_sleep|benchmark|waitfor|extractvalue|updatexml)\s*\(|\b(?:drop\s+table|into\s+(?:out|dump)file|load_file\s*\())"),
    ("xss", r"(?is)(?:<\s*(?:script|svg|img|iframe|body|input|details|video)\b|\bon\w+\s*=|javascript\s*:|document\.cookie|data:text/html)"),
    ("ssti", r"(?is)(?:\{\{[^{}]{1,500}\}\}|\$\{[^{}]{1,500}\}|<%=?[^%]{1,500}%>|__class__|\.class\.forname)"),
    ("ptrav", r"(?i)(?:\.\.[/\\]|%2e%2e|%252e|/etc/(?:passwd|shadow)|windows[/\\]system32)"),
    ("xxe", r"(?is)(?:<!doctype|<!entity|\bsystem\s+[\"'](?:file|https?):|%\s*\w+\s*;)"),
    ("ssrf", r"(?i)(?:(?:127\.0\.0\.1|0\.0\.0\.0|169\.254\.169\.254|metadata\.google\.internal|localhost)|(?:file|gopher|dict)://|https?://\[(?:::1|0:0:0:0:0:0:0:1)\])"),
    ("nosql", r"(?i)(?:\$(?:ne|gt|gte|lt|lte|where|regex|nin)\b|\{\s*[\"']?\$(?:ne|where|regex))"),
    ("ldap", r"(?i)(?:\(\s*[|&!]\s*\(|\([^)]*=\*\)|\*\)\(|\)\(\|)"),
    ("crlf", r"(?i)(?:%0d|%0a|\\r|\\n|\r|\n)"),
    ("deser", r"(?i)(?:rO0AB|O:\d+:\"|a:\d+:\{|aced0005|gASV|marshal\.loads|yaml\.load|node-serialize)"),
    ("jwt", r"(?i)(?:\"alg\"\s*:\s*\"none\"|eyJhbGciOiJub25l|\"kid\"\s*:\s*\"[^\"]*(?:\.\.|/etc/|/root/|localhost|127\.0\.0\.1))"),
    ("ssi", r"(?i)<!--\s*#(?:exec|include|echo|config|set)\b"),
    ("hsmug", r"(?i)(?:transfer-encoding\s*:\s*(?:chunked|x)|content-length\s*:\s*\d+[\s\S]{0,160}transfer-encoding|0\r?\n\r?\n(?:get|post)\s+/)"),
    ("fupl", r"(?i)(?:\.(?:php\d*|phtml|phar|asp|aspx|jsp|jspx|war|htaccess)(?:[.\s]|$)|<\?(?:php|=))"),
]
COMMAND = r"(?is)(?:\$\(|`[^`]+`|(?:^|\s|[;&|])(?:cat|id|whoami|uname|curl|wget|nc|bash|sh|powershell|cmd)(?:\s|$)|\$\{?ifs\}?|runtime\.getruntime|processbuilder)"
COMMAND_TAGS = ["rce", "cmdi", "command-injection", "code-injection", "os-command-injection"]
CODE = r"(?is)(?:runtime\.getruntime\s*\(|java\.lang\.runtime|getruntime\(\)|processbuilder|class\.forname\s*\(|create\s+alias\b)"
FAMILY_TAGS = {
    "sqli": ["sqli", "sql-injection"], "xss": ["xss"], "ssti": ["ssti", "template-injection"], "ptrav": ["lfi", "file-read", "path-traversal", "traversal"],
    "xxe": ["xxe"], "ssrf": ["ssrf"], "nosql": ["nosqli", "nosql"], "ldap": ["ldap"], "crlf": ["crlf", "header-injection"], "deser": ["deserialization", "deser"],
    "jwt": ["jwt"], "ssi": ["ssi"], "hsmug": ["request-smuggling", "smuggling"], "fupl": ["file-upload", "upload"],
}
STANDALONE = ["sqli", "xss", "xxe", "deser", "nosql", "ldap", "ssrf"]


def _any_of(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def _any_match(text: Column, patterns: list[str]) -> Column:
    return F.rlike(text, F.lit("(?iU)" + "|".join(f"(?:{p})" for p in patterns)))


def _distinct_terms(text: Column, pattern: str) -> Column:
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.lower(x))))


def security_discussion(name: Column, value: Column, location: Column, restored: Column) -> Column:
    """A question about security or databases in a field of human text, without anything executable."""
    text = F.lower(F.concat(value, F.lit("\n"), restored))
    empty = F.rlike(text, F.lit(r"(?iU)\b(?:sleep|pg_sleep|benchmark)\s*\(\s*\)"))
    field = location.isin("body", "query") & F.lower(name).isin(TEXT_FIELDS)
    return field & (F.length(text) <= 4096) & _any_of(text, DISCUSSION) & ~_any_match(text, DANGEROUS) & (empty | (_distinct_terms(text, DISCUSSION_TERMS) >= 2))


def documentation(value: Column) -> Column:
    """Marked documentation whose markup is escaped throughout."""
    low = F.lower(value)
    escaped = (F.contains(low, F.lit("&lt;")) | F.contains(low, F.lit("&#60;"))) & ~F.rlike(value, F.lit("[<>]"))
    return _any_of(low, DOCUMENTED) & escaped


def safe_context(name: Column, value: Column, location: Column, restored: Column) -> Column:
    """A parameterised SELECT, escaped markup in documentation, or a discussion with two technical terms and nothing active."""
    text = F.lower(F.concat(value, F.lit("\n"), restored))
    place = location.isin("body", "query")
    marked = place & F.lower(name).isin([*TEXT_FIELDS, "value"]) & _any_of(text, TECHNICAL_DISCUSSION)
    escaped = _any_of(text, DOCUMENTED) & F.rlike(value, F.lit("(?i)&lt;|&#60;")) & ~F.contains(value, F.lit("<"))
    discussed = ~_any_match(text, ACTIVE) & (_distinct_terms(text, rf"(?i)(?<![A-Za-z0-9_])(?:{TERMS})(?![A-Za-z0-9_])") >= 2)
    return documentation(value) | (place & F.rlike(F.trim(value), F.lit(SAFE_SELECT))) | (marked & (escaped | discussed))


def may_be_safe_context(value: Column) -> Column:
    """Whether ``safe_context`` is asked before the rules."""
    return F.contains(value, F.lit("?")) | F.contains(F.lower(value), F.lit("&lt;")) | _any_of(F.lower(value), TECHNICAL_DISCUSSION)


# Control characters and format strings as they show under encodings.
ENCODED_CONTROL = r"(?i)(?:%0d|%0a|\\r\\n|\\n\\r|[\r\n])"
ENCODED_FORMAT = r"(?:%(?:\d+\$|\d+)?[spxXdn]){3,}"


def encoded_hits(value: Column, location: Column) -> Column:
    """Control characters and format strings under a few layers of encoding."""
    seen = peeled(value)
    control = location.isin("query", "header", "cookie") & F.exists(seen, lambda x: F.rlike(x, F.lit(ENCODED_CONTROL)))
    write = F.exists(seen, lambda x: F.rlike(x, F.lit(ENCODED_FORMAT)))
    return F.array_compact(F.array(F.when(control, F.lit("encoded_control_character_injection")), F.when(write, F.lit("encoded_format_string"))))


def routine(value: Column, location: Column) -> Column:
    """The id of the first routine form that a value has, else null."""
    v = F.trim(value)
    usual = (F.length(v) > 0) & (F.length(v) <= 512) & ~F.rlike(v, F.lit(r"[\x00-\x1F]"))
    return F.coalesce(*(F.when(usual & F.rlike(v, F.lit(p)) & (F.lit(True) if place is None else location == place), F.lit(i)) for i, p, place in ROUTINE))


def family(value: Column, location: Column, tags: Column) -> Column:
    """The exploit family of a value: the first signal that agrees with the tags, then code and commands where tags speak of
    them, then the first signal that stands alone; else null."""
    has = {k: F.rlike(value, F.lit(p)) & ((location != "path") if k == "fupl" else F.lit(True)) for k, p in SIGNALS}
    among = lambda names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
    agreed = [F.when(hit & among(FAMILY_TAGS[k]), F.lit(k)) for k, hit in has.items()]
    run = among(COMMAND_TAGS)
    spoken = [F.when(F.rlike(value, F.lit(CODE)) & run, F.lit("codei")), F.when(F.rlike(value, F.lit(COMMAND)) & run, F.lit("cmdi"))]
    return F.when((value != "") & (F.length(value) <= 8192), F.coalesce(*agreed, *spoken, *(F.when(has[k], F.lit(k)) for k, _ in SIGNALS if k in STANDALONE)))


def allow_list(text: str) -> list[tuple[str, str, str]]:
    """(path, location, folded name) of ``/path:location:name`` entries; a malformed one is an error."""
    made: list[tuple[str, str, str]] = []
    for entry in filter(None, map(str.strip, text.split(","))):
        parts = [p.strip() for p in entry.rsplit(":", 2)]
        good = len(parts) == 3 and parts[0].startswith("/") and not set("?#") & set(parts[0]) and parts[1].lower() in ("query", "body", "header", "cookie") and parts[2]
        if not good:
            raise ValueError(f"not /path:location:name: {entry}")
        made.append((parts[0], parts[1].lower(), parts[2].casefold()))
    return list(dict.fromkeys(made))
