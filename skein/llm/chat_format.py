"""Chat formatting with DataFrame functions only: schema fingerprints select declarative mappings to canonical turns.

A layout is known by the SHA-256 of its sorted nested field paths (names and kinds of values, whatever else the table
holds). Every mapping is data: which columns (or JSON fields) give the conversation, the position, the role and the text.
Turns are written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``\\`` becomes ``\\\\`` and ``<|``
becomes ``<\\|`` (and a line feed inside a role ``\\n``), so that no text can contain a control string, and reading back
gives the same characters.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>\n"


def paths_of(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type: ``a.b``, arrays as ``a[]``; leaves carry text, number or other."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, f"{prefix}[]")
    return [f"{prefix}:{'text' if isinstance(kind, T.StringType) else 'number' if isinstance(kind, T.NumericType) else 'other'}"]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: Declarative mappings by name: the field paths that make the layout, and where turns come from. ``turns`` lists
#: (role column or literal, text column) for layouts with one row a conversation; ``each`` names an array and its
#: role and text fields; ``row`` is one row a turn. Roles are renamed by ``ROLES``.
LAYOUTS: dict[str, dict] = {
    "turn_rows": {"paths": ["conv_id:number", "turn:number", "role:text", "text:text"], "row": ("turn", "role", "text")},
    "messages": {"paths": ["conv_id:number", "messages[].role:text", "messages[].content:text"], "each": ("messages", "role", "content")},
    "sharegpt": {"paths": ["conv_id:number", "conversations[].from:text", "conversations[].value:text"], "each": ("conversations", "from", "value")},
    "prompt_completion": {"paths": ["conv_id:number", "prompt:text", "completion:text"], "turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt_response": {"paths": ["conv_id:number", "prompt:text", "response:text"], "turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    "instruction": {"paths": ["conv_id:number", "instruction:text", "input:text", "output:text"], "turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "system_instruction": {"paths": ["conv_id:number", "system:text", "instruction:text", "input:text", "output:text"], "turns": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
BY_FINGERPRINT = {fingerprint(x["paths"]): name for name, x in LAYOUTS.items()}


def layout_of(df: DataFrame) -> str:
    """The mapping of a table: the known layout whose fingerprint is that of the table's own paths among the paths that
    layouts use. Other columns don't matter; where several layouts fit, the one with most paths does."""
    own = set(paths_of(df.schema))
    fits = [BY_FINGERPRINT[fingerprint(sorted(own & set(x["paths"])))] for x in LAYOUTS.values() if fingerprint(sorted(own & set(x["paths"]))) in BY_FINGERPRINT]
    if not fits:
        raise ValueError(f"no mapping for the layout {sorted(own)}")
    return max(fits, key=lambda n: (len(LAYOUTS[n]["paths"]), n))


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _role(column: Column) -> Column:
    plain = F.lower(F.trim(column))
    return _text(F.coalesce(*(F.when(plain == k, F.lit(v)) for k, v in ROLES.items()), column))


def _turn_of(role: str, text: str):
    return lambda m: F.struct(_role(m[role]).alias("role"), _text(m[text]).alias("text"))


def canonical_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table in any known layout. Null texts and roles are empty; missing turns of a
    one-row layout (a null column) are left out; extra columns are dropped."""
    name = layout_of(df)
    rule = LAYOUTS[name]
    if "row" in rule:
        turn, role, text = rule["row"]
        return df.select("conv_id", F.col(turn).cast("long").alias("turn"), _text(F.col(role)).alias("role"), _text(F.col(text)).alias("text"))
    if "each" in rule:
        array, role, text = rule["each"]
        return df.select("conv_id", F.posexplode(array).alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), _role(F.col("m")[role]).alias("role"), _text(F.col("m")[text]).alias("text"))
    made = F.array(*(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *(F.when(F.col(c) != "", F.col(c)) for c in cols)).alias("text"), F.coalesce(*(F.col(c) for c in cols)).isNotNull().alias("there")) for role, cols in rule["turns"]))
    return df.select("conv_id", F.posexplode(F.filter(made, lambda m: m["there"])).alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


def canonical_json_turns(df: DataFrame, json_col: str = "record") -> DataFrame:
    """(conv_id, turn, role, text) of rows (conv_id, JSON text) that may each have a layout of their own.

    The fingerprint of a row hashes the sorted field paths of its JSON (as Spark's variant schema names them); rows of
    unknown layouts or broken JSON keep one turn with the role ``unknown`` and the text as it stands.
    """
    v = F.try_parse_json(F.col(json_col))
    df = df.select("conv_id", F.col(json_col).alias("raw"), F.sha2(F.schema_of_variant(v), 256).alias("fp"))
    get = lambda path: F.get_json_object("raw", path)
    known, turns = [], F.lit(None).cast("array<struct<role:string,text:string>>")
    for rule in LAYOUTS.values():
        fields = [p.split(":")[0] for p in rule["paths"] if not p.startswith("conv_id")]
        if "each" in rule:
            array, role, text = rule["each"]
            shape = f"OBJECT<{array}: ARRAY<OBJECT<{', '.join(f'{f}: STRING' for f in sorted((role, text)))}>>>"
            rows = F.from_json(get(f"$.{array}"), f"array<struct<`{role}`:string,`{text}`:string>>")
            made = F.transform(rows, _turn_of(role, text))
        elif "turns" in rule:
            shape = f"OBJECT<{', '.join(f'{f}: STRING' for f in sorted(fields))}>"
            made = F.array(*(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *(F.when(get(f"$.{c}") != "", get(f"$.{c}")) for c in cols)).alias("text")) for role, cols in rule["turns"]))
        else:
            continue
        known.append((hashlib.sha256(shape.encode()).hexdigest(), made))
    for key, made in known:
        turns = F.when(F.col("fp") == key, made).otherwise(turns)
    turns = F.coalesce(turns, F.array(F.struct(F.lit("unknown").alias("role"), _text(F.col("raw")).alias("text"))))
    return df.select("conv_id", F.posexplode(turns).alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


def escape(column: Column) -> Column:
    return F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(column: Column) -> Column:
    return F.replace(escape(column), F.lit("\n"), F.lit("\\n"))


def unescape(column: Column) -> Column:
    return F.when(F.contains(column, F.lit("\\")), F.regexp_replace(column, r"(?s)\\(.)", "$1")).otherwise(column)


def unescape_role(column: Column) -> Column:
    """``\\n`` is a line feed only where its ``\\`` isn't itself the second of an escaped pair."""
    line_feeds = F.regexp_replace(column, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.when(F.contains(column, F.lit("\\")), F.regexp_replace(line_feeds, r"(?s)\\(.)", "$1")).otherwise(column)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of canonical turns, one row per conversation.

    Turns stand in order of (turn, role, text), so ties and repeated rows have a fixed place and all stay. ``loss_spans``
    are the code-point ranges [begin, end) of the assistants' texts in ``formatted``. A null conv_id is a conversation
    of its own; an empty table gives an empty one. Sorting is by an external sort inside each conversation's partition;
    the formatted string of one conversation is one value and must fit in a row.
    """
    piece = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.withColumn("piece", piece).withColumn("n", F.row_number().over(order)).withColumn("end", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("end") - F.length(escape(F.col("text")))).alias("begin"), F.col("end").alias("end")))
    rows = rows.select("conv_id", F.struct("n", "piece", span.alias("span")).alias("t"))
    done = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return done.select("conv_id", F.array_join("t.piece", "").alias("formatted"), F.filter("t.span", lambda s: s.isNotNull()).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns array<struct<role, text>> of a formatted string."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    body = F.transform(parts, lambda p: F.substr(p, F.lit(len(START) + 1)))
    at = lambda b: F.position(F.lit("\n"), b)
    return F.transform(body, lambda b: F.struct(unescape_role(F.substr(b, F.lit(1), at(b) - 1)).alias("role"), unescape(F.substr(b, at(b) + 1)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")
