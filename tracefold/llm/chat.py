"""Chat formatting: heterogeneous conversation layouts -> canonical turns -> one reversible template.

**Layouts.** A record's layout is the set of its nested field paths (``[]`` stands for any array element). Its
fingerprint, a hash of the sorted paths, selects a declarative mapping: which paths hold the conversation's
id, the turn's place, the role and the text. ``canonical_turns`` reads typed tables by their schema;
``json_turns`` reads JSON records whose layouts differ from row to row. Fields that no mapping names do not count, so
a record with more fields than its layout's keeps its turns. An unknown layout raises (typed tables) or is reported (JSON
rows keep ``layout`` and have no turns). Mappings are data: add one to ``LAYOUTS``.

**Template.** A turn is ``### <role>``, a line feed, the text, and a line ``</turn>``. Inside roles and texts every
backslash, ``#`` and ``<`` (and in a role every line feed) gets a backslash before it, so no control string can
appear in them: between turns, and only there, a line begins with an unescaped ``</turn>``, and a role ends at its
first unescaped line feed. Reading back splits there and drops the backslashes. The loss mask lists the code point spans of the assistant's escaped texts.

Defined results: null texts and roles are empty ones; only the exact role ``assistant`` is under the mask. Turns
are ordered by (turn, role, text), a null turn first, so repeated turns have a defined order; all rows with a null
``conv_id`` are one conversation. An empty table gives no rows. Other columns and fields are not read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from hashlib import blake2b

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSISTANT = "assistant"
OPEN, CLOSE = "### ", "\n</turn>\n"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns. Paths are dotted; ``turns`` is the array of turns, or None for one turn a row.

    ``fixed`` lists (role, path, more paths joined by a blank line) for layouts with one field per role instead.
    """

    paths: tuple[str, ...]
    conv: str = ""
    order: str = ""
    turns: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    """Hash of the sorted field paths."""
    return blake2b("\n".join(sorted(set(paths))).encode(), digest_size=8).hexdigest()


LAYOUTS = {fingerprint(layout.paths): layout for layout in (
    Layout(("conv_id", "turn", "role", "text"), conv="conv_id", order="turn", role="role", text="text"),
    Layout(("id", "messages[].role", "messages[].content"), conv="id", turns="messages", role="role", text="content"),
    Layout(("id", "conversations[].from", "conversations[].value"), conv="id", turns="conversations", role="from", text="value",
           roles=(("human", "user"), ("gpt", "assistant"))),
    Layout(("id", "instruction", "input", "output"), conv="id",
           fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout(("id", "instruction", "output"), conv="id", fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout(("id", "system", "prompt", "response"), conv="id",
           fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout(("id", "prompt", "response"), conv="id", fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout(("id", "prompt", "completion"), conv="id", fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
)}


KNOWN = frozenset(p for layout in LAYOUTS.values() for p in layout.paths)


def layout_of(paths: list[str]) -> tuple[str, Layout | None]:
    """The fingerprint of the paths that mappings know, and the mapping it selects.

    Where none has exactly these paths (a record holds fields of two layouts), the one mapping that has all its paths
    there and more of them than any other; None if there is none, or two alike.
    """
    known = KNOWN.intersection(paths)
    mark = fingerprint(list(known)) if known else fingerprint(paths)
    if mark in LAYOUTS:
        return mark, LAYOUTS[mark]
    within = sorted((x for x in LAYOUTS.values() if known.issuperset(x.paths)), key=lambda x: -len(x.paths))
    if not within or (len(within) > 1 and len(within[0].paths) == len(within[1].paths)):
        return mark, None
    return mark, within[0]


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Field paths of a Spark type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def value_paths(value: object, at: str = "") -> list[str]:
    """Field paths of a JSON value."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)]
    if isinstance(value, list):
        return [p for v in value for p in value_paths(v, f"{at}[]")] or [f"{at}[]"]
    return [at]


def _role(role: Column, layout: Layout) -> Column:
    out = role
    for name, canonical in layout.roles:
        out = F.when(role == name, canonical).otherwise(out)
    return out


def canonical_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a typed table, by the mapping that its schema's fingerprint selects."""
    _, layout = layout_of(schema_paths(df.schema))
    if layout is None:
        raise ValueError(f"no mapping for the layout {sorted(schema_paths(df.schema))}")
    conv = F.col(layout.conv).alias("conv_id")
    if layout.fixed:
        turns = [F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"),
                          F.concat_ws("\n\n", *[F.when(F.col(p) != "", F.col(p)) for p in paths]).alias("text"))
                 for k, (role, paths) in enumerate(layout.fixed)]
        return df.select(conv, F.inline(F.array(*turns)))
    if layout.turns:
        exploded = df.select(conv, F.posexplode(layout.turns).alias("turn", "item"))
        return exploded.select("conv_id", F.col("turn").cast("long").alias("turn"),
                               _role(F.col(f"item.{layout.role}"), layout).alias("role"), F.col(f"item.{layout.text}").alias("text"))
    return df.select(conv, F.col(layout.order).alias("turn"), _role(F.col(layout.role), layout).alias("role"),
                     F.col(layout.text).alias("text"))


def _json_record(record: str | None) -> tuple[str | None, str | None, list[tuple[int, str | None, str | None]]]:
    """Fingerprint, conversation id and turns of one JSON record (no turns where no mapping fits)."""
    try:
        value = json.loads(record) if record is not None else None
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return None, None, []
    mark, layout = layout_of(value_paths(value))
    if layout is None:
        return mark, None, []

    def text(v: object) -> str | None:
        return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    conv, roles = text(value.get(layout.conv)), dict(layout.roles)
    if layout.fixed:
        return mark, conv, [(k, role, "\n\n".join(t for p in paths if (t := text(value.get(p)))))
                            for k, (role, paths) in enumerate(layout.fixed)]
    if not layout.turns:
        order = value.get(layout.order)
        items, first = [value], order if isinstance(order, int) else 0
    else:
        items, first = value[layout.turns], 0
    return mark, conv, [(first + k, roles.get(r, r) if isinstance(r := i.get(layout.role), str) else text(r), text(i.get(layout.text)))
                        for k, i in enumerate(items)]


def json_turns(df: DataFrame, column: str = "record") -> DataFrame:
    """(layout, conv_id, turn, role, text) of JSON records of mixed layouts; unknown ones keep a row without a turn."""
    kind = "struct<layout string, conv_id string, turns array<struct<turn long, role string, text string>>>"
    read = F.udf(_json_record, kind, useArrow=True)
    return df.select(read(F.col(column)).alias("r")).select("r.layout", "r.conv_id", F.inline_outer("r.turns"))


# A block of a formatted text: the role up to its first unescaped line feed, then the text.
BLOCK = r"\A### ([^\\\n]*+(?:\\[\s\S][^\\\n]*+)*+)\n([\s\S]*)\z"


def escaped(text: Column, controls: str = r"\\#<") -> Column:
    return F.regexp_replace(text, f"([{controls}])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#<\n])", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): one training text per conversation, and the spans that count for the loss."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escaped(role, r"\\#<\n"), F.lit("\n"))
    rows = turns.select("conv_id", F.struct(
        F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), head.alias("head"), escaped(text).alias("body")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _before).alias("turns"))
    spans = F.aggregate(
        "turns", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("at"),
            F.when(t["role"] == ASSISTANT, F.concat(s["spans"], F.array(F.struct(
                (s["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length")))))
            .otherwise(s["spans"]).alias("spans")), lambda s: s["spans"])
    return sorted_turns.select(
        "conv_id", F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))).alias("formatted"),
        spans.alias("loss_mask"))


def _before(a: Column, b: Column) -> Column:
    """Order of two turns: by turn (null first), role, text."""
    out = F.lit(0)
    for field in ("text", "role", "turn"):
        x, y = a[field], b[field]
        out = (F.when(x.isNull() & y.isNull(), out).when(x.isNull(), -1).when(y.isNull(), 1)
               .when(x < y, -1).when(x > y, 1).otherwise(out))
    return out


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted text holds."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(
        unescaped(F.regexp_extract(b, BLOCK, 1)).alias("role"), unescaped(F.regexp_extract(b, BLOCK, 2)).alias("text")))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask, joined with nothing between."""
    return F.concat_ws("", F.transform(mask, lambda s: unescaped(F.substr(
        formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


def digests(formatted: DataFrame) -> DataFrame:
    """What ``format_turns`` output says when read back, one row per conversation."""
    turns, loss = read_turns(F.col("formatted")), under_mask(F.col("formatted"), F.col("loss_mask"))
    read = formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


# DuckDB twin: the digests follow from the turns themselves; the formatted length from the escapes and the markers.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (
  SELECT *, length(regexp_replace(text, '([\\#<])', '..', 'g')) AS body,
    length(regexp_replace(role, '([\\#<\n])', '..', 'g')) AS head FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(4 + head + 1 + body + 9) AS formatted_chars
  FROM p GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
