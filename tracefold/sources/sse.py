"""Event-stream text (S9, S10): chunks <-> ``data: {json}`` lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import is_object_at


def chunk_json(chunks: DataFrame, with_seq: bool = False) -> Column:
    """The wire form of a chunk: the common fields and those of its kind (camelCase), NULLs of a kind's fields kept.

    ``input`` and ``usage`` are JSON values. ``index`` (W3), the accumulated ``content`` (W1) of text chunks and the
    error's ``code`` are taken from columns ``index``, ``content`` and ``error_code`` where the table has them. The wire has no ``seq``; ``with_seq``
    adds it for readers that must put frames of many files back in order.
    """
    t, have = F.col("type"), set(chunks.columns)
    null = F.lit(None).cast("string")
    text = F.coalesce(F.col("content"), null) if "content" in have else null
    call = F.struct(F.col("tool_call_id").alias("id"), F.lit("function").alias("type"),
                    F.struct(F.col("tool_name").alias("name"), F.col("arguments").alias("arguments")).alias("function"))
    tool = [F.col("tool_call_id").alias("toolCallId"), F.col("tool_name").alias("toolName"), F.try_parse_json("input").alias("input")]
    index = F.col("index") if "index" in have else F.lit(None).cast("long")
    code = F.col("error_code") if "error_code" in have else null
    fields = {
        "content": [text.alias("content"), F.col("delta"), F.col("role")],
        "thinking": [text.alias("content"), F.col("delta")],
        "tool_call": [index.alias("index"), call.alias("toolCall")],
        "tool_result": [F.col("tool_call_id").alias("toolCallId"), F.col("content")],
        "tool-input-available": tool,
        "approval-requested": [*tool, F.struct(F.col("tool_call_id").alias("id"), F.lit(True).alias("needsApproval")).alias("approval")],
        "error": [F.struct(F.col("error_message").alias("message"), code.alias("code")).alias("error")],
        "done": [F.col("finish_reason").alias("finishReason"), F.try_parse_json("usage").alias("usage")],
    }
    common = [F.col("run_id").alias("id"), F.col("model"), F.col("timestamp"), t.alias("type")]
    common += [F.col("seq")] if with_seq else []
    keep = {"ignoreNullFields": "false"}
    return F.coalesce(*[F.when(t == kind, F.to_json(F.struct(*common, *own), keep)) for kind, own in fields.items()],
                      F.to_json(F.struct(*common), keep))


def encode_sse(chunks: DataFrame, with_seq: bool = False) -> DataFrame:
    """One ``data: {json}\\n\\n`` frame per chunk (non-ASCII kept as is)."""
    return chunks.select("run_id", "seq", F.concat(F.lit("data: "), chunk_json(chunks, with_seq), F.lit("\n\n")).alias("frame"))


# what is trimmed off lines and payloads; a regular expression would try every place of a long line
BLANKS = " \t\n\x0b\f\r"


def parse_sse_lines(lines: DataFrame, col: str = "value", strict: bool = False) -> DataFrame:
    """Keep JSON objects from event-stream lines.

    Lines are trimmed; blanks, ``[DONE]`` and text that is not a JSON object are
    dropped.  ``data:`` is stripped; bare lines are kept as payloads too, unless
    ``strict`` (then only ``data: `` lines count).
    """
    line = F.btrim(F.col(col), F.lit(BLANKS))
    is_data = line.startswith("data:")
    payload = F.when(is_data, F.btrim(F.substring(line, 6, 1 << 30), F.lit(BLANKS))).otherwise(line)
    keep = (line != "") & (payload != "[DONE]")
    if strict:
        keep = keep & F.col(col).startswith("data: ")
    v = F.try_parse_json(payload)
    out = lines.where(keep).select("*", payload.alias("payload"), v.alias("__v"))
    return out.where(is_object_at(F.col("__v"), "$")).drop("__v")


# a capture's lines are numbered from its first frame's time in milliseconds, times this
CAPTURE_STRIDE = 1 << 20


def capture_lines(captures: DataFrame, col: str = "value") -> DataFrame:
    """The lines of whole captures, one capture a row, with ``capture_seq``: each line's place in its run's order.

    The wire numbers no frames, so the place comes from the capture itself: the line's position, after the time of the
    capture's first frame. A run that goes on in another response (a continuation) has its frames in another, later
    capture, and these come behind. Position is unique within a capture of any length.
    """
    lines = captures.select("*", F.split(F.col(col), "\r\n|\n|\r").alias("__lines"))
    first = F.try_element_at(F.filter("__lines", lambda x: x.rlike(r"^\s*(data:)?\s*\{")), F.lit(1))
    began = F.get_json_object(F.regexp_replace(first, r"^\s*(data:)?\s*", ""), "$.timestamp").try_cast("long")
    timed = lines.withColumn("__began", F.coalesce(began, F.lit(0).cast("long")))
    out = timed.select(*[F.col(c) for c in captures.columns if c != col], "__began", F.posexplode("__lines").alias("__at", col))
    return out.withColumn("capture_seq", F.col("__began") * CAPTURE_STRIDE + F.col("__at")).drop("__began", "__at")


def read_sse(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """S9 over captured stream files (one line per row)."""
    return parse_sse_lines(spark.read.text(path), "value", strict)


def stream_fields(parsed: DataFrame) -> DataFrame:
    """The common chunk fields out of parsed payloads."""
    p = F.col("payload")
    return parsed.select(F.get_json_object(p, "$.id").alias("run_id"),
                         F.get_json_object(p, "$.seq").try_cast("long").alias("seq"),
                         F.get_json_object(p, "$.type").alias("type"),
                         F.get_json_object(p, "$.toolCall.function.name").alias("call_tool"),
                         F.get_json_object(p, "$.error.message").alias("error_message"))
