"""Chat-client messages <-> model messages.

Model messages are kept in long form, one row per part:
(run_id, pos, kind request|response, part_pos, part_kind, content, tool_name, tool_call_id, args).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import order_tool_returns

RUN = "run_id"
TOOL_CALLS = "array<struct<id: string, function: struct<name: string, arguments: string>>>"
PART_COLS = ["run_id", "pos", "kind", "part_pos", "part_kind", "content", "tool_name", "tool_call_id", "args"]


def load_messages(ui: DataFrame) -> DataFrame:
    """client messages -> model message parts.

    system / user -> a request with one prompt part (NULL content -> '');
    assistant -> a response with a text part (if the text is non-empty) then one
    tool-call part per call; dropped when it has neither; tool -> a request
    with a tool-return part, dropped without a call id; name defaults to 'unknown'.
    """
    s_null = F.lit(None).cast("string")

    def part(df, kind, part_pos, part_kind, content, tool_name=s_null, tool_call_id=s_null, args=s_null):
        return df.select(RUN, "pos", F.lit(kind).alias("kind"), part_pos.cast("int").alias("part_pos"),
                         F.lit(part_kind).alias("part_kind"), content.alias("content"), tool_name.alias("tool_name"),
                         tool_call_id.alias("tool_call_id"), args.alias("args"))

    role = F.col("role")
    content = F.coalesce(F.col("content"), F.lit(""))
    prompts = part(ui.where(role == "system"), "request", F.lit(0), "system-prompt", content) \
        .unionByName(part(ui.where(role == "user"), "request", F.lit(0), "user-prompt", content))
    asst = ui.where(role == "assistant").withColumn("__has_text", F.coalesce(F.col("content"), F.lit("")) != "")
    texts = part(asst.where("__has_text"), "response", F.lit(0), "text", F.col("content"))
    calls = asst.select(RUN, "pos", "__has_text", F.posexplode("toolCalls").alias("i", "tc"))
    call_parts = part(calls, "response", F.col("i") + F.col("__has_text").cast("int"), "tool-call", s_null,
                      F.col("tc.function.name"), F.col("tc.id"), F.col("tc.function.arguments"))
    tools = ui.where((role == "tool") & (F.coalesce(F.col("toolCallId"), F.lit("")) != ""))
    returns = part(tools, "request", F.lit(0), "tool-return", content,
                   F.when(F.coalesce(F.col("name"), F.lit("")) == "", F.lit("unknown")).otherwise(F.col("name")),
                   F.col("toolCallId"))
    return prompts.unionByName(texts).unionByName(call_parts).unionByName(returns)


def decoded_args(args: Column) -> Column:
    """Call arguments as a model reads them: a JSON object stays, JSON text of one is decoded, anything else is empty."""
    v = F.try_parse_json(args)
    inner = F.try_parse_json(F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    inner_obj = F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False))
    return F.when(is_obj, args).when(inner_obj, F.variant_get(v, "$", "string")).otherwise(F.lit("{}"))


def ordered_parts(parts: DataFrame) -> DataFrame:
    """the parts of loaded messages with ``pos`` renumbered so that every tool return follows its call."""
    m = parts.groupBy(RUN, "pos").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("part_kind") == "tool-call", F.struct("part_pos", "tool_call_id")))),
                    lambda x: x["tool_call_id"]).alias("call_ids"),
        F.max(F.when(F.col("part_kind") == "tool-return", F.col("tool_call_id"))).alias("return_id"))
    order = order_tool_returns(m)
    return parts.join(order, [RUN, "pos"]).withColumn("pos", F.col("new_pos")).select(*PART_COLS)


def request_history(parts: DataFrame) -> DataFrame:
    """the history that a request's own messages give: all parts but those of a last message of user prompts."""
    trailing = parts.groupBy(RUN, "pos").agg(F.bool_and(F.col("part_kind") == "user-prompt").alias("prompt"))
    last = trailing.groupBy(RUN).agg(F.max("pos").alias("pos"), F.max_by("prompt", "pos").alias("prompt")).where("prompt")
    return parts.join(last.select(RUN, "pos"), [RUN, "pos"], "left_anti").select(*PART_COLS)


def dump_messages(parts: DataFrame) -> DataFrame:
    """model message parts -> client messages.

    Every request part becomes its own message; every response becomes one
    assistant message with its texts joined and its calls (id, name, arguments)
    collected (NULL when there are none).  The collect is per message (bounded by its parts).
    """
    req = parts.where(F.col("kind") == "request").select(
        RUN, "pos", F.col("part_pos").alias("sub"),
        F.when(F.col("part_kind") == "system-prompt", F.lit("system"))
         .when(F.col("part_kind") == "user-prompt", F.lit("user")).otherwise(F.lit("tool")).alias("role"),
        F.col("content"), F.lit(None).cast(TOOL_CALLS).alias("toolCalls"),
        F.when(F.col("part_kind") == "tool-return", F.col("tool_call_id")).alias("toolCallId"),
        F.when(F.col("part_kind") == "tool-return", F.col("tool_name")).alias("name"))
    resp = parts.where(F.col("kind") == "response").groupBy(RUN, "pos").agg(
        F.array_sort(F.collect_list(F.when(F.col("part_kind") == "text", F.struct("part_pos", "content")))).alias("t"),
        F.array_sort(F.collect_list(F.when(F.col("part_kind") == "tool-call",
                                           F.struct("part_pos", "tool_call_id", "tool_name", "args")))).alias("c"))
    resp = resp.select(
        RUN, "pos", F.lit(0).alias("sub"), F.lit("assistant").alias("role"),
        F.when(F.size("t") > 0, F.array_join(F.transform("t", lambda x: x["content"]), "")).alias("content"),
        F.when(F.size("c") > 0, F.transform("c", lambda x: F.struct(
            x["tool_call_id"].alias("id"), F.struct(x["tool_name"].alias("name"), x["args"].alias("arguments")).alias("function"))))
        .cast(TOOL_CALLS).alias("toolCalls"),
        F.lit(None).cast("string").alias("toolCallId"), F.lit(None).cast("string").alias("name"))
    return req.unionByName(resp)


def history_for_run(requests: DataFrame, state: DataFrame) -> DataFrame:
    """where a request's history comes from.

    A stored run wins ('store'); a continuation without a stored run is an
    error row; otherwise the request's own messages minus a trailing user prompt
    (``request_history`` gives these). State has one row per run, so the requests of
    a busy run are split by Spark's skew join, without copying any state row.
    """
    st = state.select(RUN, F.col("messages").alias("stored_messages"), F.lit(True).alias("__stored"))
    j = requests.join(st, RUN, "left")
    stored = F.coalesce(F.col("__stored"), F.lit(False))
    source = (F.when(stored, F.lit("store"))
              .when(F.col("is_continuation"), F.lit("error"))
              .otherwise(F.lit("request")))
    n_hist = F.when(source == "request",
                    F.col("n_messages") - F.when(F.col("last_role") == "user", 1).otherwise(0))
    return j.select(RUN, "turn", source.alias("source"), n_hist.alias("n_history"),
                    F.when(stored, F.col("stored_messages")).alias("stored_messages"),
                    F.when(source == "error", F.lit("run_id not found in run_store for continuation")).alias("error"))
