"""Reference-shaped tables derived from the driver tables.

Every derivation here is narrow (per-row) or a partial aggregate, so each table
grows with its input and costs at most one shuffle.  The SQL twins of these
derivations live in ``tracefold.plans.oracle_views`` and must stay in step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# seq of a chunk = turn * TURN_STRIDE + position inside the turn.  Word positions
# use the low range; tool events of a turn use the fixed offsets below.
TURN_STRIDE = 1_000_000_000
SUB_TOOL_CALL = 990_000_000
SUB_REQUEST = 990_000_001
SUB_SEGMENT_DONE = 990_000_002
SUB_DECISION = 990_000_005
SUB_RESULT = 995_000_000
SUB_ERROR = 999_000_000
# Chunk clock: 2024-01-01T00:00:00Z, one hour per conversation, 30 s per turn, 50 ms per word.
EPOCH_MS = 1_704_067_200_000

# event_type -> level of the derived log records.
EVENT_LEVELS = {"error": "error", "view": "debug", "click": "info",
                "signup": "warning", "purchase": "critical"}

# The 16 statement texts of the statement log, picked by event_id % 16.
STATEMENTS = [
    "SELECT * FROM records",
    "SELECT * FROM records WHERE level = 'error' LIMIT 5",
    "SELECT * FROM records LIMIT 5000",
    "select trace_id from records where level = 'info' limit 20",
    "SELECT * FROM records;  ",
    "SELECT * FROM records -- newest first",
    "SELECT * FROM (SELECT * FROM records LIMIT 5000) t LIMIT 10",
    "SELECT * FROM (SELECT * FROM records LIMIT 10) t LIMIT 5000",
    "SELECT * FROM records LIMIT ALL",
    "SELECT * FROM records WHERE array_contains(tags, 'rate-limit')",
    "SELECT * FROM records WHERE message = 'Failed to update'",
    "  SELECT created_at, level FROM records",
    "DROP TABLE records",
    "DELETE FROM records WHERE level = 'debug'; UPDATE records SET level = 'info'",
    "WITH e AS (SELECT * FROM records WHERE level = 'error') SELECT count(*) AS n FROM e",
    "SELECT * INTO backup FROM records",
]


def run_id_of(conv_id: Column) -> Column:
    """``run-`` + the conversation id zero-padded to 8 digits."""
    return F.concat(F.lit("run-"), F.lpad(conv_id.cast("string"), 8, "0"))


# ---------------------------------------------------------------------------
# records (log/trace rows) from events
# ---------------------------------------------------------------------------

def records(events: DataFrame) -> DataFrame:
    """Log records with the fixed 15-column schema (+ event_id, user_id kept for joins)."""
    eid = F.col("event_id")
    start = F.col("ts").cast("timestamp")
    level = F.create_map(*[F.lit(x) for kv in EVENT_LEVELS.items() for x in kv])[F.col("event_type")]
    service = F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string"))
    message = F.concat(F.col("event_type"), F.lit(" "), (eid % 10).cast("string"))
    attributes = (F.when(eid % 5 == 0, F.lit("{}"))
                  .when(eid % 7 == 0, F.lit('{"foobar":false}'))
                  .when(eid % 11 == 0, F.lit('{"foobar":null}'))
                  .otherwise(F.col("props")))
    tags = (F.when(eid % 17 == 0, F.lit(None).cast("array<string>"))
            .when(eid % 13 == 0, F.array(F.lit("production"), F.col("event_type"), F.lit("rate-limit")))
            .otherwise(F.array(F.lit("production"), F.col("event_type"))))
    return events.select(
        start.alias("created_at"),
        start.alias("start_timestamp"),
        (start + F.expr("INTERVAL 100 MILLISECONDS")).alias("end_timestamp"),
        F.concat(F.lit("trace-"), F.col("user_id").cast("string")).alias("trace_id"),
        F.concat(F.lit("span-"), eid.cast("string")).alias("span_id"),
        F.when(eid % 4 != 0, F.concat(F.lit("span-"), (eid - eid % 4).cast("string"))).alias("parent_span_id"),
        level.alias("level"),
        F.concat(service, F.lit(".handler")).alias("span_name"),
        message.alias("message"),
        F.lit('{"type":"object"}').alias("attributes_json_schema"),
        attributes.alias("attributes"),
        tags.alias("tags"),
        (F.col("event_type") == "error").alias("is_exception"),
        F.when(F.col("event_type") == "error", message).alias("otel_status_message"),
        service.alias("service_name"),
        eid.alias("event_id"),
        F.col("user_id"),
    )


def load_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records derived from the ``events`` table of ``sf_dir``."""
    return records(table(spark, sf_dir, "events"))


# ---------------------------------------------------------------------------
# agent-run tables from conversations
# ---------------------------------------------------------------------------

def _conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        run_id_of(F.col("conv_id")).alias("run_id"),
        F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"),
        F.concat(F.lit("model-"), (F.col("conv_id") % 3).cast("string")).alias("model"),
        (F.lit(EPOCH_MS) + F.col("conv_id") * 3_600_000 + F.col("turn") * 30_000).alias("turn_ms"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: one per turn; each user turn owns one tool call."""
    c = _conv(spark, sf_dir)
    call_id = F.concat(F.col("run_id"), F.lit("-"), F.col("turn").cast("string"))
    tool = F.when(F.col("turn") % 4 == 0, F.lit("execute_sql")).otherwise(F.lit("export_csv"))
    return c.select(
        "run_id", F.col("turn").alias("pos"), "role",
        F.col("text").alias("content"),
        F.when(F.col("role") == "user", call_id).alias("call_id"),
        F.when(F.col("role") == "user", tool).alias("call_tool"),
        # an assistant turn returns the call of the turn before it (three turns back when turn % 4 = 3)
        F.when(F.col("role") == "assistant",
               F.concat(F.col("run_id"), F.lit("-"),
                        (F.col("turn") - F.when(F.col("turn") % 4 == 3, 3).otherwise(1)).cast("string"))
               ).alias("return_id"),
    )


# calls of a message with several: their numbers in call order, in which no order of texts is right
CALL_NUMBERS = (10, 2, 1)


def call_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages with several calls each: a user turn makes three, in the order ...-10, ...-2, ...-1; an assistant
    turn is three returns of them in another order (every ninth of a call that was never made)."""
    c = _conv(spark, sf_dir)
    t = F.col("turn")
    tool = [F.when((t + k) % 2 == 0, F.lit("execute_sql")).otherwise(F.lit("export_csv")) for k in range(3)]
    calls = F.array(*[F.struct(F.concat_ws("-", "run_id", t.cast("string"), F.lit(str(n))).alias("call_id"), tool[k].alias("call_tool"))
                      for k, n in enumerate(CALL_NUMBERS)])
    user = F.col("role") == "user"
    asked = c.where(F.col("role") != "assistant").select(
        "run_id", (t * 10).cast("long").alias("pos"), "role", F.when(user, calls).alias("calls"),
        F.when(user, F.transform(calls, lambda x: x["call_id"])).alias("call_ids"), F.lit(None).cast("string").alias("return_id"))
    before = t - F.when(t % 4 == 3, 3).otherwise(1)
    order = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(sorted(CALL_NUMBERS))])
    returned = c.where(F.col("role") == "assistant").select("run_id", "conv_id", "turn", F.explode(order).alias("o")).select(
        "run_id", (t * 10 + F.col("o.k")).cast("long").alias("pos"), F.lit("tool").alias("role"),
        F.lit(None).cast("array<struct<call_id:string,call_tool:string>>").alias("calls"), F.lit(None).cast("array<string>").alias("call_ids"),
        F.concat_ws("-", "run_id", F.when((F.col("conv_id") + t + F.col("o.k")) % 9 == 0, F.lit("lost")).otherwise(before.cast("string")),
                    F.col("o.n").cast("string")).alias("return_id"))
    return asked.unionByName(returned)


def _tool_input(run_id: Column, conv_id: Column, turn: Column) -> Column:
    stmt = F.element_at(F.array(*[F.lit(s) for s in STATEMENTS]), ((conv_id + turn) % 16 + 1).cast("int"))
    art = F.concat(F.lit("a_"), F.substring(run_id, 1, 8), F.lit("_"), (F.floor(turn / 2) + 1).cast("string"))
    return F.when(turn % 4 == 0, F.to_json(F.struct(stmt.alias("sql")))) \
            .otherwise(F.to_json(F.struct(art.alias("artifact_id"))))


def _usage_json(conv_id: Column, turn: Column) -> Column:
    """Raw usage text in one of four alias styles (style = conv_id % 4)."""
    p = (F.lit(100) + turn * 10 + conv_id % 50)
    c = (F.lit(20) + turn * 3)
    t = p + c
    no_prompt = conv_id % 9 == 0
    no_total = conv_id % 2 == 1
    style = conv_id % 4

    def obj(pk, ck, tk):
        fields = []
        fields.append(F.when(~no_prompt, F.concat(F.lit(f'"{pk}":'), p.cast("string"))))
        fields.append(F.concat(F.lit(f'"{ck}":'), c.cast("string")))
        fields.append(F.when(~no_total, F.concat(F.lit(f'"{tk}":'), t.cast("string"))))
        return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))

    return (F.when(style == 0, obj("prompt_tokens", "completion_tokens", "total_tokens"))
            .when(style == 1, obj("promptTokens", "completionTokens", "totalTokens"))
            .when(style == 2, obj("input_tokens", "output_tokens", "total_tokens"))
            .otherwise(obj("inputTokens", "outputTokens", "totalTokens")))


def _envelope_text(run_id: Column, conv_id: Column, turn: Column) -> Column:
    """Tool-result text; variant = (conv_id + turn) % 7 covers valid and broken envelopes."""
    v = (conv_id + turn) % 7
    art = F.concat(F.lit("a_"), F.substring(run_id, 1, 8), F.lit("_"), (F.floor((turn - 1) / 2) + 1).cast("string"))
    rows = (turn * 7 + conv_id % 13).cast("string")
    valid = F.concat(F.lit('{"type":"tool_result","version":1,"message":"Query ran (rows: '), rows,
                     F.lit(')","artifacts":[{"id":"'), art, F.lit('","type":"table","row_count":'), rows,
                     F.lit("}]}"))
    return (F.when(v == 0, valid)
            .when(v == 1, F.lit('{"type":"tool_result","version":1,"message":"Error: query failed","data":{"success":false}}'))
            .when(v == 2, F.lit('{"type":"tool_result","version":2,"message":"newer format"}'))
            .when(v == 3, F.lit('{"type":"other","version":1,"message":"not a tool result"}'))
            .when(v == 4, F.concat(F.lit('{"type":"tool_result","version":1,"artifacts":[{"id":7},{"id":"'),
                                   art, F.lit('","type":"table"}]}')))
            .when(v == 5, F.lit('{"type":"tool_result","version":1}'))
            .otherwise(F.lit("plain text result")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run event log in one wide table (see schemas.CHUNKS).

    Per assistant/system turn: one row per word of the *whole* text (content /
    thinking deltas; position 0 is the part start).  Per user turn: a tool_call and
    then an approval-requested (execute_sql) or tool-input-available (export_csv)
    request; execute_sql requests close a deferred segment with a done(tool_calls).
    Per assistant turn: the tool_result answering the call of the previous turn.
    Per run: a final done, or an error (conv_id % 23 = 0) with no done.
    """
    c = _conv(spark, sf_dir)
    K = F.lit(TURN_STRIDE)
    null_s = F.lit(None).cast("string")
    null_l = F.lit(None).cast("long")

    def row(df, seq, typ, ts, part_index=null_l, is_start=F.lit(None).cast("boolean"), delta=null_s,
            role=null_s, tool_call_id=null_s, tool_name=null_s, arguments=null_s, inp=null_s,
            content=null_s, error_message=null_s, finish_reason=null_s, usage=null_s):
        """One chunk kind as rows of the wide chunk table (columns in schemas.CHUNKS order)."""
        type_col = F.lit(typ) if isinstance(typ, str) else typ
        return df.select(
            F.col("run_id"), seq.cast("long").alias("seq"), type_col.alias("type"),
            F.col("model"), ts.cast("long").alias("timestamp"), part_index.cast("long").alias("part_index"),
            is_start.alias("is_start"), delta.alias("delta"), role.alias("role"),
            tool_call_id.alias("tool_call_id"), tool_name.alias("tool_name"), arguments.alias("arguments"),
            inp.alias("input"), content.alias("content"), error_message.alias("error_message"),
            finish_reason.alias("finish_reason"), usage.alias("usage"))

    # text parts: whole texts, one row per word
    text_turns = c.where(F.col("role").isin("assistant", "system"))
    words = text_turns.select("*", F.posexplode(F.split(F.col("text"), " ")).alias("idx", "word"))
    delta = F.when(F.col("idx") == 0, F.col("word")).otherwise(F.concat(F.lit(" "), F.col("word")))
    typ = F.when(F.col("role") == "assistant", F.lit("content")).otherwise(F.lit("thinking"))
    text_rows = row(words, F.col("turn") * K + F.col("idx"), typ,
                    F.col("turn_ms") + F.col("idx") * 50, part_index=F.lit(0),
                    is_start=F.col("idx") == 0, delta=delta,
                    role=F.when(F.col("role") == "assistant", F.lit("assistant")))

    user = c.where(F.col("role") == "user")
    call_id = F.concat(F.col("run_id"), F.lit("-"), F.col("turn").cast("string"))
    is_sql = F.col("turn") % 4 == 0
    tool = F.when(is_sql, F.lit("execute_sql")).otherwise(F.lit("export_csv"))
    inp = _tool_input(F.col("run_id"), F.col("conv_id"), F.col("turn"))
    calls = row(user, F.col("turn") * K + SUB_TOOL_CALL, "tool_call", F.col("turn_ms") + 20_000,
                tool_call_id=call_id, tool_name=tool, arguments=inp)
    requests = row(user, F.col("turn") * K + SUB_REQUEST,
                   F.when(is_sql, F.lit("approval-requested")).otherwise(F.lit("tool-input-available")),
                   F.col("turn_ms") + 20_001, tool_call_id=call_id, tool_name=tool, inp=inp)
    seg_done = row(user.where(is_sql), F.col("turn") * K + SUB_SEGMENT_DONE, "done", F.col("turn_ms") + 20_002,
                   finish_reason=F.lit("tool_calls"), usage=_usage_json(F.col("conv_id"), F.col("turn")))

    answers = c.where((F.col("role") == "assistant") & (F.col("turn") >= 1))
    results = row(answers, (F.col("turn") - 1) * K + SUB_RESULT, "tool_result", F.col("turn_ms") - 5_000,
                  tool_call_id=F.concat(F.col("run_id"), F.lit("-"), (F.col("turn") - 1).cast("string")),
                  content=_envelope_text(F.col("run_id"), F.col("conv_id"), F.col("turn")))

    # one closing row per run: partial aggregate on conv_id (map-side combine)
    last = (c.groupBy("run_id", "conv_id", "model")
            .agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("last_role"),
                 F.max("turn_ms").alias("turn_ms")))
    failed = F.col("conv_id") % 23 == 0
    errors = row(last.where(failed), F.col("turn") * K + SUB_ERROR, "error", F.col("turn_ms") + 29_000,
                 error_message=F.concat(F.lit("model call failed for "), F.col("run_id")))
    done = row(last.where(~failed), (F.col("turn") + 1) * K, "done", F.col("turn_ms") + 29_500,
               finish_reason=F.when(F.col("last_role") == "assistant", F.lit("stop")).otherwise(F.lit("tool_calls")),
               usage=_usage_json(F.col("conv_id"), F.col("turn") + 1))

    return (text_rows.unionByName(calls).unionByName(requests).unionByName(seg_done)
            .unionByName(results).unionByName(errors).unionByName(done))


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human decisions posted for tool calls: (run_id, tool_call_id, seq, value JSON text)."""
    c = _conv(spark, sf_dir).where(F.col("role") == "user")
    k = (F.col("conv_id") + F.col("turn")) % 6
    value = (F.when(k == 0, F.lit("true"))
             .when(k == 1, F.lit("false"))
             .when(k == 2, F.lit('{"kind":"tool-approved","override_args":{"sql":"SELECT 1"}}'))
             .when(k == 3, F.lit('{"kind":"tool-denied","message":"not now"}'))
             .when(k == 4, F.lit('{"kind":"tool-denied"}'))
             .otherwise(F.lit('{"kind":"escalate"}')))
    return (c.where((F.col("conv_id") + F.col("turn")) % 5 != 0)
            .select("run_id",
                    F.concat(F.col("run_id"), F.lit("-"), F.col("turn").cast("string")).alias("tool_call_id"),
                    (F.col("turn") * TURN_STRIDE + SUB_DECISION).alias("seq"),
                    value.alias("value"),
                    # decided (conv_id + turn) % 9 minutes after the request
                    F.timestamp_millis(F.col("turn_ms") + 20_001
                                       + ((F.col("conv_id") + F.col("turn")) % 9) * 60_000).alias("decided_at")))


def run_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-store writes: set_messages on even, set_pending on odd turns, a clear at turn 2 of every 10th run
    and a final clear (run deleted) after the last turn of every 7th run."""
    c = _conv(spark, sf_dir)
    t = F.col("turn")
    is_msg = t % 2 == 0
    upd = c.select(
        "run_id", (t * 10 + 1).alias("seq"),
        F.when(is_msg, F.lit("set_messages")).otherwise(F.lit("set_pending")).alias("kind"),
        F.when(is_msg, F.concat(F.lit("history@"), t.cast("string"))).alias("messages"),
        F.when(~is_msg & (t % 3 != 0), F.concat(F.lit("pending@"), t.cast("string"))).alias("pending"),
        F.when(t % 5 != 0, F.concat(F.lit("model-"), ((F.col("conv_id") + t) % 3).cast("string"))).alias("model"),
        F.timestamp_millis(F.col("turn_ms")).alias("written_at"),
    )
    clears = c.where((F.col("conv_id") % 10 == 0) & (t == 2)).select(
        "run_id", (t * 10).alias("seq"), F.lit("clear").alias("kind"),
        F.lit(None).cast("string").alias("messages"), F.lit(None).cast("string").alias("pending"),
        F.lit(None).cast("string").alias("model"), F.timestamp_millis(F.col("turn_ms") - 1).alias("written_at"))
    # every 7th run is deleted after its last turn (a final clear)
    final = (c.groupBy("run_id", "conv_id").agg(F.max("turn").alias("turn"), F.max("turn_ms").alias("turn_ms"))
             .where(F.col("conv_id") % 7 == 0)
             .select("run_id", (F.col("turn") * 10 + 5).alias("seq"), F.lit("clear").alias("kind"),
                     F.lit(None).cast("string").alias("messages"), F.lit(None).cast("string").alias("pending"),
                     F.lit(None).cast("string").alias("model"),
                     F.timestamp_millis(F.col("turn_ms") + 1).alias("written_at")))
    return upd.unionByName(clears).unionByName(final)


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifact manifest rows: one per order, rows = its line items (pre-aggregated before the join)."""
    items = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).alias("row_count")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = orders.join(items, orders.o_orderkey == items.l_orderkey, "left")
    return j.select(
        run_id_of(F.col("o_custkey") % 100).alias("run_id"),
        F.col("o_orderkey").alias("result_key"),
        F.lit("table").alias("type"),
        F.coalesce(F.col("row_count"), F.lit(0)).cast("long").alias("row_count"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement log: one SQL text per event (text picked by event_id % 16)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("stmt_id"),
        run_id_of(F.col("user_id") % 100).alias("run_id"),
        F.col("ts").cast("timestamp").alias("submitted_at"),
        F.element_at(F.array(*[F.lit(s) for s in STATEMENTS]), (F.col("event_id") % 16 + 1).cast("int")).alias("sql"),
    )


def ui_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat-client messages per run (role, content, toolCalls, toolCallId, name), positions 3*turn + k.

    user turn t:      3t user prompt, 3t+1 assistant message holding the tool call of turn t
    assistant turn t: 3t tool message returning the call named by return_id (name left out when
                      t % 5 = 0), 3t+1 assistant text
    system turn t:    3t system prompt
    """
    c = _conv(spark, sf_dir)
    t = F.col("turn")
    call_id = F.concat(F.col("run_id"), F.lit("-"), t.cast("string"))
    tool = F.when(t % 4 == 0, F.lit("execute_sql")).otherwise(F.lit("export_csv"))
    ret_turn = t - F.when(t % 4 == 3, 3).otherwise(1)
    ret_tool = F.when(ret_turn % 4 == 0, F.lit("execute_sql")).otherwise(F.lit("export_csv"))
    calls_t = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
    no_calls = F.lit(None).cast(calls_t)
    null_s = F.lit(None).cast("string")

    def msg(df, pos, role, content, calls=no_calls, call_id_=null_s, name=null_s):
        return df.select("run_id", pos.cast("long").alias("pos"), F.lit(role).alias("role"), content.alias("content"),
                         calls.alias("toolCalls"), call_id_.alias("toolCallId"), name.alias("name"))

    user = c.where(F.col("role") == "user")
    asst = c.where(F.col("role") == "assistant")
    syst = c.where(F.col("role") == "system")
    the_call = F.array(F.struct(call_id.alias("id"), F.lit("function").alias("type"),
                                F.struct(tool.alias("name"),
                                         _tool_input(F.col("run_id"), F.col("conv_id"), t).alias("arguments"))
                                .alias("function"))).cast(calls_t)
    return (msg(user, t * 3, "user", F.col("text"))
            .unionByName(msg(user, t * 3 + 1, "assistant", null_s, the_call))
            .unionByName(msg(asst, t * 3, "tool", _envelope_text(F.col("run_id"), F.col("conv_id"), t), no_calls,
                             F.concat(F.col("run_id"), F.lit("-"), ret_turn.cast("string")),
                             F.when(t % 5 != 0, ret_tool)))
            .unionByName(msg(asst, t * 3 + 1, "assistant", F.col("text")))
            .unionByName(msg(syst, t * 3, "system", F.col("text"))))


def run_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client requests: one per user turn, carrying the messages up to it; every third one after the first
    is a continuation (it posts approvals or tool results)."""
    c = _conv(spark, sf_dir).where(F.col("role") == "user")
    t = F.col("turn")
    return c.select("run_id", t.alias("turn"), (t * 3 + 1).alias("n_messages"),
                    F.lit("user").alias("last_role"),
                    ((t > 0) & ((F.col("conv_id") + t) % 3 == 0)).alias("is_continuation"))


def session_of(run_id: Column, sessions: int = 50) -> Column:
    """Client session a run belongs to in the derived data (runs of one client share a session)."""
    return F.substring(run_id, 5, 64).try_cast("long") % sessions


def turn_of(seq: Column) -> Column:
    """The turn that a derived chunk belongs to."""
    return F.floor(seq / TURN_STRIDE)


def message_of(run_id: Column, seq: Column) -> Column:
    """The message that a derived chunk belongs to."""
    return F.concat_ws(":", run_id, turn_of(seq).cast("string"))
