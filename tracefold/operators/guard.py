"""SQL guard, row cap and statement audit.

``audit_*`` reproduce the textual guard as one projection over a *log* of
statements (so a fleet of statements is audited as a Spark job).
``guarded_query`` is the structural version for running one statement: the
session's own parser checks the plan before anything executes, and the row cap
is a ``.limit`` on the plan rather than a rewrite of the text.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FORBIDDEN_KEYWORDS, FORBIDDEN_MESSAGE, SELECT_ONLY_MESSAGE, SQL_MAX_LIMIT

# ---------------------------------------------------------------------------
# textual audit (column expressions)
# ---------------------------------------------------------------------------


# Unicode blanks count as blanks, as in the clients' own trimming: (?U) makes \s match them; the four separators
# \x1c-\x1f are blanks there too
BLANK = r"[\s\x1c-\x1f]"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def forbidden_keyword(sql: Column) -> Column:
    """G1: first forbidden keyword in list order (whole word, any case), else NULL.

    One combined pattern screens the statement first; only a hit pays for the
    per-keyword tests that decide which keyword comes first in list order.
    """
    up = F.upper(sql)
    any_kw = up.rlike(r"(?i)\b(" + "|".join(FORBIDDEN_KEYWORDS) + r")\b")
    first = F.coalesce(*[F.when(up.rlike(rf"(?i)\b{kw}\b"), F.lit(kw)) for kw in FORBIDDEN_KEYWORDS])
    return F.when(any_kw, first)


def is_select(sql: Column) -> Column:
    """The trimmed, upper-cased text starts with SELECT."""
    return F.upper(_strip(sql)).startswith("SELECT")


def capped_text(sql: Column, max_limit: int = SQL_MAX_LIMIT) -> Column:
    """The textual row cap.

    No 'LIMIT' letters anywhere -> strip trailing blanks and ';' and append
    ``LIMIT max``.  Otherwise the *first* ``LIMIT <digits>`` is compared with max
    and, if larger, *every* ``LIMIT <digits>`` is rewritten.
    """
    up = F.upper(_strip(sql))
    first = F.regexp_extract(up, rf"(?U)LIMIT{BLANK}+([0-9]+)", 1)
    too_big = (first != "") & ((F.length(first) > 18) | (first.try_cast("long") > F.lit(max_limit)))
    appended = F.concat(F.regexp_replace(F.regexp_replace(sql, rf"(?U){BLANK}+\z", ""), r";+\z", ""), F.lit(f" LIMIT {max_limit}"))
    return (F.when(~up.contains("LIMIT"), appended)
            .when(too_big, F.regexp_replace(sql, rf"(?iU)LIMIT{BLANK}+[0-9]+", f"LIMIT {max_limit}"))
            .otherwise(sql))


def audit_keywords(stmts: DataFrame, col: str = "sql") -> DataFrame:
    """G1 over a statement log: adds ``first_forbidden``."""
    return stmts.withColumn("first_forbidden", forbidden_keyword(F.col(col)))


def audit_select_only(stmts: DataFrame, col: str = "sql") -> DataFrame:
    """G2 over a statement log: adds ``is_select``."""
    return stmts.withColumn("is_select", is_select(F.col(col)))


def cap_limit_text(stmts: DataFrame, max_limit: int = SQL_MAX_LIMIT, col: str = "sql") -> DataFrame:
    """G3 over a statement log: adds ``capped_sql``."""
    return stmts.withColumn("capped_sql", capped_text(F.col(col), max_limit))


def audit_output_rules(stmts: DataFrame, col: str = "sql") -> DataFrame:
    """The output validator: tests run on the raw upper-cased text, the kept text loses backslashes."""
    up = F.upper(_strip(F.col(col)))
    verdict = (F.when(~up.startswith("SELECT"), F.lit("retry_select"))
               .when(~(up.contains("LIMIT") | up.contains("COUNT") | up.contains("SUM")), F.lit("retry_limit"))
               .otherwise(F.lit("ok")))
    return stmts.withColumn("output_verdict", verdict) \
                .withColumn("clean_sql", F.replace(F.col(col), F.lit("\\"), F.lit("")))


def audit_statements(stmts: DataFrame, max_limit: int = SQL_MAX_LIMIT, col: str = "sql") -> DataFrame:
    """Keyword guard, then SELECT-only, then the row cap — one projection, no shuffle."""
    # keyword and SELECT test are computed once and referenced (Catalyst keeps the two projections
    # apart rather than repeat the regex work in every expression that uses them)
    checked = stmts.select("*", forbidden_keyword(F.col(col)).alias("keyword"), is_select(F.col(col)).alias("__sel"))
    kw, sel = F.col("keyword"), F.col("__sel")
    verdict = F.when(kw.isNotNull(), F.lit("forbidden")).when(~sel, F.lit("not_select")).otherwise(F.lit("allowed"))
    reason = (F.when(kw.isNotNull(), F.format_string(FORBIDDEN_MESSAGE.replace("{kw}", "%s"), kw))
              .when(~sel, F.lit(SELECT_ONLY_MESSAGE)))
    return checked.select(*[F.col(c) for c in stmts.columns], verdict.alias("verdict"), kw, reason.alias("reason"),
                          F.when(kw.isNull() & sel, capped_text(F.col(col), max_limit)).alias("final_sql"))


def audit_summary(audited: DataFrame) -> DataFrame:
    """Statements by verdict and keyword across the fleet (partial aggregation)."""
    return audited.groupBy("verdict", "keyword").agg(
        F.count(F.lit(1)).alias("n_statements"),
        F.count_distinct("run_id").alias("n_runs"),
        F.count_if(F.col("final_sql") != F.col("sql")).alias("n_rewritten"))


# ---------------------------------------------------------------------------
# structural guard for one statement
# ---------------------------------------------------------------------------

# logical plan nodes a read-only query may consist of
QUERY_NODES = {
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "Sort", "GlobalLimit", "LocalLimit", "Offset",
    "Union", "Intersect", "Except", "Distinct", "Deduplicate", "SubqueryAlias", "UnresolvedRelation",
    "UnresolvedWith", "CTERelationRef", "WithCTE", "CTERelationDef", "Window", "WithWindowDefinition",
    "Expand", "Generate", "LocalRelation", "OneRowRelation", "UnresolvedHint", "Pivot", "Unpivot",
    "UnresolvedInlineTable", "Sample", "Tail", "RepartitionByExpression", "Repartition", "GroupingSets",
    "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "PipeOperator", "UnresolvedHaving",
}
# a hint that would skip Spark's size check on the broadcast side
BROADCAST_HINTS = {"BROADCAST", "BROADCASTJOIN", "MAPJOIN"}
# Spark's own expressions may be called, except the groups that reach outside a row (reflection, files, users);
# of the miscellaneous group these
BUILTIN_PREFIX = "org.apache.spark.sql.catalyst.expressions."
REFUSED_GROUPS = {"misc_funcs"}
MISC_ALLOWED = {"typeof", "uuid", "monotonically_increasing_id", "hll_sketch_estimate", "hll_union",
                "bitmap_bit_position", "bitmap_bucket_number", "bitmap_count", "approx_top_k_estimate"}
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer",
                   "stack", "json_tuple"}
SUBQUERY = "org.apache.spark.sql.catalyst.expressions.SubqueryExpression"

# the analysed plan: nodes that a statement may resolve to (a View is a registered relation; what is below it was not
# written by the statement), and leaves that a checked relation name may stand for
ANALYSED_NODES = QUERY_NODES | {"View", "Range", "LogicalRelation", "HiveTableRelation", "DataSourceV2Relation", "LogicalRDD"}
TRUSTED_NODES = {"View", "LogicalRelation", "HiveTableRelation", "DataSourceV2Relation", "LogicalRDD"}
# expressions of the analysed plan that no function name stands for: references, literals, windows, subqueries,
# access to parts, interval arithmetic and implicit conversions
STRUCTURAL = {
    "Alias", "AttributeReference", "OuterReference", "Literal", "SortOrder", "LambdaFunction", "NamedLambdaVariable",
    "WindowExpression", "WindowSpecDefinition", "SpecifiedWindowFrame", "UnspecifiedFrame$", "CurrentRow$",
    "UnboundedPreceding$", "UnboundedFollowing$", "aggregate.AggregateExpression", "aggregate.PivotFirst",
    "ScalarSubquery", "LateralSubquery", "ListQuery", "InSubquery", "Exists", "GetStructField", "GetArrayItem",
    "GetArrayStructFields", "GetMapValue", "CommonExpressionDef", "CommonExpressionRef", "With", "Cast", "UpCast",
    "TryEval", "KnownNullable", "KnownNotNull", "KnownFloatingPointNormalized", "NormalizeNaNAndZero", "EqualTo", "In",
    "InSet", "IsNull", "IsNotNull", "Not", "And", "Or", "CaseWhen", "If", "LikeAll", "NotLikeAll", "LikeAny", "NotLikeAny",
    "DatetimeSub", "SubtractDates", "SubtractTimestamps", "SubtractTimes", "DateAddInterval", "DateAddYMInterval", "TimeAddInterval",
    "TimestampAddInterval", "TimestampAddYMInterval", "TimestampDiff", "TimestampAdd", "MultiplyInterval", "DivideInterval",
    "MultiplyDTInterval", "MultiplyYMInterval", "DivideDTInterval", "DivideYMInterval", "ExtractIntervalPart",
    "PreciseTimestampConversion", "TimeWindow", "SessionWindow", "ResolvedCollation", "VirtualColumn",
    "ConcatWs", "CheckOverflow", "MakeDecimal", "UnscaledValue", "DateFormatClass", "CreateNamedStruct",
}
# what functions that the registry lists under a builder's name become
BUILT = {
    "Inline", "Explode", "PosExplode", "GeneratorOuter", "DatePart", "Collate", "Mask", "ToCharacter", "Hour", "Minute",
    "Second", "HoursOfTime", "MinutesOfTime", "SecondsOfTime", "SecondWithFraction", "SecondsOfTimeWithFraction", "Year",
    "Quarter", "Month", "WeekOfYear", "DayOfMonth", "DayOfWeek", "DayOfYear", "YearOfWeek", "WeekDay", "Ceil", "RoundCeil",
    "Floor", "RoundFloor", "CurrentDate", "MakeTimestamp", "TryMakeTimestamp", "MakeTimestampFromDateTime", "ParseToDate",
    "ParseToTimestamp", "ToTime", "StartsWith", "EndsWith", "Contains", "StringLPad", "StringRPad", "BinaryPad",
    "variant.ParseJson", "variant.VariantGet", "aggregate.Mode", "aggregate.PercentileCont", "aggregate.PercentileDisc",
    "aggregate.Sum", "aggregate.Average", "aggregate.CountMinSketchAgg",
}
# calls that a listed function is rewritten into; allowed below such a function only
REWRITTEN = {"objects.StaticInvoke", "objects.Invoke"}
INHERITS = "org.apache.spark.sql.catalyst.expressions.InheritAnalysisRules"


@dataclass
class GuardedResult:
    ok: bool
    message: str
    df: DataFrame | None = None
    data: dict = field(default_factory=dict)
    # the checked statement without its cap, for callers that must tell whether the cap cut rows off
    uncapped: DataFrame | None = None

    def envelope(self, artifacts: list[dict] | None = None) -> str:
        """The tool-result text (empty artifacts/data omitted)."""
        payload: dict = {"type": "tool_result", "version": 1, "message": self.message}
        if artifacts:
            payload["artifacts"] = artifacts
        if self.data:
            payload["data"] = self.data
        return json.dumps(payload, ensure_ascii=False)


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class _Walk:
    """One pass over a parsed plan: its nodes, their expressions, and the plans inside these, each in its CTE scope."""

    def __init__(self, spark: SparkSession, allowed_tables: set[str] | None):
        self.gateway = spark.sparkContext._gateway
        self.jvm = spark._jvm
        self.functions = spark._jsparkSession.sessionState().functionRegistry()
        self.allowed = allowed_tables

    def plan(self, node, scope: frozenset[str]) -> str | None:
        """The first error in a plan node and all below it, or None."""
        name = node.getClass().getSimpleName()
        if name not in QUERY_NODES:
            return f"Error: {name} is not allowed in a read-only query."
        if name == "UnresolvedRelation" and self.allowed is not None:
            parts = _items(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in scope | self.allowed:
                return f"Error: relation {'.'.join(parts)} is not available."
        if name == "UnresolvedHint" and node.name().upper() in BROADCAST_HINTS:
            return "Error: broadcast hints are not allowed; Spark picks broadcasts by size."
        if name == "UnresolvedTableValuedFunction":
            called = _items(node.name())
            if len(called) != 1 or called[0].lower() not in TABLE_FUNCTIONS:
                return f"Error: {'.'.join(called)} is not allowed in a read-only query."
        if name == "UnresolvedWith":
            if node.allowRecursion():
                return "Error: recursive queries are not allowed."
            for pair in _items(node.cteRelations()):  # each sees those before it
                if err := self.plan(pair._2(), scope):
                    return err
                scope = scope | {pair._1().lower()}
        for e in _items(node.expressions()):
            if err := self.expression(e, scope):
                return err
        for child in _items(node.children()):
            if err := self.plan(child, scope):
                return err
        return None

    def expression(self, e, scope: frozenset[str]) -> str | None:
        kind = e.getClass().getSimpleName()
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            if err := self.called(e):
                return err
        if kind == "ExpressionWithUnresolvedIdentifier":
            return "Error: IDENTIFIER(...) is not allowed in a read-only query."
        if is_instance_of(self.gateway, e, SUBQUERY):
            if err := self.plan(e.plan(), scope):
                return err
        for child in _items(e.children()):
            if err := self.expression(child, scope):
                return err
        return None

    def called(self, e) -> str | None:
        """Whether a function is one of Spark's own row, aggregate or window functions."""
        if e.getClass().getSimpleName() == "UnresolvedFunction":
            parts = _items(e.nameParts())
        else:
            parts = [e.name().funcName()]
        name = parts[-1].lower()
        refused = f"Error: function {'.'.join(parts)} is not allowed in a read-only query."
        if [p.lower() for p in parts[:-1]] not in ([], ["builtin"], ["system", "builtin"]):
            return refused
        info = self.functions.lookupFunction(self.jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        if not info.isDefined() or not str(info.get().getClassName()).startswith(BUILTIN_PREFIX):
            return refused
        if info.get().getGroup() in REFUSED_GROUPS and name not in MISC_ALLOWED:
            return refused
        return None


_listed: tuple[object, frozenset[str]] | None = None


def listed_expressions(spark: SparkSession) -> frozenset[str]:
    """The allow-list of the analysed plan: the classes of Spark's own functions outside the refused groups, and the
    fixed sets above. Read once per JVM."""
    global _listed
    if _listed is None or _listed[0] is not spark._jvm:
        found, refused = set(STRUCTURAL | BUILT), set()
        entries = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.expressions().iterator()
        while entries.hasNext():
            entry = entries.next()
            info = entry._2()._1()
            name = info.getClassName().removeprefix(BUILTIN_PREFIX)
            (refused if info.getGroup() in REFUSED_GROUPS and entry._1() not in MISC_ALLOWED else found).add(name)
        _listed = (spark._jvm, frozenset(found - refused))
    return _listed[1]


class _Analysed:
    """One pass over an analysed plan: the class of every node and expression that the statement itself brought in."""

    def __init__(self, spark: SparkSession):
        self.gateway, self.listed = spark.sparkContext._gateway, listed_expressions(spark)

    def plan(self, node) -> str | None:
        name = node.getClass().getSimpleName()
        if name not in ANALYSED_NODES:
            return f"Error: {name} is not allowed in a read-only query."
        if name in TRUSTED_NODES:
            return None
        for e in _items(node.expressions()):
            if err := self.expression(e, False):
                return err
        for child in _items(node.children()):
            if err := self.plan(child):
                return err
        return None

    def expression(self, e, rewritten: bool) -> str | None:
        name = e.getClass().getName().removeprefix(BUILTIN_PREFIX)
        if name not in self.listed and not (rewritten and name in REWRITTEN):
            return f"Error: {name.rpartition('.')[2]} is not allowed in a read-only query."
        if is_instance_of(self.gateway, e, SUBQUERY):
            if err := self.plan(e.plan()):
                return err
        below = rewritten or is_instance_of(self.gateway, e, INHERITS)
        for child in _items(e.children()):
            if err := self.expression(child, below):
                return err
        return None


def check_analysed(spark: SparkSession, df: DataFrame) -> str | None:
    """Test what a statement resolved to, so that no spelling of a function's name matters; nothing runs.

    Every node and every expression of the analysed plan, down to the registered relations, must be on the allow-list.
    """
    return _Analysed(spark).plan(df._jdf.queryExecution().analyzed())


def check_statement(spark: SparkSession, sql: str, allowed_tables: set[str] | None = None,
                    allow_with: bool = True) -> str | None:
    """Return an error text if the statement is not a plain read-only query, else None.

    Runs the session's parser only (nothing executes), and looks at the parsed plan itself, never at its text: nodes,
    functions, hints and relations everywhere, also inside subqueries and CTE bodies.
    """
    head = sql.strip().upper()
    if not (head.startswith("SELECT") or (allow_with and head.startswith("WITH"))):
        return SELECT_ONLY_MESSAGE
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as exc:  # noqa: BLE001  (parse errors are reported, not raised)
        return f"Error: statement does not parse: {str(exc).splitlines()[0]}"
    return _Walk(spark, allowed_tables).plan(plan, frozenset())


def _single_row(node) -> bool:
    """Whether the optimizer knows that a physical node gives at most one row."""
    link = node.logicalLink()
    most = link.get().maxRows() if link.isDefined() else None
    return most is not None and most.isDefined() and int(most.get()) <= 1


def pairwise(node) -> str | None:
    """The first physical operator that pairs all rows of two inputs, or broadcasts one whatever its size.

    A side of at most one row (an aggregate without keys, say) makes the pairs as few as the other side's rows.
    """
    name = node.getClass().getSimpleName()
    if name in ("CartesianProductExec", "BroadcastNestedLoopJoinExec"):
        if not any(map(_single_row, _items(node.children()))):
            return (f"Error: the statement needs a {name.removesuffix('Exec')} (all pairs of rows); "
                    "add an equality join condition.")
    if name == "BroadcastHashJoinExec" and node.isNullAwareAntiJoin():
        return ("Error: NOT IN over a nullable subquery broadcasts it whatever its size; "
                "use NOT EXISTS with an equality.")
    for child in _items(node.children()):
        if err := pairwise(child):
            return err
    for inner in _items(node.subqueries()):
        if err := pairwise(inner):
            return err
    return None


def textual_guard(spark: SparkSession, sql: str, max_rows: int = SQL_MAX_LIMIT) -> tuple[str | None, str]:
    """The reference's textual guard for one statement: (error text or None, statement to run).

    The same column expressions as the bulk audit (G5), on a one-row frame.
    """
    row = audit_statements(spark.createDataFrame([(sql,)], "sql string"), max_rows).first()
    return row["reason"], row["final_sql"]


def guarded_query(spark: SparkSession, sql: str, max_rows: int = SQL_MAX_LIMIT,
                  allowed_tables: set[str] | None = None, allow_with: bool = True,
                  allow_pairwise: bool = False, mode: str = "structural") -> GuardedResult:
    """Check, then plan ``sql`` with a structural cap of ``max_rows`` rows.

    The parsed statement is checked first, then what it resolves to
    (``check_analysed``), then its physical plan: one that pairs all rows of
    two inputs (cross join, non-equi join planned as a nested loop) or
    broadcasts a ``NOT IN`` subquery is refused unless ``allow_pairwise``. All
    checks hold in both modes, and nothing runs. ``mode='textual'`` puts the cap
    into the text, by the textual rules and with their loopholes; ``uncapped``
    is then the statement as it was given, so a caller can cap the plan as well
    and tell whether rows were cut off. Failures come back as a result with
    ``data={'success': False}``, never as an exception. The DataFrame is lazy:
    executors do the work when it is written.
    """

    def failed(message: str) -> GuardedResult:
        return GuardedResult(False, message, None, {"success": False})

    if allowed_tables is None:
        allowed_tables = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    asked = sql
    if mode == "textual":
        reason, sql = textual_guard(spark, sql, max_rows)
        if reason:
            return failed(reason)
        allow_with = False
    if err := check_statement(spark, sql, allowed_tables, allow_with):
        return failed(err)
    try:
        df = spark.sql(sql)
        if err := check_analysed(spark, df):
            return failed(err)
        capped = df if mode == "textual" else df.limit(int(max_rows))
        if not allow_pairwise and (err := pairwise(capped._jdf.queryExecution().sparkPlan())):
            return failed(err)
        return GuardedResult(True, "Query planned.", capped, uncapped=spark.sql(asked) if asked != sql else df)
    except Exception as exc:  # noqa: BLE001
        return failed(f"Error: query failed: {str(exc).splitlines()[0]}")
