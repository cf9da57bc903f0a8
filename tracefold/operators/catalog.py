"""Schema report, DDL text and enum domains.

Metadata rows come from DataFrame schemas (bounded by the number of columns);
the data profile beside them is one full-scan aggregate per table, partial on
the map side, unpivoted with ``stack`` (exact distinct counts: one aggregate per
column).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA = T.StructType([
    T.StructField("table_name", T.StringType()), T.StructField("ordinal", T.IntegerType()),
    T.StructField("column_name", T.StringType()), T.StructField("data_type", T.StringType()),
    T.StructField("not_null", T.BooleanType()),
])


def column_metadata(spark: SparkSession, tables: dict[str, DataFrame],
                    declared: dict[str, T.StructType] | None = None) -> DataFrame:
    """(table, ordinal, column, type, not_null) of every table, from the declared schemas
    (``declared`` overrides a frame's own schema, e.g. to report a table's stated nullability)."""
    declared = declared or {}
    rows = [(name, i + 1, f.name, f.dataType.simpleString(), not f.nullable)
            for name, df in tables.items() for i, f in enumerate(declared.get(name, df.schema).fields)]
    return spark.createDataFrame(rows, METADATA)


def _orderable_text(c, dtype):
    """Text form of a value for min/max reporting (strings, numbers, booleans, timestamps); else None."""
    if isinstance(dtype, (T.StringType, T.BooleanType, T.IntegralType)):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c
    return None


def _as_text(c, dtype):
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return c.cast("string")


def profile(name: str, df: DataFrame, exact: bool = False) -> DataFrame:
    """One aggregate pass over ``df``: rows, NULLs, distinct values, min and max per column (long form).

    min/max are reported as text for strings, integers, booleans and timestamps
    (NULL for other types); distinct counts are HyperLogLog estimates unless ``exact`` (``exact_profile``).
    """
    if exact:
        return exact_profile(name, df)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"n{i}"))
        aggs.append(F.approx_count_distinct(c).cast("long").alias(f"d{i}"))
        o = _orderable_text(c, f.dataType)
        aggs.append((_as_text(F.min(o), f.dataType) if o is not None else F.lit(None).cast("string")).alias(f"lo{i}"))
        aggs.append((_as_text(F.max(o), f.dataType) if o is not None else F.lit(None).cast("string")).alias(f"hi{i}"))
    wide = df.agg(*aggs)
    n = len(df.schema.fields)
    stack = "stack({n}, {items}) as (column_name, n_nulls, n_distinct, min_value, max_value)".format(
        n=n, items=", ".join(f"'{f.name}', n{i}, d{i}, lo{i}, hi{i}" for i, f in enumerate(df.schema.fields)))
    return wide.select(F.lit(name).alias("table_name"), F.col("__rows").alias("n_rows"), F.expr(stack))


def exact_profile(name: str, df: DataFrame) -> DataFrame:
    """``profile`` with exact distinct counts: each column's values are grouped by themselves, with their rows counted.

    A scan reads one column and only its distinct values are shuffled; distinct counts of many columns in one aggregate
    would send every row once per column, as wide as all of them.
    """
    out = None
    for f in df.schema.fields:
        values = df.groupBy(F.col(f"`{f.name}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        ordered = _orderable_text(F.col("v"), f.dataType) is not None
        lo, hi = ((_as_text(fn("v"), f.dataType) if ordered else F.lit(None).cast("string")) for fn in (F.min, F.max))
        one = values.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.lit(f.name).alias("column_name"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"),
            F.count("v").alias("n_distinct"), lo.alias("min_value"), hi.alias("max_value"))
        out = one if out is None else out.unionByName(one)
    return out.select(F.lit(name).alias("table_name"), "*")


# ---------------------------------------------------------------------------
# profiles kept as sketches
# ---------------------------------------------------------------------------

LG_CONFIG = 12  # 2^12 HyperLogLog registers: about 1.6 % standard error
KLL_K = 200     # about 1.3 % of the rows as rank error


def _number(c, dtype):
    """A value as a number for quantiles (numbers, timestamps as seconds), else None."""
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")) / 1e6
    return None


def profile_sketches(df: DataFrame, by: str = "day") -> DataFrame:
    """One row per value of ``by`` and column: exact counts and bounds, a HyperLogLog sketch of the values, a KLL sketch.

    One partial aggregate over the table, with no row per distinct value; the rows merge (``merged_profile``), so the
    sketches of a day are made once.
    """
    fields = [f for f in df.schema.fields if f.name != by]
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        o, q = _orderable_text(c, f.dataType), _number(c, f.dataType)
        value = c if isinstance(f.dataType, (T.StringType, T.IntegerType, T.LongType)) else F.to_json(F.struct(c))
        aggs += [F.count_if(c.isNull()).alias(f"n{i}"),
                 F.hll_sketch_agg(F.when(c.isNotNull(), value), F.lit(LG_CONFIG)).alias(f"h{i}"),
                 (_as_text(F.min(o), f.dataType) if o is not None else F.lit(None).cast("string")).alias(f"lo{i}"),
                 (_as_text(F.max(o), f.dataType) if o is not None else F.lit(None).cast("string")).alias(f"hi{i}"),
                 (F.kll_sketch_agg_double(q, F.lit(KLL_K)) if q is not None else F.lit(None).cast("binary")).alias(f"k{i}")]
    wide = df.groupBy(F.col(by).alias("part")).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(
        F.lit(f.name).alias("column_name"), F.lit(isinstance(f.dataType, T.IntegralType)).alias("is_number"), F.col(f"n{i}").alias("n_nulls"),
        F.col(f"h{i}").alias("distinct"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), F.col(f"k{i}").alias("quantiles"))
        for i, f in enumerate(fields)]))
    return wide.select(F.col("part").cast("string").alias("part"), "n_rows", rows.alias("c")).select("part", "n_rows", "c.*")


def merged_profile(sketches: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The profile of all parts from their sketches: exact n_rows, n_nulls, min_value and max_value; estimates of
    n_distinct and of the quantiles. Reads one row per part and column, whatever the table's size."""
    by_number = F.col("is_number")

    def bound(fn, name):
        return F.coalesce(F.when(F.any_value(by_number), fn(F.when(by_number, F.col(name).try_cast("long"))).cast("string")), fn(name))

    merged = sketches.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct", F.lit(True))).alias("n_distinct"),
        bound(F.min, "lo").alias("min_value"), bound(F.max, "hi").alias("max_value"),
        F.kll_merge_agg_double("quantiles").alias("__q"))
    known = F.col("__q").isNotNull() & (F.kll_sketch_get_n_double("__q") > 0)
    values = [F.kll_sketch_get_quantile_double("__q", F.lit(float(q))) for q in quantiles]
    return merged.withColumn("quantiles", F.when(known, F.array(*values))).drop("__q")


def refresh_profile(spark: SparkSession, records: DataFrame, path: str, by: str = "day") -> DataFrame:
    """The profile of a table stored by ``by`` (``sources.records.write_records``), from kept sketches.

    Only parts that have no sketches under ``path`` are read (a filter on the partition column); theirs are appended.
    The parts' names, one per directory, come to the driver. A part is sketched once: rows added to it later need its
    sketches removed first.
    """
    try:
        kept = spark.read.parquet(path)
        done = [r.part for r in kept.select("part").distinct().collect()]
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        done = []
    fresh = records.where(~F.col(by).cast("string").isin(done)) if done else records
    profile_sketches(fresh, by).write.mode("append").parquet(path)
    return merged_profile(spark.read.parquet(path))


def schema_report(spark: SparkSession, tables: dict[str, DataFrame], exact: bool = False,
                  declared: dict[str, T.StructType] | None = None) -> DataFrame:
    """S3 + L4: columns of all tables in (table, ordinal) order, with their data profile."""
    meta = column_metadata(spark, tables, declared)
    prof = None
    for name, df in tables.items():
        p = profile(name, df, exact)
        prof = p if prof is None else prof.unionByName(p)
    return (meta.join(prof, ["table_name", "column_name"], "left")
            .orderBy("table_name", "ordinal"))


def schema_text(report: DataFrame, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """One CREATE TYPE line per enum and one CREATE TABLE block per table.

    Needs the columns of ``column_metadata`` only, so no table is read.
    """
    col_def = F.concat(F.lit("    "), F.col("column_name"), F.lit(" "), F.col("data_type"),
                       F.when(F.col("not_null"), F.lit(" NOT NULL")).otherwise(F.lit("")))
    tables = (report.groupBy("table_name")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", col_def.alias("d")))),
                                            lambda x: x["d"]), ",\n").alias("cols"))
              .select(F.lit("table").alias("kind"), F.col("table_name").alias("name"),
                      F.concat(F.lit("CREATE TABLE "), F.col("table_name"), F.lit(" (\n"), F.col("cols"),
                               F.lit("\n);")).alias("ddl")))
    # "(no tables found)" when the report is empty; decided by the aggregate, not on the driver
    none = (report.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
            .select(F.lit("none").alias("kind"), F.lit(None).cast("string").alias("name"),
                    F.lit("(no tables found)").alias("ddl")))
    tables = tables.unionByName(none)
    if not domains:
        return tables
    spark = report.sparkSession
    enum_rows = [("enum", name, "CREATE TYPE {} AS ENUM ({});".format(name, ", ".join(f"'{v}'" for v in values)))
                 for name, values in domains.items()]
    return spark.createDataFrame(enum_rows, "kind string, name string, ddl string").unionByName(tables)


def domain_frame(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    """An enum as rows (enum_name, value, sort_order), 1-based in declaration order."""
    return spark.createDataFrame([(name, v, i + 1) for i, v in enumerate(values)],
                                 "enum_name string, value string, sort_order int")


def value_domains(df: DataFrame, col: str, domain: DataFrame) -> DataFrame:
    """Observed counts of a low-cardinality column against its declared domain.

    Declared values with no rows get 0; observed values outside the domain keep
    NULL enum_name / sort_order.  Both sides are small after the partial
    aggregate, so the full join is cheap.
    """
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    return (domain.join(counts, "value", "full")
            .select("enum_name", "value", "sort_order", F.coalesce("n_rows", F.lit(0)).alias("n_rows")))


def domain_columns(meta: DataFrame, domain: DataFrame, column_enum: dict[tuple[str, str], str]) -> DataFrame:
    """Enum values joined to the columns declared with that enum (both sides metadata-sized)."""
    spark = meta.sparkSession
    link = spark.createDataFrame([(t, c, e) for (t, c), e in column_enum.items()],
                                 "table_name string, column_name string, enum_name string")
    return (meta.join(link, ["table_name", "column_name"])
            .join(domain, "enum_name")
            .select("table_name", "column_name", "enum_name", "value", "sort_order")
            .orderBy("enum_name", "sort_order"))
