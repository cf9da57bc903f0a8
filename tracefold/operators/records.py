"""Predicates, projections and roll-ups over log records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LEVELS, PREVIEW_ROWS, SQL_MAX_LIMIT


def _json_key_path(key: str) -> str:
    # bracket form so that a key with a dot is one key, not a path
    return "$['" + key.replace("'", "\\'") + "']"


# the attributes parsed once, when the records are written (``sources.records.write_records``)
PARSED = "_variant"


def _parsed(df: DataFrame, col: str) -> str | None:
    """The VARIANT column that goes with a JSON text column, if the table has one."""
    return col + PARSED if col + PARSED in df.columns else None


def attr_text(key: str, col: str = "attributes", parsed: str | None = None) -> Column:
    """``attributes->>'key'``: the value as text (JSON false -> 'false', JSON null -> NULL)."""
    if parsed:
        return F.variant_get(F.col(parsed), _json_key_path(key), "string")
    return F.get_json_object(F.col(col), _json_key_path(key))


def where_attr_equals(df: DataFrame, key: str, value: str, col: str = "attributes") -> DataFrame:
    """Text comparison of one top-level attribute; read from the parsed column where the table has one."""
    return df.where(attr_text(key, col, _parsed(df, col)) == F.lit(value))


def has_attr_key(key: str, col: str = "attributes", parsed: str | None = None) -> Column:
    """``attributes ? 'key'``: top-level key present (even with a null value), or a string element of a top-level array."""
    if parsed:
        v = F.col(parsed)
        # a JSON null is a value of a variant, so only an absent key gives NULL
        in_object = F.variant_get(v, _json_key_path(key), "variant").isNotNull()
        elements = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<string>"))
        return in_object | F.coalesce(F.array_contains(elements, F.lit(key)), F.lit(False))
    in_object = F.coalesce(F.array_contains(F.json_object_keys(F.col(col)), F.lit(key)), F.lit(False))
    in_array = F.coalesce(F.array_contains(F.from_json(F.col(col), T.ArrayType(T.StringType())), F.lit(key)),
                          F.lit(False))
    return in_object | in_array


def where_attr_has_key(df: DataFrame, key: str, col: str = "attributes") -> DataFrame:
    """R2; read from the parsed column where the table has one."""
    return df.where(has_attr_key(key, col, _parsed(df, col)))


def recent_as_written(now: str, col: str = "start_timestamp") -> Column:
    """``start::date > now - 1 day`` exactly as the example writes it (keeps today, not yesterday)."""
    return F.to_date(F.col(col)) > (F.to_timestamp(F.lit(now)) - F.expr("INTERVAL 1 DAY"))


def on_day(day: str, col: str = "start_timestamp") -> Column:
    """Half-open range [day 00:00, day+1 00:00): sargable, pushes down to the Parquet scan."""
    start = F.to_timestamp(F.lit(day))
    return (F.col(col) >= start) & (F.col(col) < start + F.expr("INTERVAL 1 DAY"))


def prune_days(df: DataFrame, first_day: Column, last_day: Column) -> DataFrame:
    """Add a predicate on the ``day`` partition column when the records are stored by day
    (``sources.records.write_records``), so whole directories are skipped."""
    if "day" in df.columns:
        return df.where((F.col("day") >= first_day) & (F.col("day") <= last_day))
    return df


def where_recent(df: DataFrame, now: str, mode: str = "calendar_day", day: str | None = None,
                 col: str = "start_timestamp") -> DataFrame:
    """R3 (mode='as_written') / R4 (mode='calendar_day': the day before ``now``, or ``day``)."""
    if mode == "as_written":
        # date(start) > now - 1 day keeps the days after (now - 1 day)'s date
        first = F.date_add(F.to_date(F.to_timestamp(F.lit(now)) - F.expr("INTERVAL 1 DAY")), 1)
        return prune_days(df, first, F.lit("9999-12-31").cast("date")).where(recent_as_written(now, col))
    if day is None:
        day_col = F.date_sub(F.to_date(F.lit(now)), 1)
        start = day_col.cast("timestamp")
        return prune_days(df, day_col, day_col).where(
            (F.col(col) >= start) & (F.col(col) < start + F.expr("INTERVAL 1 DAY")))
    d = F.to_date(F.lit(day))
    return prune_days(df, d, d).where(on_day(day, col))


def where_level(df: DataFrame, level: str) -> DataFrame:
    """R5."""
    return df.where(F.col("level") == F.lit(level))


def level_rank(col: str = "level") -> Column:
    """1-based rank in the declared order; NULL for an unknown level."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col(col)), F.lit(0))


def where_level_at_least(df: DataFrame, level: str) -> DataFrame:
    """Enum comparison by declaration order."""
    return df.where(level_rank() >= F.lit(LEVELS.index(level) + 1))


def where_tag(df: DataFrame, tag: str) -> DataFrame:
    """``'tag' = ANY(tags)``; a NULL array never matches."""
    return df.where(F.array_contains(F.col("tags"), F.lit(tag)))


def cell_text(df: DataFrame, name: str) -> Column:
    """A cell as display text; NULL becomes ''."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.ArrayType):
        txt = F.array_join(c.cast("array<string>"), ",")
    elif isinstance(dtype, (T.StructType, T.MapType)):
        txt = F.to_json(c)
    else:
        txt = c.cast("string")
    return F.coalesce(txt, F.lit(""))


def project_row_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every (chosen) column as text."""
    cols = columns or df.columns
    return df.select(*[cell_text(df, c).alias(c) for c in cols])


def _searchable(df: DataFrame) -> list[str]:
    ok = (T.StringType, T.NumericType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, ok)]


def search_match(df: DataFrame, needle: str, columns: list[str] | None = None) -> Column:
    """Case-insensitive 'any column contains needle'; the empty needle matches all."""
    if not needle:
        return F.lit(True)
    cols = columns if columns is not None else _searchable(df)
    if not cols:
        return F.lit(False)
    n = F.lit(needle.lower())
    return reduce(lambda a, b: a | b, [F.lower(cell_text(df, c)).contains(n) for c in cols])


def search_rows(df: DataFrame, needle: str, columns: list[str] | None = None) -> DataFrame:
    """R9."""
    return df.where(search_match(df, needle, columns))


def timestamps_as_text(df: DataFrame) -> DataFrame:
    """Timestamp columns become text; NULL stays NULL."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.col(f.name).cast("timestamp_ntz").cast("string").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def error_count(df: DataFrame, now: str, mode: str = "as_written") -> DataFrame:
    """COUNT(*) of error records under R3 (as written) or R4 (calendar day)."""
    return where_recent(where_level(df, "error"), now, mode).agg(F.count(F.lit(1)).alias("error_count"))


def error_rollup(df: DataFrame, day: str, dims: list[str] = ("service_name", "hour"),
                 level: str = "error", rollup: bool = False) -> DataFrame:
    """One day's errors rolled up by service / message / hour / tag.

    The day filter is a range on start_timestamp (pushed to the scan); the
    aggregate is partial on the map side, so a hot service costs one row per
    task before the shuffle.
    """
    d = F.to_date(F.lit(day))
    base = prune_days(df, d, d).where((F.col("level") == F.lit(level)) & on_day(day))
    keys = []
    for d in dims:
        if d == "hour":
            keys.append(F.date_trunc("hour", F.col("start_timestamp")).cast("timestamp_ntz").alias("hour"))
        elif d == "tag":
            base = base.withColumn("tag", F.explode_outer("tags"))
            keys.append(F.col("tag"))
        else:
            keys.append(F.col(d))
    aggs = [F.count(F.lit(1)).alias("n_errors"),
            F.min("start_timestamp").cast("timestamp_ntz").alias("first_seen"),
            F.max("start_timestamp").cast("timestamp_ntz").alias("last_seen"),
            F.count_if(F.col("is_exception")).alias("n_exceptions")]
    grouped = base.rollup(*keys) if rollup else base.groupBy(*keys)
    return grouped.agg(*aggs)


def preview_counts(df: DataFrame, needle: str = "", n: int = PREVIEW_ROWS, order_by: list | None = None,
                   columns: list[str] | None = None) -> DataFrame:
    """The counts behind the preview grid.

    original = rows of the artifact, exported = rows in the preview (the first n
    in ``order_by``), filtered = preview rows matching the search (the grid
    filters the preview, not the whole artifact), plus the column count.  One
    aggregate over the artifact unioned with its top-n preview; no join.
    """
    n = max(int(n), 1)
    shown = df.orderBy(*(order_by or df.columns)).limit(n)
    m = search_match(df, needle, columns)
    tagged = (df.select(F.lit(True).alias("__all"), F.lit(False).alias("__hit"))
              .unionByName(shown.select(F.lit(False).alias("__all"), m.alias("__hit"))))
    return (tagged.agg(F.count_if(F.col("__all")).alias("original_row_count"),
                       F.count_if(F.col("__hit")).alias("filtered_row_count"))
            .withColumn("exported_row_count", F.least(F.col("original_row_count"), F.lit(n).cast("long")))
            .withColumn("column_count", F.lit(len(df.columns)).cast("long")))


def preview(df: DataFrame, order_by: list, n: int = PREVIEW_ROWS) -> DataFrame:
    """L1: first n (>= 1) rows in a stated order (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(*order_by).limit(max(int(n), 1))


def natural_key(text: Column) -> Column:
    """A sort key in natural order: "a2" before "a10", "A3" beside "a3", "07" beside "7", text before digits.

    The lower-cased text is cut into runs of digits and of other characters; a run of digits counts by its number of
    digits without leading zeros, then by them, which is its value however long it is. The key is an array of
    structs, which Spark orders run by run, a text before its own continuations.
    """
    def part(p: Column) -> Column:
        digits = F.ltrim(p, F.lit("0"))
        return F.when(p.rlike("^[0-9]"), F.struct(F.lit(1).alias("is_number"), F.length(digits).alias("size"), digits.alias("run"))) \
                .otherwise(F.struct(F.lit(0).alias("is_number"), F.lit(0).alias("size"), p.alias("run")))

    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("[0-9]+|[^0-9]+"), F.lit(0)), part)


def sort_rows(df: DataFrame, keys: list[tuple[str, str]], case_insensitive: bool = False, natural: bool = False) -> DataFrame:
    """L2: sort by chosen columns; NULLs last in both directions.

    ``natural`` sorts string columns as the grid does by itself (``natural_key``); ``case_insensitive`` compares them in
    lower case, as the grid's text sort does. A full sort is a range exchange on the keys, so any number of rows is
    spread over the tasks.
    """
    def key(c):
        col = F.col(c)
        if isinstance(df.schema[c].dataType, T.StringType):
            if natural:
                return natural_key(col)
            if case_insensitive:
                return F.lower(col)
        return col

    cols = [key(c).desc_nulls_last() if d.lower().startswith("desc") else key(c).asc_nulls_last()
            for c, d in keys]
    return df.orderBy(*cols)


def cap(df: DataFrame, max_rows: int = SQL_MAX_LIMIT) -> DataFrame:
    """L3: at most max_rows rows; nested limits merge into one in Catalyst."""
    return df.limit(int(max_rows))
