"""Record sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import PARSED
from ..schemas import RECORDS
from ..session import pin_utc

# The eight sample log records (level, message, service, tags), used in this order.
SAMPLE_TEMPLATES = [
    ("error", "Connection timeout to database", "api-gateway", ["production", "critical"]),
    ("error", "Failed to process payment", "payment-service", ["production", "payment"]),
    ("warning", "High memory usage detected", "worker-service", ["production", "performance"]),
    ("error", "Authentication failed for user", "auth-service", ["production", "security"]),
    ("info", "Successfully processed batch job", "batch-processor", ["production", "batch"]),
    ("error", "Rate limit exceeded", "api-gateway", ["production", "rate-limit"]),
    ("debug", "Cache miss for key user:123", "cache-service", ["production", "cache"]),
    ("error", "Failed to send notification email", "notification-service", ["production", "email"]),
]


def read_records(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The records table read with its fixed schema (no inference)."""
    pin_utc(spark)
    return spark.read.schema(RECORDS).format(fmt).load(path)


def read_records_jdbc(spark: SparkSession, url: str, table: str = "records", partition_column: str | None = None,
                      lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
                      properties: dict | None = None) -> DataFrame:
    """S1 from a live database: a partitioned JDBC scan (one range per task)."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


def with_parsed(df: DataFrame, col: str = "attributes") -> DataFrame:
    """The table with its JSON text column parsed into a VARIANT column beside it (NULL where it is not JSON)."""
    return df.withColumn(col + PARSED, F.try_parse_json(col))


def write_records(df: DataFrame, path: str, files_per_day: int = 16, mode: str = "errorifexists", parsed: bool = False) -> None:
    """Store records partitioned by day, so day filters (R4, N2) prune whole directories.

    Rows are spread over (day, hash of span) so a busy day is written by
    ``files_per_day`` tasks instead of one. ``parsed`` stores the attributes as a VARIANT column as well, parsed once
    here: attribute filters (R1, R2) on such a table parse no text.
    """
    day = F.to_date(F.col("start_timestamp"))
    salt = F.pmod(F.xxhash64(F.col("span_id")), F.lit(files_per_day))
    rows = with_parsed(df) if parsed else df
    (rows.withColumn("day", day)
     .repartition(F.col("day"), salt)
     .write.mode(mode).partitionBy("day").parquet(path))


def sample_records(ids: DataFrame, now: str, id_col: str = "i") -> DataFrame:
    """Sample log rows, row i from template i % 8; times start at now - 1 day + i hours.

    Driven by a DataFrame of row numbers (``spark.range(n)`` or ids of a table),
    so the rows are made in parallel on the executors.
    """
    t = F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(msg).alias("message"), F.lit(svc).alias("service"),
                           F.array(*[F.lit(x) for x in tags]).alias("tags"))
                  for lv, msg, svc, tags in SAMPLE_TEMPLATES])
    i = F.col(id_col)
    tpl = F.element_at(t, (i % len(SAMPLE_TEMPLATES) + 1).cast("int"))
    start = F.to_timestamp(F.lit(now)) - F.expr("INTERVAL 1 DAY") + F.make_dt_interval(F.lit(0), i.cast("int"))
    return ids.select(
        start.alias("created_at"), start.alias("start_timestamp"),
        (start + F.expr("INTERVAL 100 MILLISECONDS")).alias("end_timestamp"),
        F.format_string("trace-%04d", i).alias("trace_id"),
        F.format_string("span-%04d", i).alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        tpl["level"].alias("level"),
        F.concat(tpl["service"], F.lit(".handler")).alias("span_name"),
        tpl["message"].alias("message"),
        F.lit(None).cast("string").alias("attributes_json_schema"),
        F.lit("{}").alias("attributes"),
        tpl["tags"].alias("tags"),
        (tpl["level"] == "error").alias("is_exception"),
        F.lit(None).cast("string").alias("otel_status_message"),
        tpl["service"].alias("service_name"),
    )
