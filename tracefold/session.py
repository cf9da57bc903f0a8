"""Session helpers: configuration every query relies on, and the checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Fixed reference time used by registered queries instead of current_timestamp(),
# so that Spark and the SQL twin see the same "now".
NOW = "2024-01-15 10:00:00"
# Fixed day used by the flagship "yesterday's errors" roll-up.
DAY = "2024-01-15"


def build_session(master: str = "local[8]", app: str = "tracefold",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Local session for tests and the benchmark (a cluster passes its own session)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> None:
    """All timestamp arithmetic in this library assumes a UTC session."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised intermediates.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared file
    system every executor can reach); without it this raises, as a folder of
    one machine would lose data.  Only a local session (one JVM: tests, local
    runs) gets a scratch folder of its own when it is unset.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return str(configured)
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="tracefold-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage of a long plan (a derived chunk log reused by many folds,
    say) so a lost executor recomputes from the written table, not from the
    sources.  Each call writes a new folder; nothing is overwritten.
    """
    import uuid
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/materialized/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_by(df, name: str, column: str, buckets: int):
    """Like ``materialize``, as an external table of ``buckets`` buckets of ``column``: what groups or joins by it later
    shuffles the other side only."""
    import uuid
    key = uuid.uuid4().hex[:12]
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/materialized/{name}-{key}"
    known = f"{name}_{key}".replace("-", "_")
    df.write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(known)
    return df.sparkSession.table(known)
