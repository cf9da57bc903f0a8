"""Artifact bookkeeping over a manifest DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ARTIFACT_TTL_MINUTES
from .sequence import running_index

RUN = "run_id"


def run_prefix(run_id: Column) -> Column:
    """First 8 characters of the run id, or 'unknown' when it is empty."""
    return F.when(F.coalesce(run_id, F.lit("")) == "", F.lit("unknown")).otherwise(F.substring(run_id, 1, 8))


def assign_artifact_ids(results: DataFrame, order: list[str] = ("created_at", "result_key"),
                        bucket: Column | None = None) -> DataFrame:
    """``a_<run prefix>_<n>`` with n = 1, 2, ... per run in creation order.

    The counter is a skew-safe running index bucketed by creation day, so a run
    holding most artifacts is still spread over many tasks.
    """
    b = bucket if bucket is not None else F.floor(F.unix_seconds(F.col(order[0]).cast("timestamp")) / 86400)
    idx = running_index(results, [RUN], list(order), b, "counter", base=1)
    return idx.withColumn("artifact_id", F.concat(F.lit("a_"), run_prefix(F.col(RUN)), F.lit("_"),
                                                  F.col("counter").cast("string")))


def assign_random_artifact_ids(results: DataFrame, key: str = "result_key") -> DataFrame:
    """``a_<run prefix>_<8 hex>``; the hex part is a hash of (run, key), so a retried task gets the same id."""
    h = F.substring(F.md5(F.concat_ws(":", F.col(RUN), F.col(key).cast("string"))), 1, 8)
    return results.withColumn("artifact_id", F.concat(F.lit("a_"), run_prefix(F.col(RUN)), F.lit("_"), h))


def is_expired(now: str, ttl_minutes: int = ARTIFACT_TTL_MINUTES, col: str = "created_at") -> Column:
    """``now - created_at > ttl`` (strict)."""
    return (F.to_timestamp(F.lit(now)) - F.col(col)) > F.make_dt_interval(F.lit(0), F.lit(0), F.lit(ttl_minutes))


def expire(manifest: DataFrame, now: str, ttl_minutes: int = ARTIFACT_TTL_MINUTES) -> DataFrame:
    """Live manifest rows."""
    return manifest.where(~is_expired(now, ttl_minutes))


def list_artifacts(manifest: DataFrame, now: str, ttl_minutes: int = ARTIFACT_TTL_MINUTES,
                   run_id: str | None = None) -> DataFrame:
    """Live artifact ids (of one run, or of every run)."""
    live = expire(manifest, now, ttl_minutes)
    if run_id is not None:
        live = live.where(F.col(RUN) == run_id)
    return live.select(RUN, "artifact_id")


def lookup_artifact(manifest: DataFrame, requests: DataFrame) -> DataFrame:
    """Manifest rows for requested (run_id, artifact_id) pairs; the right id under another run is missing."""
    return requests.join(manifest, [RUN, "artifact_id"], "inner")


def artifact_exists(requests: DataFrame, manifest: DataFrame, now: str,
                    ttl_minutes: int = ARTIFACT_TTL_MINUTES) -> DataFrame:
    """Each export request with status 'ok' (live artifact of that run) or 'missing'."""
    live = expire(manifest, now, ttl_minutes).select(RUN, "artifact_id", F.lit(True).alias("__live"))
    return (requests.join(live, [RUN, "artifact_id"], "left")
            .withColumn("status", F.when(F.col("__live"), F.lit("ok")).otherwise(F.lit("missing")))
            .drop("__live"))


def artifact_stats(manifest: DataFrame, now: str, ttl_minutes: int = ARTIFACT_TTL_MINUTES) -> DataFrame:
    """Artifacts per run: count, rows, live vs expired (one partial aggregate)."""
    exp = is_expired(now, ttl_minutes)
    return manifest.groupBy(RUN).agg(
        F.count(F.lit(1)).alias("n_artifacts"),
        F.sum("row_count").alias("total_rows"),
        F.count_if(~exp).alias("n_live"),
        F.count_if(exp).alias("n_expired"),
        F.max("created_at").alias("last_created_at"))
