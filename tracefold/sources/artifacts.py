"""Artifact storage: Parquet data + a Parquet manifest, previews, CSV export.

Results are written by the executors; nothing is collected.  The manifest is
an append-only Parquet dataset, partitioned by run, with one row per artifact.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.artifacts import expire, run_prefix
from ..operators.records import cell_text, timestamps_as_text
from ..schemas import ARTIFACT_MANIFEST, ARTIFACT_TTL_MINUTES, PREVIEW_ROWS, SQL_MAX_LIMIT


# a stored row's place in the result; dropped again when an artifact is read
ROW = "__row"
RUN_ID = re.compile(r"[A-Za-z0-9_][A-Za-z0-9._-]{0,127}")


@dataclass
class ArtifactRef:
    id: str
    type: str
    row_count: int
    was_capped: bool
    location: str


def run_folder(run_id: str | None) -> str:
    """The folder name of a run ('unknown' without one); ids that could leave the root are refused."""
    if not run_id:
        return "unknown"
    if not RUN_ID.fullmatch(run_id):
        raise ValueError(f"run id {run_id!r} cannot name a folder")
    return run_id


def _manifest_path(root: str) -> str:
    return f"{root.rstrip('/')}/_manifest"


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The artifact manifest under ``root`` (empty, with its schema, before the first artifact).

    It is partitioned by run, so a filter on ``run_id`` reads that run's folder only. Only a missing folder
    counts as no manifest; any other read error is raised.
    """
    try:
        found = spark.read.schema(ARTIFACT_MANIFEST).parquet(_manifest_path(root))
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], ARTIFACT_MANIFEST)
    return found.select(*ARTIFACT_MANIFEST.fieldNames())


def write_artifact(df: DataFrame, run_id: str, root: str, max_rows: int | None = SQL_MAX_LIMIT,
                   type_: str = "table", now: dt.datetime | None = None, asked: DataFrame | None = None) -> ArtifactRef:
    """Store a result as Parquet under ``root/<run>/<artifact id>`` and append a manifest row.

    ``df`` is the result before the cap. It runs once, up to one row beyond ``max_rows``: that row is counted,
    not stored, and tells ``was_capped`` (None: no cap). ``asked`` is what was asked for, where ``df`` already has a
    cap of its own: it is counted, to one row beyond the stored ones at most, if ``df`` was not cut. Ids are random (W5), so writers never meet, and existing
    data is never overwritten. The manifest row follows the data, so a reader never sees half an artifact.
    Timestamps are stored as text (R10); every row keeps its place in the result for previews.
    """
    spark = df.sparkSession
    folder = run_folder(run_id)
    artifact_id = f"a_{run_id[:8] if run_id else 'unknown'}_{uuid.uuid4().hex[:8]}"
    location = f"{root.rstrip('/')}/{folder}/{artifact_id}"
    # at most max_rows + 1 rows, in one partition, so their ids count from 0
    rows = timestamps_as_text(df if max_rows is None else df.limit(int(max_rows) + 1).coalesce(1))
    obs = Observation(f"rows_{artifact_id}")
    seen = rows.observe(obs, F.count(F.lit(1)).alias("rows")).withColumn(ROW, F.monotonically_increasing_id())
    if max_rows is not None:
        seen = seen.where(F.col(ROW) < int(max_rows))
    seen.write.mode("errorifexists").parquet(location)
    n = int(obs.get["rows"])
    was_capped = max_rows is not None and n > max_rows
    stored = min(n, max_rows) if max_rows is not None else n
    if asked is not None and not was_capped:
        was_capped = asked.limit(stored + 1).count() > stored
    created = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    row = [(folder, artifact_id, type_, stored, stored, was_capped, len(df.columns), created, location)]
    (spark.createDataFrame(row, ARTIFACT_MANIFEST).coalesce(1)
     .write.mode("append").partitionBy("run_id").parquet(_manifest_path(root)))
    return ArtifactRef(artifact_id, type_, stored, was_capped, location)


def _stored(spark: SparkSession, root: str, run_id: str, artifact_id: str, now: str | None,
            ttl_minutes: int) -> tuple[str, DataFrame] | None:
    """Location and stored rows of a live artifact of the run."""
    m = read_manifest(spark, root).where((F.col("run_id") == run_folder(run_id)) & (F.col("artifact_id") == artifact_id))
    if now is not None:
        m = expire(m, now, ttl_minutes)
    hit = m.select("location").limit(1).collect()  # at most one metadata row
    return (hit[0]["location"], spark.read.parquet(hit[0]["location"])) if hit else None


def read_artifact(spark: SparkSession, root: str, run_id: str, artifact_id: str, now: str | None = None,
                  ttl_minutes: int = ARTIFACT_TTL_MINUTES) -> DataFrame | None:
    """The stored frame (schema kept even with no rows); None when missing or expired."""
    found = _stored(spark, root, run_id, artifact_id, now, ttl_minutes)
    return found[1].drop(ROW) if found else None


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """L1 for stored artifacts: the first n (>= 1) rows of the result."""
    return df.orderBy(ROW).limit(max(int(n), 1)).drop(ROW)


def artifact_data(spark: SparkSession, root: str, run_id: str, artifact_id: str, mode: str = "preview",
                  n: int = PREVIEW_ROWS, now: str | None = None,
                  ttl_minutes: int = ARTIFACT_TTL_MINUTES) -> dict:
    """T13: 'download' -> the location that the manifest names, on any file system; otherwise the preview frame."""
    found = _stored(spark, root, run_id, artifact_id, now, ttl_minutes)
    if found is None:
        return {"status": "not_found"}
    location, df = found
    if mode == "download":
        return {"status": "ok", "mode": "download", "location": location}
    return {"status": "ok", "mode": "preview", "preview": preview(df, n), "columns": df.drop(ROW).columns}


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header; NULL -> empty field; quoted only when needed; '"' doubled.

    Arrays and structs are turned into text first (the CSV sink refuses them).
    """
    text = df.select(*[cell_text(df, c).alias(c) if not isinstance(df.schema[c].dataType, (T.StringType,))
                       else F.col(c) for c in df.columns])
    (text.write.mode(mode)
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("nullValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def csv_field(c) -> F.Column:
    """One CSV field by the export rule."""
    s = F.coalesce(c, F.lit(""))
    needs = s.contains(",") | s.contains("\n") | s.contains('"')
    return F.when(needs, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each row as one CSV line (the byte-exact, oracle-checkable twin of S7)."""
    cols = columns or df.columns
    return df.select(F.concat_ws(",", *[csv_field(cell_text(df, c)) for c in cols]).alias("csv_line"))


def csv_header(columns: list[str]) -> str:
    """The header line by the same quoting rule."""
    def q(x):
        return f'"{x.replace(chr(34), chr(34) * 2)}"' if ("," in x or "\n" in x or '"' in x) else x
    return ",".join(q(c) for c in columns)


__all__ = ["ArtifactRef", "write_artifact", "read_manifest", "read_artifact", "artifact_data", "preview",
           "export_csv", "csv_rows", "csv_field", "csv_header", "run_prefix"]
