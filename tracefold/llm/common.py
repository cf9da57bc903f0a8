"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bounded_batches(spark: SparkSession, rows: int = 500, size: str = "16m") -> None:
    """Rows here hold whole texts, so Arrow batches are kept small: at most ``rows`` rows and about ``size`` bytes.

    A setting of the session that is already lower stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fold(column: str, modulus: int) -> Column:
    """crc32 of the column's text, modulo ``modulus`` (null ids hash as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less its columns that an operator is about to add (case-insensitive, as Spark resolves names)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def extended(df: DataFrame, fields: list[T.StructField]) -> tuple[DataFrame, T.StructType]:
    """``df`` without clashing columns, and its schema followed by ``fields``."""
    kept = without(df, [f.name for f in fields])
    return kept, T.StructType([*kept.schema.fields, *fields])


def appended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch followed by new columns."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def known_labels(labels: DataFrame, column: str, values: Iterable[int]) -> DataFrame:
    """(doc_id, label) of every label among ``values``. They are as many as the documents: no broadcast is asked for."""
    return labels.where(F.col(column).isin(*values) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(column).cast("int").alias("label"))


# bits that ids are hashed to before texts are shuffled: 2 MB, whatever the number of labels
BITS = 1 << 24


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` with the labels of ``known_labels``, joined by a shuffle where Spark does not find these small.

    A table of bits, one set by the hash of each label's id, first drops most rows without a label, so that their texts
    are not shuffled; what it lets through in error, the join drops.
    """
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(BITS))
    table = known.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("__word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("__bits"))
    placed = docs.withColumn("__p", place).withColumn("__word", F.shiftright("__p", 6)).join(F.broadcast(table), "__word")
    there = placed.where(F.expr("(shiftrightunsigned(__bits, cast(__p % 64 as int)) & 1L) = 1L"))
    return there.select(*[F.col(f"`{c}`") for c in docs.columns]).join(known, "doc_id")


def range_bounds(df: DataFrame, column: str, parts: int) -> np.ndarray:
    """At most ``parts - 1`` split points of an integer column (approximate quantiles, one narrow pass)."""
    if parts < 2:
        return np.empty(0, dtype=np.int64)
    cuts = df.select(F.col(column).cast("double").alias("v")).approxQuantile(
        "v", [k / parts for k in range(1, parts)], 0.2 / parts)
    # doubles are near enough for bounds; the greatest ones below 2^63 stay whole numbers of 64 bits
    return np.unique(np.clip(np.array(cuts, dtype=np.float64), -2.0**63, np.nextafter(2.0**63, 0)).astype(np.int64))


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_of(column: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The range each 64-bit value lies in; equal values share one, nulls take the first."""
    values = column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    return np.searchsorted(bounds, values, side="right").astype(np.int32)


def grouped(batches: Iterator[pa.RecordBatch], size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``size`` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns, one batch at a time."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def texts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[str | None]:
    """The batch's texts, converted a few rows at a time."""
    column = batch.column("text")
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def collected(df: DataFrame) -> np.ndarray:
    """The integer columns of a bounded frame as one array, without a Python object per value."""
    table = df.toArrow()
    return np.column_stack([c.to_numpy() for c in table.columns]) if table.num_rows else np.empty((0, table.num_columns), np.int64)
