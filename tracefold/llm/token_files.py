"""Token-ID / binary output: static rANS blocks in document order, written and read back by Spark.

Flow: texts become ids in the scan's tasks, which also count the ids; both are written to the shared folder, so a
text is tokenized once. The counts of all documents make one shared frequency table (at most one row per id of the
vocabulary). Documents are then dealt out by ranges of ``doc_id`` (one shuffle), sorted, and whole documents fill
blocks, each coded on its own. Blocks are binary rows of a Parquet dataset whose files follow each other in
ascending ``doc_id`` order, so Spark's committer gives atomic output on any file system and a lost task is
simply rerun. Each block carries its documents, its first position in the corpus, checkpoints and checksums.

Defined results: a null or empty text has the end id only. Rows with a null ``doc_id`` come first; repeated
ids lie side by side, ordered by their token bytes; ids may be any 64-bit numbers. A text of any length stays in one
block (with more checkpoints). An empty table gives an empty dataset. Columns other than ``doc_id`` and ``text`` are
not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import common, rans, tokens

BLOCK_IDS = 1 << 17
# one row a document; a row without a range holds a task's counts of ids
IDS = "part int, doc_id long, n long, ids binary"
CODED = "part int, block int, first_doc long, first_id long, n_ids long, n_docs long, payload binary"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, bounds: np.ndarray, counted: bool = False) -> DataFrame:
    """(part, doc_id, n, ids): the ids of every text with the end id, compressed; ``part`` is the range of its doc_id.

    ``counted`` adds rows with a null part: how often each id occurs in the task's texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, dtype = tokens.id_bytes(tokenizer, end_id)
        compress, total = zstandard.ZstdCompressor(level=1).compress, np.zeros(0, dtype=np.int64)
        for batch in common.grouped(batches):
            data = encode(batch.column("text"))
            sizes, packed = [len(d) // dtype.itemsize for d in data], [compress(d) for d in data]
            if counted:
                found = np.bincount(np.frombuffer(b"".join(data), dtype), minlength=len(total))
                found[: len(total)] += total
                total = found
            yield pa.RecordBatch.from_arrays([
                pa.array(common.range_of(batch.column("doc_id"), bounds), pa.int32()), batch.column("doc_id"),
                pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["part", "doc_id", "n", "ids"])
        if len(total):
            yield pa.RecordBatch.from_arrays([
                pa.array([None], pa.int32()), pa.array([None], pa.int64()), pa.array([int(total.sum())], pa.int64()),
                pa.array([compress(total.astype("<i8").tobytes())], pa.binary())], names=["part", "doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, IDS)


def dealt_out(rows: DataFrame, parts: int) -> DataFrame:
    """Every range in the task of its number, sorted by doc_id."""
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", "ids")


def in_order(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``tokenized`` documents dealt out by range, in order."""
    bounds = common.range_bounds(docs, "doc_id", common.shuffle_parts(docs))
    return dealt_out(tokenized(docs, tokenizer, end_id, bounds), len(bounds) + 1)


def id_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents: the tasks' counts summed by Spark, at most ``size`` rows collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor().decompress, np.zeros(size, dtype=np.int64)
        for (data,) in common.rows_of(batches, "ids"):
            found = np.frombuffer(unpack(data), "<i8")
            total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    counts = np.zeros(size, dtype=np.int64)
    found = common.collected(rows.where(F.col("part").isNull()).select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")))
    counts[found[:, 0]] = found[:, 1]
    return counts


def coded_blocks(ordered: DataFrame, dtype: str, table: rans.Table, before: dict[int, int], block_ids: int) -> DataFrame:
    """Fill blocks with whole documents of one range, in order, up to about ``block_ids`` ids each, and code them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, starts = zstandard.ZstdDecompressor().decompress, table.starts()
        width = np.dtype(dtype).itemsize
        part, block, start, docs, pieces, held = None, 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            payload = rans.encode(np.frombuffer(b"".join(pieces), dtype), docs, table, starts)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([docs[0][0]], pa.int64()),
                pa.array([before[part] + start], pa.int64()), pa.array([held], pa.int64()), pa.array([len(docs)], pa.int64()),
                pa.array([payload], pa.binary())], names=[c.split()[0] for c in CODED.split(", ")])

        for p, doc, n, data in common.rows_of(batches, "part", "doc_id", "n", "ids"):
            if docs and (p != part or held + n > block_ids):
                yield flush()
                block, start, docs, pieces, held = block + 1, start + held, [], [], 0
            if p != part:
                part, block, start = p, 0, 0
            docs.append((doc, n))
            pieces.append(unpack(data, max_output_size=n * width))
            held += n
        if docs:
            yield flush()

    return ordered.mapInArrow(run, CODED)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Write ``path/table`` (the shared frequencies) and ``path/blocks`` (coded blocks, ascending doc_id)."""
    spark = docs.sparkSession
    dtype, vocab = tokens.id_dtype(tokenizer, end_id).str, tokens.words(tokenizer).tokenizer.get_vocab_size()
    bounds = common.range_bounds(docs, "doc_id", common.shuffle_parts(docs))
    tokenized(docs, tokenizer, end_id, bounds, counted=True).write.parquet(f"{path}/ids")
    rows = spark.read.schema(IDS).parquet(f"{path}/ids")
    table = rans.make_table(id_counts(rows, max(vocab, end_id + 1)))
    freq = [(i, int(f)) for i, f in enumerate(table.freq)]
    spark.createDataFrame(freq, "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    rows = rows.where(F.col("part").isNotNull())
    # one row per range, and there are at most as many ranges as shuffle partitions
    before, at = {}, 0
    for r in sorted(rows.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.part):
        before[r.part], at = at, at + r.n
    coded_blocks(dealt_out(rows, len(bounds) + 1), dtype, table, before, block_ids).write.parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> rans.Table:
    """The shared frequency table (one row per id of the vocabulary)."""
    rows = spark.read.parquet(f"{path}/table").collect()
    freq = np.zeros(max((r.id for r in rows), default=-1) + 1, dtype=np.int64)
    for r in rows:
        freq[r.id] = r.freq
    return rans.Table(freq)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode every block on its own: (doc_id, start, n_tokens, ids_crc32[, ids as little-endian 32-bit integers])."""
    table = read_table(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, starts = table.slots(), table.starts()
        for first, payload in common.rows_of(batches, "first_id", "payload"):
            block = rans.Block(payload)
            data = memoryview(block.decode(table, slots, starts).astype("<u4")).cast("B")
            ends = np.cumsum([n for _, n in block.docs])
            begins = ends - [n for _, n in block.docs]
            parts = [data[4 * a: 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            columns = {
                "doc_id": pa.array([d for d, _ in block.docs], pa.int64()), "start": pa.array(begins + first, pa.int64()),
                "n_tokens": pa.array([n for _, n in block.docs], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64())}
            if with_ids:
                columns["ids"] = pa.array([bytes(p) for p in parts], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return spark.read.schema(CODED).parquet(f"{path}/blocks").select("first_id", "payload").mapInArrow(run, schema)


def token_digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the token files of ``docs`` into the shared folder, read them back, and report each document."""
    path = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/token-files-{uuid.uuid4().hex[:12]}"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path, with_ids=False)
