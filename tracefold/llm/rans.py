"""Static range asymmetric numeral system over interleaved lanes, in NumPy.

A block's ids are dealt out to ``LANES`` states, one id per lane and step. All lanes of a step are coded at
once. A state lies in [2^31, 2^63) and gives or takes 32-bit words; words are stored in the order in which the
decoder reads them. Every ``every`` steps the states and the word position are kept, so a decoder can begin there.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

LANES = 2048
BITS = 18  # of the scale; more where a corpus has over 2^16 different ids
CHECKPOINT_STEPS = 32
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)

MAGIC = b"TFRANS1\0"
# magic; scale bits; lanes; steps between checkpoints; ids; documents; words; crc32 of the table, of the ids, of the body
HEADER = struct.Struct("<8sIIIQQQIII")


@dataclass(frozen=True)
class Table:
    """Frequencies of all ids, summing to ``2 ** bits``; an id that never occurs has 0."""

    freq: np.ndarray

    @property
    def bits(self) -> int:
        return max(int(self.freq.sum()).bit_length() - 1, 0)

    @property
    def crc(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes())

    def starts(self) -> np.ndarray:
        return (np.cumsum(self.freq) - self.freq).astype(np.uint64)

    def slots(self) -> np.ndarray:
        """The id that owns each of the ``2 ** bits`` slots."""
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)


def make_table(counts: np.ndarray) -> Table:
    """Scale counts to ``2 ** BITS``, or four times their number if that is more: every id that occurs keeps at least 1,
    the rest in proportion."""
    counts = np.asarray(counts, dtype=np.float64)
    used = np.flatnonzero(counts)
    size = 1 << max(BITS, (4 * len(used) - 1).bit_length())
    freq = np.zeros(len(counts), dtype=np.int64)
    if not len(used):
        return Table(freq)
    share = counts[used] / counts[used].sum() * (size - len(used))
    floor = np.floor(share).astype(np.int64)
    left = size - len(used) - int(floor.sum())
    floor[np.argsort(floor - share, kind="stable")[:left]] += 1
    freq[used] = floor + 1
    return Table(freq)


def encode(ids: np.ndarray, docs: list[tuple[int | None, int]], table: Table, starts: np.ndarray,
           lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    """One block: header, document table, checkpoints, states and words."""
    n = len(ids)
    steps = -(-n // lanes)
    freq, start = table.freq[ids].astype(np.uint64), starts[ids]
    bits = table.bits
    limit, shift = freq << np.uint64(63 - bits), np.uint64(bits)
    x = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    given, checkpoints = 0, []
    for s in range(steps - 1, -1, -1):
        lo, hi = s * lanes, min(n, (s + 1) * lanes)
        f, now = freq[lo:hi], x[: hi - lo]
        full = now >= limit[lo:hi]
        if full.any():
            words.append(now[full].astype(np.uint32))
            given += len(words[-1])
            now = np.where(full, now >> WORD, now)
        q = now // f
        x[: hi - lo] = (q << shift) + (now - q * f) + start[lo:hi]
        if s and s % every == 0:
            checkpoints.append((given, x.copy()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    body = b"".join([
        np.array([d is not None for d, _ in docs], dtype=np.uint8).tobytes(),
        np.array([d or 0 for d, _ in docs], dtype="<i8").tobytes(),
        np.array([k for _, k in docs], dtype="<u8").tobytes(),
        np.array([given - at for at, _ in checkpoints[::-1]], dtype="<u8").tobytes(),
        *[state.astype("<u8").tobytes() for _, state in checkpoints[::-1]],
        x.astype("<u8").tobytes(), stream.astype("<u4").tobytes()])
    return HEADER.pack(MAGIC, bits, lanes, every, n, len(docs), given, table.crc,
                       zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


class Block:
    """A block read back: its documents, and its ids from the start or from any checkpoint."""

    def __init__(self, data: bytes):
        (magic, self.bits, self.lanes, self.every, self.n, n_docs, n_words,
         self.table_crc, self.ids_crc, body_crc) = HEADER.unpack_from(data)
        body = memoryview(data)[HEADER.size:]
        if magic != MAGIC or zlib.crc32(body) != body_crc:
            raise ValueError("damaged token block")
        self.steps = -(-self.n // self.lanes)
        at = 0

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, dtype, count, at)
            at += out.nbytes
            return out

        known, ids, sizes = take("<u1", n_docs), take("<i8", n_docs), take("<u8", n_docs)
        self.docs = [(int(d) if k else None, int(s)) for k, d, s in zip(known, ids, sizes, strict=True)]
        self.checkpoints = max(0, (self.steps - 1) // self.every)
        self.word_at = take("<u8", self.checkpoints)
        self.states = take("<u8", self.checkpoints * self.lanes).reshape(self.checkpoints, self.lanes)
        self.first, self.words = take("<u8", self.lanes), take("<u4", n_words)

    def decode(self, table: Table, slots: np.ndarray, starts: np.ndarray, checkpoint: int = 0) -> np.ndarray:
        """Ids from checkpoint ``checkpoint`` on (0: the whole block, checked against its crc32)."""
        if table.crc != self.table_crc:
            raise ValueError("token block of another frequency table")
        x = np.array(self.states[checkpoint - 1] if checkpoint else self.first, dtype=np.uint64)
        at = int(self.word_at[checkpoint - 1]) if checkpoint else 0
        begin, mask = checkpoint * self.every, np.uint64((1 << self.bits) - 1)
        freq, shift, words = table.freq.astype(np.uint64), np.uint64(self.bits), self.words.astype(np.uint64)
        out = np.empty(self.n - begin * self.lanes, dtype=np.uint32)
        for s in range(begin, self.steps):
            lo = s * self.lanes
            k = min(self.n - lo, self.lanes)
            now = x[:k]
            slot = now & mask
            ids = slots[slot]
            out[lo - begin * self.lanes: lo - begin * self.lanes + k] = ids
            now = freq[ids] * (now >> shift) + slot - starts[ids]
            empty = np.flatnonzero(now < LOW)
            if len(empty):
                now[empty] = (now[empty] << WORD) | words[at: at + len(empty)]
                at += len(empty)
            x[:k] = now
        if not checkpoint and zlib.crc32(out.astype("<u4").tobytes()) != self.ids_crc:
            raise ValueError("token block does not match its checksum")
        return out
