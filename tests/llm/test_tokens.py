"""Token files and packing against the tokenizers library on whole texts."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.llm import packing, rans, token_files, tokens

SF = "/root/testdata/sf0.001"


def library_ids(path, text):
    from tokenizers import Tokenizer
    tok = library_ids.cache = getattr(library_ids, "cache", None) or Tokenizer.from_file(path)
    return [*tok.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_cached_ids_equal_the_library(spark, tokenizer_file, odd_texts):
    w = tokens.Words(tokenizer_file, limit=5000)  # a small cache is emptied often
    assert w.by_word
    texts = [t for _, t in odd_texts] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in texts:
        assert np.frombuffer(w.ids(t), "<u2").tolist() == library_ids(tokenizer_file, t)[:-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x250, exclude_categories=["Cs"]), st.sampled_from(" '.!sdtrevlm<|>")), max_size=40))
def test_cached_ids_equal_the_library_on_any_text(text):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    assert np.frombuffer(tokens.words(path).ids(text), "<u2").tolist() == library_ids(path, text)[:-1]


@pytest.mark.parametrize("n", [0, 1, 5, 255, 256, 257, 3000, 200_000])
def test_rans_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = (rng.pareto(1.0, n) * 10).astype(np.int64) % 49408
    table = rans.make_table(np.bincount(ids, minlength=49408))
    assert n == 0 or table.freq.sum() == 1 << rans.BITS
    data = rans.encode(ids, [(4, n), (None, 0)], table, table.starts())
    block = rans.Block(data)
    assert block.docs == [(4, n), (None, 0)]
    slots, starts = table.slots(), table.starts()
    assert block.decode(table, slots, starts).tolist() == ids.tolist()
    assert block.checkpoints == max(0, (-(-n // rans.LANES) - 1) // rans.CHECKPOINT_STEPS)
    for k in range(1, block.checkpoints + 1):
        assert block.decode(table, slots, starts, k).tolist() == ids[k * rans.CHECKPOINT_STEPS * rans.LANES:].tolist()


def test_rans_single_symbol_and_damage():
    ids = np.full(1000, 7)
    table = rans.make_table(np.bincount(ids, minlength=9))
    data = rans.encode(ids, [(1, 1000)], table, table.starts())
    assert rans.Block(data).decode(table, table.slots(), table.starts()).tolist() == ids.tolist()
    with pytest.raises(ValueError, match="damaged"):
        rans.Block(data[:-1] + bytes([data[-1] ^ 1]))
    other = rans.make_table(np.array([1, 1, 0, 0, 0, 0, 0, 1, 0]))
    with pytest.raises(ValueError, match="frequency table"):
        rans.Block(data).decode(other, other.slots(), other.starts())


def test_token_files_of_odd_rows(spark, make_docs, tokenizer_file, odd_texts, scratch):
    docs = make_docs(odd_texts).withColumnRenamed("source", "part")
    token_files.write_tokens(docs, f"{scratch}/t", tokenizer_file, 2, block_ids=40)
    got = token_files.read_tokens(spark, f"{scratch}/t").collect()
    want = sorted(odd_texts, key=lambda r: (r[0] is not None, r[0] or 0))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in want]
    at = 0
    for r, (_, text) in zip(got, want, strict=True):
        ids = library_ids(tokenizer_file, text)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)


FAR_IDS = [(1 << 60, "far above"), (-(1 << 62), "far below"), ((1 << 63) - 1, "last"), (-(1 << 63), "first"), (0, "zero"), (None, "none"),
           ((1 << 53) + 1, "odd"), (1 << 53, "even")]


def test_ids_of_any_size(spark, make_docs, tokenizer_file, scratch):
    docs = make_docs([*FAR_IDS, *[(i * ((1 << 50) + 1), f"text {i}") for i in range(1, 200)]]).repartition(5)
    token_files.write_tokens(docs, f"{scratch}/t", tokenizer_file, 2, block_ids=20)
    got = sorted(token_files.read_tokens(spark, f"{scratch}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)]
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_pieces(packing.pack(docs, tokenizer_file, 2, size=16).collect(), texts, tokenizer_file, 16)


def test_files_follow_each_other_in_ascending_order(spark, make_docs, tokenizer_file, scratch):
    import glob

    import pyarrow.parquet as pq
    docs = make_docs([(i, f"text number {i} " * (i % 7)) for i in range(3000)]).repartition(6)
    token_files.write_tokens(docs, f"{scratch}/t", tokenizer_file, 2, block_ids=300)
    files = sorted(glob.glob(f"{scratch}/t/blocks/part-*.parquet"))
    firsts = [x for f in files for x in pq.read_table(f).column("first_doc").to_pylist()]
    assert len(files) > 2 and len(firsts) > 50 and firsts == sorted(firsts)


def test_cache_is_bounded_by_bytes(tokenizer_file):
    w = tokens.Words(tokenizer_file, limit=100_000)
    for i in range(200):
        w.ids("".join(chr(0x4E00 + (i * 31 + k) % 20_000) for k in range(2000)))  # no blanks: one chunk a text
        w.ids(" ".join(f"w{chr(97 + k % 26)}{chr(97 + i % 26)}{'x' * (k % 50)}" for k in range(300)))
        kept = sum(len(k) + len(v) + tokens.ENTRY_BYTES for k, v in w.cache.items())
        assert kept < 3 * 100_000 and all(len(k) <= tokens.LONGEST for k in w.cache)


def test_token_files_of_no_rows(spark, make_docs, tokenizer_file, scratch):
    token_files.write_tokens(make_docs([]), f"{scratch}/t", tokenizer_file, 2)
    assert token_files.read_tokens(spark, f"{scratch}/t").count() == 0


def test_op10_equals_brute_force(spark, tokenizer_file):
    from tracefold.llm.queries import QUERIES
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op10_token_files"](spark, SF).collect()}
    at, want = 0, {}
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = library_ids(tokenizer_file, r.text)
        want[r.doc_id] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want


def check_pieces(rows, texts, path, size):
    """Every id in exactly one piece, sequences gapless and in bounds; returns the padding share."""
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
    assert set(docs) == set(texts)
    total = 0
    for d, pieces in docs.items():
        ids, at = library_ids(path, texts[d]), 0
        total += len(ids)
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == crc(ids[at: at + p.length])
            at += p.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        padding += size - at if at & (at - 1) else 0
    return padding / total


def test_op5_pieces(spark, tokenizer_file):
    from tracefold.llm.queries import QUERIES
    rows = QUERIES["op5_packing"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_pieces(rows, texts, tokenizer_file, 4096) < 0.01


def test_pieces_of_odd_rows(make_docs, tokenizer_file, odd_texts):
    texts = {d: t for d, t in odd_texts}
    docs = make_docs(list(texts.items())).withColumnRenamed("source", "offset")
    for span in (1, 1 << 20):
        check_pieces(packing.pack(docs, tokenizer_file, 2, size=64, span_ids=span).collect(), texts, tokenizer_file, 64)
    repeated = packing.pack(make_docs([(1, "a b"), (1, "a b"), (1, None)]), tokenizer_file, 2).collect()
    assert sorted(r.length for r in repeated if r.start == 0 and r.length == r.doc_tokens) or len(repeated) >= 3
    assert packing.pack(make_docs([]), tokenizer_file, 2).count() == 0


def test_cuts_are_the_cheapest():
    rnd = random.Random(5)
    for _ in range(200):
        size = rnd.randint(4, 20)
        ends = np.cumsum([rnd.randint(1, size) for _ in range(rnd.randint(1, 12))]).tolist()
        costs = [rnd.choice([0, 3, 9]) for _ in ends]
        at, best = [0, *ends], [0]
        for j in range(1, len(at)):
            best.append(min(best[i] + size - (at[j] - at[i]) + costs[j - 1] for i in range(j) if at[j] - at[i] <= size))
        cuts = packing.best_cuts(ends, costs, size)
        got, start = 0, 0
        for c in cuts:
            assert c - start <= size
            got += size - (c - start) + costs[ends.index(c)]
            start = c
        assert ends[-1] - start <= size
        assert got == min(b for b, p in zip(best, at, strict=True) if ends[-1] - p <= size)
