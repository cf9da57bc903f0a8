"""Token ids of whole texts by a public tokenizer file, with a cache of words.

The tokenizer drops white space and never merges across it, nor across the pieces that its own pattern cuts a text
into. Texts of printable Latin-1 characters are cut at blanks by Arrow, a batch at a time, and only a batch's different
words are looked at: a word's ids are remembered, an unknown word is cut by the pattern, and all pieces that are not
known go to the library in one call. In any other text the blank-separated chunks with other characters go through
the library's whole ``encode``. Either way the ids are the library's; ``tests/llm`` compare them with ``encode`` on
whole texts.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_BYTES = 96 << 20
ENTRY_BYTES = 200  # what an entry costs beside its own bytes, roughly
LONGEST = 64  # longer pieces and chunks are encoded each time and not remembered

# The tokenizer file's pattern for printable ASCII and Latin-1 letters, after lower-casing.
OTHER_TEXT = "[^ \n!-~À-ÖØ-öø-ÿ]|<\\|"
FAST_CHUNK = re.compile("[!-~À-ÖØ-öø-ÿ]+")
FAST_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
FAST_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FAST_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


class Words:
    """The tokenizer of a file with a cache: word, piece or other chunk -> its ids as little-endian bytes.

    The cache is emptied when it holds ``limit`` bytes, and takes no long entries: memory is bounded whatever the texts
    hold.
    """

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.limit, self.held, self.cache = limit, 0, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        suffix = spec["model"].get("end_of_word_suffix")
        # in files of another kind white space can be part of a token: there a text is encoded whole
        self.by_word = ([s["type"] for s in steps] == FAST_NORMALIZERS and suffix == "</w>"
                        and splits[0].get("pattern") == {"Regex": FAST_PATTERN})
        self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        # the same model for pieces, which are lower-case and cut already: blanks part them, bytes become letters
        self.pieces = Tokenizer.from_file(path)
        self.pieces.normalizer = normalizers.Sequence([])
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def remember(self, new: dict[str, bytes]) -> None:
        if self.held > self.limit:
            self.cache.clear()
            self.held = 0
        if max(map(len, new), default=0) > LONGEST:
            new = {w: ids for w, ids in new.items() if len(w) <= LONGEST}
        self.cache.update(new)
        self.held += sum(map(len, new)) + sum(map(len, new.values())) + ENTRY_BYTES * len(new)

    def learned(self, unknown: list[str]) -> dict[str, bytes]:
        """The ids of pieces, by one call of the library: every piece ends with the only token that closes a word."""
        encoding = self.pieces.encode_batch_fast([" ".join(unknown)], add_special_tokens=False)[0]
        ids, size = np.array(encoding.ids, dtype=self.dtype), self.dtype.itemsize
        ends = ((np.flatnonzero(self.last[ids]) + 1) * size).tolist()
        data = ids.tobytes()
        return dict(zip(unknown, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def word_ids(self, distinct: list[str], again: np.ndarray) -> list[bytes]:
        """The ids of different lower-case words. Only those that come again in their batch are remembered: most words
        come once, and a small cache is a fast one."""
        parts = list(map(self.cache.get, distinct))
        places = [i for i, ids in enumerate(parts) if ids is None]
        if places:
            missing = [distinct[i] for i in places]
            cut = {w: FAST_PIECE.findall(w) for w in missing if not w.isalpha()}
            unknown = [w for w in missing if w not in cut] if cut else missing
            more = set().union(*cut.values()).difference(self.cache, unknown)
            new = self.learned([*unknown, *more]) if unknown or more else {}
            for w, pieces in cut.items():
                new[w] = b"".join([new[p] if p in new else self.cache[p] for p in pieces])
            for i, ids in zip(places, map(new.__getitem__, missing), strict=True):
                parts[i] = ids
            self.remember({distinct[i]: parts[i] for i in np.array(places)[again[places]].tolist()})
        return parts

    def mixed(self, text: str) -> bytes:
        """A text with other characters: chunk by chunk."""
        out: list[bytes] = []
        for chunk in text.replace("\n", " ").split(" "):
            if not chunk:
                continue
            if FAST_CHUNK.fullmatch(chunk) and "<|" not in chunk:
                out += self.word_ids([chunk.lower()], np.ones(1, dtype=bool))
                continue
            key = "\n" + chunk  # no word holds a line break, so it is not taken for one
            ids = self.cache.get(key)
            if ids is None:
                ids = self.encoded(chunk)
                self.remember({key: ids})
            out.append(ids)
        return b"".join(out)

    def fast(self, texts: pa.Array) -> list[bytes]:
        """Texts of the fast kind, without nulls: cut and counted by Arrow, put together by NumPy."""
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        ends, words_ = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        if not len(words_):
            return [b""] * len(texts)
        at = words_.indices.to_numpy()
        parts = self.word_ids(words_.dictionary.to_pylist(), np.bincount(at, minlength=len(words_.dictionary)) > 1)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // self.dtype.itemsize
        flat, begins = np.frombuffer(b"".join(parts), self.dtype), np.cumsum(sizes) - sizes
        lengths = sizes[at]
        stops = np.concatenate([[0], np.cumsum(lengths)])
        narrow = np.int32 if stops[-1] < 1 << 31 else np.int64
        data = flat[np.repeat((begins[at] - stops[:-1]).astype(narrow), lengths) + np.arange(stops[-1], dtype=narrow)].tobytes()
        cuts = (stops[ends - ends[0]] * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def many(self, texts: pa.Array) -> list[bytes]:
        """Ids of whole texts (null: none) as little-endian bytes, in order."""
        texts = texts.fill_null("")
        if not self.by_word:
            return [self.encoded(t) for t in texts.to_pylist()]
        other = pc.match_substring_regex(texts, OTHER_TEXT)
        if not pc.any(other).as_py():
            return self.fast(texts)
        quick = iter(self.fast(texts.filter(pc.invert(other))))
        return [self.mixed(t.as_py()) if o else next(quick) for t, o in zip(texts, other.to_pylist(), strict=True)]

    def ids(self, text: str | None) -> bytes:
        """Ids of one whole text."""
        return self.many(pa.array([text], pa.string()))[0]


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    """The tokenizer of a file, once per Python worker."""
    return Words(path)


@lru_cache(maxsize=2)
def sentence_ends(path: str) -> np.ndarray:
    """By id: whether its text ends a sentence."""
    tok = words(path).tokenizer
    ends = np.zeros(tok.get_vocab_size(), dtype=bool)
    for token, i in tok.get_vocab().items():
        ends[i] = token.removesuffix("</w>").endswith((".", "!", "?"))
    return ends


def id_bytes(path: str, end_id: int):
    """column of texts -> the ids and the end id of each, as bytes of the narrowest integer type that holds them; that type."""
    w = words(path)
    dtype = np.dtype("<u4") if end_id >= 1 << 16 else w.dtype
    tail = np.array([end_id], dtype=dtype).tobytes()
    if dtype == w.dtype:
        return (lambda texts: [ids + tail for ids in w.many(texts)]), dtype
    return (lambda texts: [np.frombuffer(ids, w.dtype).astype(dtype).tobytes() + tail for ids in w.many(texts)]), dtype


def id_dtype(path: str, end_id: int) -> np.dtype:
    """The integer type of ``id_bytes``."""
    return id_bytes(path, end_id)[1]
