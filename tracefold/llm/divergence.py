"""Source divergence: how the word use of each (lang, source) group differs from its language and its other sources.

Terms are runs of letters (A-Z lower-cased, all non-ASCII characters are letters). A language keeps the V terms that
occur in at least ``least`` of its documents. A group's share of a kept term with count c is
p = 1 + floor(10^9 (c + 5) / (N + 5 V)), N its count of all kept terms; a language's share likewise over its documents.

* **Counts.** Every task sums its documents' terms by group; one shuffle by (lang, term) brings a term's sums
  together, where a window over them gives its documents and occurrences in the language. A frequent term has one
  row a group and task there, whatever its number of occurrences.
* **Pairs.** The distance of two groups of a language is the sum of |p - q| over its kept terms. Terms are dealt out in
  slices of about ``CELLS`` cells (terms times groups) or as many terms as groups; a task holds one slice as a
  matrix and gives one partial sum for each pair, which Spark adds up. A group without a term has its least share there.
* **Terms.** A term's excess over the language is greatest where the group's count is high and the language's is low.
  Within one group the shares only depend on these two counts, so a term that is met or beaten in both by k
  others that are also earlier in UTF-8 cannot be among the first k. Partitions keep the skyband: terms dominated
  so by fewer than k others. Skybands are merged into one per group, and its terms are ranked by their exact excess.
  Terms without excess are left out first: what dominates a term with excess has at least as much.

All arithmetic is on whole numbers: shares by long division in three steps of three digits, exact for counts up to 10^15.

Defined results: null text, lang and source are empty strings. Groups without terms, and languages without kept terms,
have their pairs (distance 0 if V = 0) and no terms. A group alone in its language has no pairs. Repeated rows count
each. An empty table gives no rows. ``doc_id`` is not read. The driver gets one row for each group, of which the
result holds all pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import common

SMOOTH, SCALE = 5, 1_000_000_000
CELLS = 32_768
ENTRIES = 400_000
BAND_ROWS = 100_000
# A-Z become a-z; other ASCII characters but letters become blanks; bytes of other characters stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"
BAND = "lang string, source string, term string, n long, lang_n long, value long"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split(b" ") if text else []


def task_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed within tasks (in bounded dictionaries)."""

    def flush(sums: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), found in sums.items():
            packed = np.fromiter(found.values(), dtype=np.int64, count=len(found))
            names, size = list(found), 20_000
            for at in range(0, len(names), size):
                part, word = packed[at: at + size], pa.array(names[at: at + size], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([
                    pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), np.int8)), pa.array([v], pa.string())).cast(pa.string())
                    for v in (lang, source)] + [word, pa.array(part & ((1 << 40) - 1)), pa.array(part >> 40)],
                    names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], dict[bytes, int]] = {}
        entries = 0
        for batch in batches:
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            for group, text in zip(groups, common.texts(batch), strict=True):
                found = Counter(terms(text))
                found.pop(b"", None)
                own = sums.setdefault(group, {})
                entries -= len(own)
                for term, n in found.items():  # both sums in one number: n below 2^40 between two flushes
                    own[term] = own.get(term, 0) + n + (1 << 40)
                entries += len(own)
            if entries > ENTRIES:
                yield from flush(sums)
                sums, entries = {}, 0
        yield from flush(sums)

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*text).mapInArrow(run, COUNTS)


def kept_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, lang_n) of the terms in at least ``least`` documents of the language; one shuffle."""
    word = Window.partitionBy("lang", "term")
    sums = task_counts(docs).repartition("lang", "term")
    kept = sums.withColumn("lang_docs", F.sum("docs").over(word)).withColumn("lang_n", F.sum("n").over(word))
    return kept.where(F.col("lang_docs") >= least).groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.max("lang_n").alias("lang_n")).select("lang", "source", "term", "n", "lang_n")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, v): every group that occurs, its and its language's N, and V."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("v"))
    return groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "v"])


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * counts / total) by long division in three steps of three digits."""
    out, rest = np.zeros(np.broadcast(counts, total).shape, dtype=np.int64), counts
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def pair_sums(kept: DataFrame, totals: dict[str, tuple[list[str], list[int], int]]) -> DataFrame:
    """(lang, one, other, value): sums of |p - q| over a language's kept terms, for one < other in its list of sources."""
    # terms in a slice: CELLS over the groups, but no fewer than the groups, so that partial sums stay below the input
    slices = {lang: max(1, -(-v // max(CELLS // len(names), len(names)))) for lang, (names, _, v) in totals.items()}

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        names, sums, v = totals[lang]
        n = len(names)
        below = np.array(sums, dtype=np.int64) + SMOOTH * v
        place = {s: k for k, s in enumerate(names)}
        rows = np.array([place[s] for s in table.column("source").to_pylist()], dtype=np.int64)
        word = table.column("term").combine_chunks().dictionary_encode()
        counts = np.zeros((n, len(word.dictionary)), dtype=np.int64)
        counts[rows, word.indices.to_numpy()] = table.column("n").to_numpy()
        p = shares(counts + SMOOTH, below[:, None])
        one, other, value = [], [], []
        for k in range(n - 1):
            one.append(np.full(n - k - 1, k))
            other.append(np.arange(k + 1, n))
            value.append(np.abs(p[k + 1:] - p[k]).sum(axis=1))
        columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (one, other, value)]
        return pa.table({"lang": pa.array([lang] * len(columns[0]), pa.string()), **{
            c: pa.array(x.astype(np.int64)) for c, x in zip(("one", "other", "value"), columns, strict=True)}})

    many = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(k)) for lang, k in slices.items() if k > 1], F.lit(1))
    parts = kept.select("lang", "source", "term", "n", F.pmod(F.xxhash64("lang", "term"), many).alias("slice"))
    return parts.groupBy("lang", "slice").applyInArrow(run, "lang string, one long, other long, value long").groupBy(
        "lang", "one", "other").agg(F.sum("value").alias("value"))


def pairs(groups: DataFrame, sums: DataFrame) -> DataFrame:
    """(lang, source, item, value): every group and each other source of its language."""
    order = Window.partitionBy("lang").orderBy("source")
    numbered = groups.select("lang", "source", (F.row_number().over(order) - 1).cast("long").alias("k"))
    left, right = numbered.toDF("lang", "source", "a"), numbered.toDF("lang", "item", "b")
    every = left.join(right, "lang").where(F.col("a") != F.col("b"))  # the result has exactly these rows
    keyed = every.withColumn("one", F.least("a", "b")).withColumn("other", F.greatest("a", "b"))
    return keyed.join(sums, ["lang", "one", "other"], "left").select(
        "lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def band_of(rows: list[tuple[int, int, bytes, int]], k: int) -> list[tuple[int, int, bytes, int]]:
    """The (count, language count, term, excess) rows dominated by fewer than k others.

    In the order (falling count, rising language count, term) a row comes behind all that dominate it, and a row
    dominated by k others is dominated by k of the band, so the band found so far tells.
    """
    rows = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    place = {t: i for i, t in enumerate(sorted(r[2] for r in rows))}
    below, at, held, out = np.empty(64, np.int64), np.empty(64, np.int64), 0, []
    for row in rows:
        lang_n, i = row[1], place[row[2]]
        if held >= k and np.count_nonzero((below[:held] <= lang_n) & (at[:held] < i)) >= k:
            continue
        if held == len(below):
            below, at = np.resize(below, 2 * held), np.resize(at, 2 * held)
        below[held], at[held] = lang_n, i
        held += 1
        out.append(row)
    return out


def skybands(counts: DataFrame, k: int) -> DataFrame:
    """Every partition's skyband of each of its groups. Memory is bounded: what grows too large is handed on."""

    def table(bands: dict[tuple[str, str], list]) -> Iterator[pa.RecordBatch]:
        rows = [(g[0], g[1], *row) for g, band in bands.items() for row in band]
        for at in range(0, len(rows), 20_000):
            lang, source, n, m, term, value = zip(*rows[at: at + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()),
                *[pa.array(x, pa.int64()) for x in (n, m, value)]], names=["lang", "source", "term", "n", "lang_n", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands: dict[tuple[str, str], list[tuple[int, int, bytes, int]]] = {}
        held = 0
        for batch in batches:
            terms_ = batch.column("term").cast(pa.binary()).to_pylist()
            groups = zip(*(batch.column(c).to_pylist() for c in ("lang", "source")), strict=True)
            numbers = (batch.column(c).to_pylist() for c in ("n", "lang_n", "value"))
            for group, t, n, m, value in zip(groups, terms_, *numbers, strict=True):
                bands.setdefault(group, []).append((n, m, t, value))
            held += batch.num_rows
            if held > BAND_ROWS:
                bands = {g: band_of(rows, k) for g, rows in bands.items()}
                held = sum(map(len, bands.values()))
                if held > BAND_ROWS // 2:
                    yield from table(bands)
                    bands, held = {}, 0
        yield from table({g: band_of(rows, k) for g, rows in bands.items()})

    return counts.mapInArrow(run, BAND)


def share(n: str, total: str) -> str:
    return f"(1 + (cast({SCALE} as decimal(38,0)) * ({n} + {SMOOTH})) div cast({total} + {SMOOTH} * v as decimal(38,0)))"


def excess(kept: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(lang, source, item, value): candidates for the k terms that exceed the language's share most, from skybands."""
    value = F.expr(f"cast({share('n', 'total')} - {share('lang_n', 'lang_total')} as bigint)")
    more = kept.join(groups, ["lang", "source"]).withColumn("value", value).where(F.col("value") > 0)
    bands = skybands(more.select("lang", "source", "term", "n", "lang_n", "value"), k)
    merged = skybands(bands.repartition("lang", "source"), k)
    return merged.select("lang", "source", F.col("term").alias("item"), "value")


def divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """Ranked distances of each group to its language's other groups, and the ``top`` terms it exceeds its language in."""
    kept = materialize(kept_counts(docs, least), "divergence-counts")
    groups = materialize(group_totals(docs, kept), "divergence-groups")
    totals: dict[str, tuple[list[str], list[int], int]] = {}
    for r in sorted(groups.collect(), key=lambda r: (r.lang, r.source.encode())):
        names, sums, _ = totals.setdefault(r.lang, ([], [], r.v))
        names.append(r.source)
        sums.append(r.total)
    rank = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(rank)).select(
            "lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    terms_ = ranked(excess(kept, groups, top), "term").where(F.col("rank") <= top)
    return ranked(pairs(groups, pair_sums(kept, totals)), "pair").unionByName(terms_)


def oracle(least: int = 30, top: int = 50) -> str:
    """DuckDB twin: counts by plain grouping, every pair of groups over every kept term."""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {least}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
grps AS (SELECT DISTINCT lang, source FROM d),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + {SMOOTH})) //
    (coalesce(t.total, 0) + {SMOOTH} * l.v) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (k.n + {SMOOTH})) // (l.total + {SMOOTH} * l.v) AS BIGINT) AS q
  FROM grps g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
    LEFT JOIN totals t USING (lang, source)),
distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source != b.source
    LEFT JOIN distances x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}
"""
