"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests. DataFrame functions only.

A text's units are its lines. A unit over ``LONG`` characters, or over one in ``SHARES`` of the text's, is also cut
further: lines into sentences, sentences into words, words (a text without blanks) into runs of 8 letters, these into
runs of 2. So no text has few units, and what an edit leaves of a text keeps units, whatever its length. The larger
units stay beside their parts, as the edited text may be shorter and then cuts further.

A sketch is a table of cells. The 64-bit digest of a unit goes to one cell in each of several rows; a cell keeps the
number of digests, their xor and the xor of their checks. Cells are sums, so they are made by one aggregate over rows
(digest, cell), and subtracting one version's cells from another's is the same aggregate with signs: what both share
cancels. A cell left with one digest whose check fits is pure. A peeling pass takes the pure cells of one row (there a
digest has one cell only, so none is taken twice) and takes their digests out of the other rows' cells; passes go
through the rows in turn until nothing is left. What was taken out is the difference, digest by digest.

The fingerprint is the sketch of fixed size, ``ROWS`` rows of ``WIDTH`` cells. It holds few differences, so two texts
are compared by sketches of the same digests with as many cells a row as twice their units, rounded up to a power of
two; a difference that does not peel (two digests that meet in every row, mostly) is sketched again, larger and with
another salt, until it does.

Everything runs where the texts are: they are shuffled once, by ranges of ``doc_id``, with the first text of the next
range sent along as one more row; sketches, subtraction and peeling are aggregates within these partitions. A
text of any length is as many rows as it has units, so the work is linear in them, and no list of a text's units is
held but its digests.

Defined results: null and empty texts have no units; two texts without units have likeness 1, and one without
units has likeness 0 to any other. Null ids come last in the descending order; repeated ids follow each other
by text. A table of one row is its own next document. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import common

ROWS, WIDTH = 4, 8
SIZED_ROWS, LEAST_WIDTH = 3, 16
PASSES = 5  # at most half a digest a cell: a row in turn leaves 0.39, 0.07, 0.002, ... of a difference
ATTEMPTS = 12
SHARES, LONG = 4, 1200
SPREAD = 4  # ranges for each shuffle partition: a range's cells are held by one task
SENTENCES = r"(?<=[.!?])\s+"

# kinds of rows in the tables below
OWN, EDITED, TO_EDITED, TO_NEXT = 0, 1, 2, 3  # cells: two fingerprints, two differences
FOUND = 2  # the digests taken out of the differences: kinds TO_EDITED + FOUND and TO_NEXT + FOUND
UNITS = 6  # the digests themselves, of the own, edited and next text
HEADER = 10  # the text's numbers: id, characters, four parts of the edited text's digest, three numbers of units


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digests(text: Column) -> Column:
    """The set of the digests of a text's units."""
    finer = [lambda u: F.split(u, SENTENCES), lambda u: F.split(u, r"\s+"), lambda u: F.regexp_extract_all(u, F.lit("(?s).{1,8}"), F.lit(0)),
             lambda u: F.regexp_extract_all(u, F.lit("(?s).{1,2}"), F.lit(0))]

    def units(found: Column, limit: Column, cuts: list[Callable[[Column], Column]]) -> Column:
        """The units found, followed by what the long ones are cut into."""
        if not cuts:
            return found
        parts = F.flatten(F.transform(F.filter(found, lambda u: F.length(u) > limit), cuts[0]))
        return F.concat(found, let(parts, lambda p: units(p, limit, cuts[1:])))

    # the limit is taken once, not for every unit: a text's length costs a pass over it
    every = let(F.least(F.lit(LONG), F.length(text) / SHARES), lambda limit: let(F.split(text, r"\n+"), lambda lines: units(lines, limit, finer)))
    return F.array_distinct(F.transform(F.filter(every, lambda u: F.trim(u) != ""), lambda u: F.xxhash64(u)))


def width_for(units: Column) -> Column:
    """Cells a row for a difference of at most so many digests: a power of two, at least twice as many."""
    least = F.greatest(2 * units, F.lit(LEAST_WIDTH))
    return F.call_function("shiftleft", F.lit(1), F.ceil(F.log2(least)).cast("int"))


def check(digest: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), digest)


def cells_of(digest: Column, width: Column, salt: int) -> list[Column]:
    """The cell of a digest in each row of a sized sketch: 21 bits of a hash for each row."""
    place = F.xxhash64(F.lit(salt + ATTEMPTS), digest)
    return [F.shiftright(place, 21 * r).bitwiseAND((width - 1).cast("long")) + width * r for r in range(SIZED_ROWS)]


def entry(kind: Column | int, width: Column, cell: Column, n: Column | int, k: Column, c: Column) -> Column:
    value = [F.lit(x) if isinstance(x, int) else x for x in (kind, n)]
    return F.struct(value[0].cast("int").alias("kind"), width.cast("int").alias("width"), cell.cast("long").alias("cell"),
                    value[1].cast("long").alias("n"), k.alias("k"), c.alias("c"))


def sized(kind: int, sign: int, digest: Column, width: Column, salt: int) -> list[Column]:
    """A digest's rows of a sized sketch."""
    return [entry(kind, width, cell, sign, digest, check(digest, salt)) for cell in cells_of(digest, width, salt)]


def fixed(kind: int, digest: Column) -> list[Column]:
    """A digest's rows of a fingerprint."""
    c = check(digest, 0)
    return [entry(kind, F.lit(WIDTH), F.shiftright(c, 3 * r).bitwiseAND(F.lit(WIDTH - 1).cast("long")) + WIDTH * r, 1, digest, c)
            for r in range(ROWS)]


def spread_out(rows: DataFrame, keys: list[str], entries: Column) -> DataFrame:
    return rows.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")


def summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells from their rows; cells of differences in which everything has cancelled are dropped."""
    cells = rows.groupBy(*keys, "kind", "width", "cell").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    empty = (F.col("n") == 0) & (F.col("k") == 0) & (F.col("c") == 0)
    return cells.where(~(F.col("kind").isin(TO_EDITED, TO_NEXT) & empty))


def peeled(cells: DataFrame, keys: list[str], salt: int, digests_kept: bool) -> DataFrame:
    """The cells after all passes: what is left of kinds TO_* did not peel; kinds TO_* + FOUND are what was taken out.

    These are one row a digest (``cell``, with its sign in ``n``), or, unless ``digests_kept``, one row a sign
    (``cell``) with their number.
    """
    kind, width, cell, n, k, c = map(F.col, ("kind", "width", "cell", "n", "k", "c"))
    for t in range(PASSES):
        row = t % SIZED_ROWS
        here = kind.isin(TO_EDITED, TO_NEXT) & (cell >= width * row) & (cell < width * (row + 1))
        pure = here & (F.abs(n) == 1) & (check(k, salt) == c)
        taken = entry(kind + FOUND, F.lit(0), k if digests_kept else n, n if digests_kept else 1, F.lit(0).cast("long"), F.lit(0).cast("long"))
        others = [entry(kind, width, at, -n, k, c) for r, at in enumerate(cells_of(k, width, salt)) if r != row]
        same = entry(kind, width, cell, n, k, c)
        cells = summed(spread_out(cells, keys, F.when(pure, F.array(taken, *others)).otherwise(F.array(same))), keys)
    return cells


def tagged(digests_: str, name: str, tag: int) -> Column:
    """An array of digests as structs with a tag before them."""
    return F.transform(digests_, lambda d: F.struct(F.lit(tag).alias(name), d.alias("d")))


def likeness(both: Column, apart: Column) -> Column:
    """Shared digests as a share of all, from the numbers of units of both texts and of differing ones: 0 to 1."""
    return F.when(both == 0, 1.0).otherwise((both - apart) / (both + apart)).cast("double")


def differences(pairs: DataFrame, attempt: int = 0) -> DataFrame:
    """(pair, mine, theirs) of rows (pair, a, b): the digests that only one of two sets has, recovered from their sketches.

    ``pair`` is unique. Those that do not peel are sketched again, twice as large each time, beginning with the size and
    salt of ``attempt``.
    """
    out, left = None, pairs.select("pair", "a", "b")
    while left is not None:
        if attempt == ATTEMPTS:
            raise ValueError(f"sketches of {ATTEMPTS} sizes did not peel")
        width = width_for((F.size("a") + F.size("b")) * (1 << attempt))
        sides = F.concat(tagged("a", "sign", 1), tagged("b", "sign", -1))
        rows = left.select("pair", width.alias("w"), F.explode(sides).alias("u")).select("pair", "w", "u.*")
        entries = F.array(*[entry(TO_EDITED, F.col("w"), cell, F.col("sign"), F.col("d"), check(F.col("d"), attempt))
                            for cell in cells_of(F.col("d"), F.col("w"), attempt)])
        cells = peeled(summed(spread_out(rows, ["pair"], entries), ["pair"]), ["pair"], attempt, True)
        found = F.col("kind") == TO_EDITED + FOUND
        told = cells.groupBy("pair").agg(
            F.collect_list(F.when(found & (F.col("n") == 1), F.col("cell"))).alias("mine"),
            F.collect_list(F.when(found & (F.col("n") == -1), F.col("cell"))).alias("theirs"),
            F.count_if(~found).alias("stuck"))
        none = F.array().cast("array<bigint>")
        whole = materialize(left.join(told, "pair", "left").select("pair", "a", "b", F.coalesce("mine", none).alias("mine"),
                                                                   F.coalesce("theirs", none).alias("theirs"), F.coalesce("stuck", F.lit(0)).alias("stuck")), "sketches")
        done = whole.where("stuck = 0").select("pair", "mine", "theirs")
        out = done if out is None else out.unionByName(done)
        left = whole.where("stuck > 0").select("pair", "a", "b")
        left, attempt = (None if left.isEmpty() else left), attempt + 1
    return out


def hexadecimal(c: Column, digits: int = 16) -> Column:
    return F.lpad(F.lower(F.hex(c)), digits, "0")


def as_text(cells: Column) -> Column:
    """A fingerprint's cells as hexadecimal text: per cell 4 digits of the count, 16 of the digests, 16 of the checks."""
    order = F.sequence(F.lit(0), F.lit(ROWS * WIDTH - 1))
    known = F.map_from_entries(F.transform(cells, lambda x: F.struct(x["cell"].cast("int"), F.concat(
        F.right(hexadecimal(x["n"]), F.lit(4)), hexadecimal(x["k"]), hexadecimal(x["c"])))))
    return F.concat_ws("", let(known, lambda m: F.transform(order, lambda i: F.coalesce(F.try_element_at(m, i), F.lit("0" * 36)))))


def with_next(docs: DataFrame) -> DataFrame:
    """(_part, _row, doc_id, text, next_text) in descending doc_id; after the last comes the first. One shuffle of texts."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    bounds = common.range_bounds(docs, "doc_id", SPREAD * common.shuffle_parts(docs)).tolist()
    # the number of bounds at or below the id, found by halving
    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(order < F.lit(bounds[middle]).cast("long"), place(low, middle)).otherwise(place(middle + 1, high))

    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), order.alias("_order"), place(0, len(bounds)).alias("_part"))
    # the first row of each range has its greatest id, and of that id the least text; one id a range is collected
    first = {r["_part"]: r["_order"] for r in texts.groupBy("_part").agg(F.max("_order").alias("_order")).collect()}
    parts = sorted(first)
    follows = {p: first[parts[k - 1]] for k, p in enumerate(parts)}  # the lowest range is followed by the highest
    targets: dict[int, list[int]] = {}
    for p, at in follows.items():
        targets.setdefault(at, []).append(p)
    heads = texts.where(F.col("_order").isin(list(targets))).groupBy("_order").agg(F.min("text").alias("text"))
    to = F.coalesce(*[F.when(F.col("_order") == F.lit(at).cast("long"), F.array(*map(F.lit, ps))) for at, ps in targets.items()]) if targets else F.array(F.lit(0))
    heads = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("_order"), F.explode(to).alias("_part"), F.lit(1).alias("_last"))
    rows = texts.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("_last", F.lit(0)).unionByName(heads)
    window = Window.partitionBy("_part").orderBy("_last", F.col("_order").desc(), "text")
    dealt = rows.repartitionById(len(bounds) + 1, F.col("_part")).withColumn("units", digests(F.col("text")))
    return (dealt.withColumn("_row", F.row_number().over(window)).withColumn("_next", F.lead(F.struct("text", "units")).over(window))
            .where(F.col("_last") == 0)
            .select("_part", "_row", "doc_id", "text", "units", F.col("_next.text").alias("next_text"), F.col("_next.units").alias("next_units")))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by the beginning of the following one."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - third), F.substr(following, F.lit(1), third))


KEYS = ["_part", "_row"]


def sketched(docs: DataFrame) -> DataFrame:
    """One row a document: its numbers, both fingerprints' cells, what peeling found, and the digests if it got stuck."""
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_units", digests(F.col("edited"))).withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256))
    sizes = [F.size(c) for c in ("units", "edited_units", "next_units")]
    numbers = [F.col("doc_id"), F.length("text").cast("long"),
               *[F.conv(F.substring("sha", 1 + 16 * i, 16), 16, -10).cast("long") for i in range(4)], *[n.cast("long") for n in sizes]]
    listed = [F.array(*[F.struct(F.lit(HEADER + i).alias("v"), x.alias("d")) for i, x in enumerate(numbers)])]
    listed += [tagged(c, "v", i) for i, c in enumerate(("units", "edited_units", "next_units"))]
    units = rows.select(*KEYS, width_for(sizes[0] + sizes[1]).alias("we"), width_for(sizes[0] + sizes[2]).alias("wn"), F.explode(F.concat(*listed)).alias("u"))
    units = units.select(*KEYS, "we", "wn", "u.v", "u.d")
    v, d, we, wn = map(F.col, ("v", "d", "we", "wn"))
    # a digest is a row of its own as well: differences that get stuck are sketched again from these
    zero, itself = F.lit(0).cast("long"), entry(v + UNITS, F.lit(0), d, 1, d, F.lit(0).cast("long"))
    entries = (F.when(v == 0, F.array(itself, *fixed(OWN, d), *sized(TO_EDITED, 1, d, we, 0), *sized(TO_NEXT, 1, d, wn, 0)))
               .when(v == 1, F.array(itself, *fixed(EDITED, d), *sized(TO_EDITED, -1, d, we, 0)))
               .when(v == 2, F.array(itself, *sized(TO_NEXT, -1, d, wn, 0)))
               .otherwise(F.array(entry(v, F.lit(0), zero, 1, d, zero))))
    cells = peeled(summed(spread_out(units, KEYS, entries), KEYS), KEYS, 0, False)
    kind, k = F.col("kind"), F.col("k")

    def number(i: int) -> Column:
        return F.max(F.when(kind == HEADER + i, k))

    def apart(of: int) -> Column:
        return F.coalesce(F.sum(F.when(kind == of + FOUND, F.col("n"))), F.lit(0))

    told = cells.groupBy(*KEYS).agg(
        *[number(i).alias(f"h{i}") for i in range(len(numbers))],
        *[F.collect_list(F.when(kind == of, F.struct("cell", "n", "k", "c"))).alias(name) for of, name in ((OWN, "cells"), (EDITED, "edited_cells"))],
        *[apart(of).alias(name) for of, name in ((TO_EDITED, "apart_edited"), (TO_NEXT, "apart_next"))],
        *[(F.count_if(kind == of) > 0).alias(name) for of, name in ((TO_EDITED, "stuck_edited"), (TO_NEXT, "stuck_next"))],
        *[F.collect_list(F.when(kind == UNITS + i, k)).alias(f"u{i}") for i in range(3)])
    stuck = F.col("stuck_edited") | F.col("stuck_next")
    return told.withColumns({f"u{i}": F.when(stuck, F.col(f"u{i}")) for i in range(3)}).withColumn("u1", F.when(F.col("stuck_edited"), F.col("u1"))).withColumn(
        "u2", F.when(F.col("stuck_next"), F.col("u2")))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness to that and to the next document."""
    rows = materialize(sketched(docs).select(
        *KEYS, F.col("h0").alias("doc_id"), F.col("h1").alias("n_chars"), F.concat(*[hexadecimal(F.col(f"h{i}")) for i in range(2, 6)]).alias("edited_sha256"),
        as_text(F.col("cells")).alias("fingerprint"), as_text(F.col("edited_cells")).alias("edited_fingerprint"),
        *[likeness(F.col("h6") + F.col(f"h{7 + i}"), F.col(name)).alias(to) for i, (name, to) in enumerate((("apart_edited", "near_edited"), ("apart_next", "near_next")))],
        "u0", "u1", "u2"), "paragraph-sketches")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    stuck = rows.where(F.col("u0").isNotNull())
    if stuck.isEmpty():
        return rows.select(*columns)
    sides = [stuck.where(F.col(u).isNotNull()).select(F.struct(*KEYS, F.lit(u).alias("side")).alias("pair"), F.col("u0").alias("a"), F.col(u).alias("b")) for u in ("u1", "u2")]
    again = differences(sides[0].unionByName(sides[1]), 1).select("pair.*", (F.size("mine") + F.size("theirs")).alias("apart"))
    again = again.groupBy(*KEYS).agg(*[F.max(F.when(F.col("side") == u, F.col("apart"))).alias(f"again_{u}") for u in ("u1", "u2")])
    mended = stuck.join(again, KEYS, "left")
    for u, to in (("u1", "near_edited"), ("u2", "near_next")):
        mended = mended.withColumn(to, F.when(F.col(u).isNotNull(), likeness(F.size("u0") + F.size(u), F.col(f"again_{u}"))).otherwise(F.col(to)))
    return rows.where(F.col("u0").isNull()).select(*columns).unionByName(mended.select(*columns))
