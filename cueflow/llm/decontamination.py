"""Benchmark decontamination by template canonicalisation, and by plain words.

Words lose their ASCII punctuation and ASCII capitals; numbers, names and units become typed
placeholders.  A template window is a run of WINDOW such words with at least LITERALS that
are no placeholders.  Copies word for word need no template: plain windows are runs of
WINDOW words as they stand, in any case, so items dense in numbers, units or capitals are
found too.  An item of fewer words is one plain window as a whole; with under LITERALS words
a run can't be told from chance, so such an item must be a document's whole text.  Documents' windows are hash-joined with the items' windows, with both positions.
Each occurrence of an item is judged on its own: hits are grouped by alignment (position in
the document minus position in the item), exactly and, for copies with words put in or left
out, in half-overlapping bins of each of BINS.  All hits of a document are a group too, for
items whose parts stand far apart.  In a group the matched windows give the part of the item
that is covered, of its template or its plain windows, and the placeholders' values: a re-parameterised question puts the same new
value wherever the item repeats one, so every value of the item must stand against one value
of the document.  A document is contaminated by an item if in one of the groups the windows
cover enough of it and the slots agree.

The items' window hashes are broadcast only if there are at most BROADCAST_WINDOWS of them;
beyond that every document window goes through a shuffle join.  Both give the same rows.

Defined results: null or blank texts and items match nothing; repeated rows and copies are
each reported (repeated doc_ids count as one document); empty tables give an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.llm import wordhash
from cueflow.llm.shared import stored

WINDOW, LITERALS = 8, 4
#: Least part of an item's windows that a document must hold, or so many of them.
COVERAGE, LONG_RUN = 0.4, 12
#: Widths of the bins of alignments.
BINS = (4, 16)
BROADCAST_WINDOWS = 1_000_000

UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l kb mb gb tb ms s sec min h hr hour hours minute minutes second seconds day days week weeks "
    "month months year years cent cents dollar dollars euro euros pound pounds meter meters metre metres kilometer kilometers kilometre "
    "kilometres mile miles gram grams kilogram kilograms liter liters litre litres percent degree degrees"
).split()

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?"]] = True
#: Keeps hashes of plain windows apart from those of templates.
_PLAIN = np.uint64(0x8EBC6AF09C88C6E3)
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x51ED270B35F1A9C3, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends, _ = wordhash.cut_words(data, np.array([0, len(data)]))
    return np.sort(wordhash.span_hashes(data, starts, ends))


_UNITS = _unit_hashes()


def template_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical word hashes, the plain ones, and the first word of each row (rows + 1 entries).

    Where both hashes of a word are equal it is no placeholder.
    """
    starts, ends, _ = wordhash.cut_words(data, offsets)
    kept = ~_PUNCTUATION[data]
    upto = np.concatenate([[0], np.cumsum(kept)])
    letters = data[kept]
    begin, stop = upto[starts], upto[ends]
    solid = stop > begin
    initial = np.ones(len(starts), bool)
    initial[1:] = _SENTENCE_END[data[ends[:-1] - 1]]
    row_starts = np.searchsorted(starts, offsets)
    initial[row_starts[:-1][row_starts[:-1] < len(starts)]] = True
    starts, begin, stop, initial = starts[solid], begin[solid], stop[solid], initial[solid]
    rows = np.searchsorted(starts, offsets)
    plain = wordhash.span_hashes(letters, begin, stop, lower=True)
    count = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[stop] - c[begin]
    digits, capitals = count(_DIGIT[letters]), count(_CAPITAL[letters])
    canonical = plain.copy()
    first = letters[begin] if len(begin) else letters[:0]
    # A capitalised word inside a sentence, but not one in capitals throughout.
    canonical[_CAPITAL[first] & ~initial & (capitals == 1) & (stop - begin > 1)] = NAME
    at = np.minimum(np.searchsorted(_UNITS, plain), len(_UNITS) - 1)
    canonical[_UNITS[at] == plain] = UNIT
    canonical[(digits > 0) & (digits == stop - begin)] = NUMBER
    return canonical, plain, rows


def _windows(keys: list[str], wanted: np.ndarray | None = None, short: list[int] | None = None):
    """Template windows (k = 0) and plain windows (of k words) of each row, under its ``keys``.

    slots: the placeholders' values of a template window, 0 for literals.  Only windows whose
    hash is ``wanted``, if given.  Items (``short`` is None) have a shorter window only if it is
    the whole text; documents have all of the lengths ``short``.
    """

    def places(window: np.ndarray, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if wanted is not None and len(window) and len(wanted):
            at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, window), len(wanted) - 1)] == window)
        else:
            at = np.arange(len(window) if wanted is None else 0)
        row = np.searchsorted(rows, at, "right") - 1
        inside = at + k <= rows[row + 1]
        return at[inside], row[inside]

    def batch_of(batch: pa.RecordBatch, rows: np.ndarray, k: int, at: np.ndarray, row: np.ndarray, window: np.ndarray, slots: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                *(batch.column(c).take(pa.array(row)) for c in keys),
                pa.array((at - rows[row]).astype(np.int32)),
                pa.array(np.full(len(at), k, np.int32)),
                pa.array(window[at].view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * slots.shape[1], pa.int32()), pa.array(slots.ravel())),
            ],
            names=[*keys, "pos", "k", "window", "slots"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in wordhash.chunks(batches):
            canonical, plain, rows = template_words(data, offsets)
            window = wordhash.shingle_hashes(canonical, WINDOW)
            at, row = places(window, WINDOW, rows)
            literal = np.concatenate([[0], np.cumsum(canonical == plain)])
            told = literal[at + WINDOW] - literal[at] >= LITERALS
            at, row = at[told], row[told]
            cells = at[:, None] + np.arange(WINDOW)
            slots = np.where(canonical[cells] == plain[cells], np.uint64(0), plain[cells]).view(np.int64)
            yield batch_of(batch, rows, 0, at, row, window, slots)
            for k in (*(range(1, WINDOW) if short is None else short), WINDOW):
                window = wordhash.shingle_hashes(plain, k) ^ _PLAIN
                at, row = places(window, k, rows)
                if k < WINDOW and (short is None or k < LITERALS):
                    alone = np.diff(rows)[row] == k
                    at, row = at[alone], row[alone]
                yield batch_of(batch, rows, k, at, row, window, np.zeros((len(at), 0), np.int64))

    return run


def _groups(shift: Column) -> Column:
    """The groups (row, width, bin) of a hit with this alignment; positions are those of one row."""
    own = lambda width, place: F.struct(F.col("row"), F.lit(width).alias("width"), place.cast("long").alias("bin"))
    binned = [own(w, 2 * F.floor((shift + half) / w) + F.lit(int(half > 0))) for w in BINS for half in (0, w // 2)]
    whole = F.struct(F.lit(0).cast("long").alias("row"), F.lit(0).alias("width"), F.lit(0).cast("long").alias("bin"))
    return F.array(whole, own(1, shift), *binned)


def template_matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (matched), item_windows, coverage, consistent, of the best group of hits."""
    columns = "pos int, k int, window long, slots array<long>"
    items = stored(benchmark.select("item_id", "text").mapInArrow(_windows(["item_id"]), f"item_id long, {columns}"), "items")
    count = lambda kind: F.countDistinct(F.when(kind, F.col("window")))
    sizes = items.groupBy("item_id").agg(count(F.col("k") == 0).alias("templates"), count(F.col("k") > 0).alias("plains"))
    distinct = items.select("window").distinct()
    wanted = None
    if distinct.count() <= BROADCAST_WINDOWS:
        wanted = np.sort(distinct.toPandas()["window"].to_numpy(np.int64).view(np.uint64))
    short = sorted(r.k for r in items.where(F.col("k").between(1, WINDOW - 1)).select("k").distinct().collect())
    source = documents.select("doc_id", "text", F.xxhash64("text").alias("row"))
    found = source.mapInArrow(_windows(["doc_id", "row"], wanted, short), f"doc_id long, row long, {columns}").drop("k")
    theirs = items.select("item_id", "window", (F.col("k") > 0).alias("plain"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    # What a hit says: its window is there, and each value of the item stands against one of the document.
    says = F.expr(
        "concat(array(struct(if(plain, 'plain', 'template') AS kind, window AS key, 0L AS value)), "
        "transform(filter(arrays_zip(item_slots, slots), p -> p.item_slots <> 0), p -> struct('slot' AS kind, p.item_slots AS key, p.slots AS value)))"
    )
    hits = found.join(theirs, "window").select("doc_id", "item_id", F.explode(_groups(F.col("pos") - F.col("item_pos"))).alias("at"), says.alias("says"))
    said = hits.select("doc_id", "item_id", "at", F.explode("says").alias("s")).groupBy("doc_id", "item_id", "at", "s.kind", "s.key")
    # Copies of a window in a group stand for the same piece of the item; a value of the item against several of the document tears it.
    judged = said.agg(F.min("s.value").alias("low"), F.max("s.value").alias("high")).groupBy("doc_id", "item_id", "at").agg(
        F.count_if(F.col("kind") == "template").alias("n_templates"), F.count_if(F.col("kind") == "plain").alias("n_plains"), F.bool_and(F.col("low") == F.col("high")).alias("consistent")
    )
    # Of the groups and the two kinds of windows the one that says most.
    part = lambda n, of: (F.coalesce(F.try_divide(n, of), F.lit(0.0)).alias("coverage"), F.col(n).alias("n_windows"), F.col(of).alias("item_windows"))
    kinds = [F.struct("consistent", _enough(*part(n, of)[:2]).alias("enough"), *part(n, of)) for n, of in (("n_templates", "templates"), ("n_plains", "plains"))]
    best = judged.join(sizes, "item_id").groupBy("doc_id", "item_id").agg(F.max(F.array_max(F.array(*kinds))).alias("best"))
    return best.select("doc_id", "item_id", "best.n_windows", "best.item_windows", "best.coverage", "best.consistent")


def _enough(coverage: Column, n_windows: Column) -> Column:
    return (coverage >= COVERAGE) | (n_windows >= LONG_RUN)


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The matches that are enough to say that the document holds the item."""
    return template_matches(documents, benchmark).where("consistent").where(_enough(F.col("coverage"), F.col("n_windows")))


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the contaminated ones."""
    bad = stored(contaminated(documents, benchmark).select("doc_id").distinct(), "leaked")
    # Rows travel whole, so that no name of theirs meets one of ours.
    rows = documents.select(F.struct("*").alias("row"))
    return rows.join(bad, F.col("row.doc_id").eqNullSafe(bad["doc_id"]), "left_anti").select("row.*")
