"""Benchmark decontamination by spaced seeds.

Words are runs of letters and digits, A-Z lower-cased, so punctuation and spacing
do not matter.  A document and a benchmark item overlap where ``SPAN`` words in a
row agree up to ``MISS`` substitutions.  Comparing all windows is out of the
question, so each window is hashed under fixed masks that ignore some positions:
the positions fall into MISS + 2 interleaved groups, and each mask keeps two
groups.  MISS substitutions touch at most MISS groups, so two groups stay whole
and the mask that keeps them gives both windows the same hash: no overlap is lost.
Test and training hashes are joined, and the words around each hit are compared.
Items shorter than ``SPAN`` words match where all their words occur in a row.

Items of equal text are one class, compared once and reported under each id.  A text's
equal windows are one, found where the first begins.

Readers drop the windows that no item has, at any size of the benchmark.  Up to ``HELD``
item windows (they are counted first) travel to them as hashes, with their words for the
join.  Of more windows a bitmap of their hashes travels, about ``BITS`` bits for each and
``MOST_BITS`` (32 MB) in all, so only what it lets through, the true hits and a share of
others that the bitmap's density tells, is shuffled by hash and joined; a passage that many
documents share is then a key that Spark splits.

Defined results: null and empty texts, and items without words, overlap with
nothing; texts are read whole; repeated rows and items with equal text are
reported under each id; items without an id are left out; an empty table on either side gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import NOT_ALNUM, Words, chunks, mix, seeded, signed
from .shared import settled, without

SPAN, MISS = 13, 2
#: The most benchmark windows (rows of a hash and ``SPAN`` words) that are sent to the readers.
HELD = 1 << 18
#: Bits of the bitmap for each window of a larger benchmark, and bits at most.
BITS, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 28

U = np.uint64


def masks(span: int, miss: int) -> list[np.ndarray]:
    """Positions that each mask keeps."""
    groups = [np.arange(g, span, miss + 2) for g in range(miss + 2)]
    return [np.sort(np.concatenate((groups[a], groups[b]))) for a, b in combinations(range(miss + 2), 2)]


_MASKS = masks(SPAN, MISS)
_FACTORS = seeded(64, 21) | U(1)
_SALTS = seeded(64, 22)


def windows(words: Words, span: int) -> np.ndarray:
    """First words of the windows that lie within a text."""
    n = len(words) - span + 1
    return np.flatnonzero(words.text[:n] == words.text[span - 1 :]) if n > 0 else np.empty(0, np.int64)


def seeds(words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(mask number, first word, hash) of all windows of ``SPAN`` words."""
    at = windows(words, SPAN)
    n = len(words) - SPAN + 1
    for m, kept in enumerate(_MASKS):
        if not len(at):
            return
        with np.errstate(over="ignore"):
            total = np.full(n, _SALTS[m])
            for p in kept.tolist():
                total += words.hash[p : p + n] * _FACTORS[p]
        yield m, at, mix(total)[at]


def whole(words: Words, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the windows of a shorter span, all words kept."""
    at = windows(words, span)
    with np.errstate(over="ignore"):
        total = np.full(len(at), _SALTS[20 + span])
        for p in range(span):
            total += words.hash[at + p] * _FACTORS[p]
    return at, mix(total)


def _once(words: Words, at: np.ndarray, h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of each text's windows with the same words and the same hash."""
    with np.errstate(over="ignore"):
        full = np.full(len(at), _SALTS[0])
        for p in range(span):
            full += words.hash[at + p] * _FACTORS[p]
    order = np.lexsort((at, full, h, words.text[at]))
    names = np.stack((words.text[at].astype(U), h, full))[:, order]
    first = np.ones(len(at), bool)
    first[1:] = (names[:, 1:] != names[:, :-1]).any(0)
    return at[order[first]], h[order[first]]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch):
            words = chunk.words(lower=True, breaks=NOT_ALNUM)
            count = np.diff(words.first)
            found = [(at, h, SPAN) for _, at, h in seeds(words)]
            for span in np.unique(count[(count > 0) & (count < SPAN)]).tolist():
                at, h = whole(words, span)
                own = count[words.text[at]] == span
                found.append((at[own], h[own], span))
            for at, h, span in found:
                table = words.hash[at[:, None] + np.arange(span)].reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[chunk.rows.start : chunk.rows.stop].take(pa.array(words.text[at])),
                        pa.array(signed(h)),
                        pa.array((at - words.first[words.text[at]]).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * span), pa.array(signed(table))),
                    ],
                    ["item", "hash", "item_at", "item_words"],
                )


class Exactly:
    """Tells which hashes are among those held."""

    def __init__(self, held: np.ndarray):
        self.held = held
        self.gate = np.zeros(1 << 20, bool)
        self.gate[held >> U(44)] = True

    def passing(self, h: np.ndarray) -> np.ndarray:
        may = np.flatnonzero(self.gate[h >> U(44)])
        return may[self.held[np.minimum(np.searchsorted(self.held, h[may]), len(self.held) - 1)] == h[may]]


class Bitmap:
    """Tells which hashes may be among the item windows': all that are, and few others."""

    def __init__(self, tests: DataFrame, windows: int):
        bits = LEAST_BITS
        while bits < min(MOST_BITS, BITS * windows):
            bits *= 2
        slot = F.shiftrightunsigned("hash", 64 - bits.bit_length() + 1)
        rows = tests.select(F.shiftright(slot, 6).alias("word"), F.expr("1L").alias("one"), slot.alias("slot"))
        rows = rows.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, cast(slot & 63 as int))")).alias("held")).toPandas()  # MOST_BITS / 64 rows at most
        self.shift = U(64 - bits.bit_length() + 1)
        self.words = np.zeros(bits // 64, U)
        self.words[rows["word"].to_numpy(np.int64)] = rows["held"].to_numpy(np.int64).view(U)

    def passing(self, h: np.ndarray) -> np.ndarray:
        slot = h >> self.shift
        return np.flatnonzero((self.words[slot >> U(6)] >> (slot & U(63))) & U(1))


def _hits(spans: list[int], gate: Exactly | Bitmap):
    """Windows of the documents that pass the gate, with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                words = chunk.words(lower=True, breaks=NOT_ALNUM)
                short = ((at, h, s) for s in spans for at, h in [whole(words, s)])
                for at, h, span in (*((at, h, SPAN) for _, at, h in seeds(words)), *short):
                    passed = gate.passing(h)
                    at, h = at[passed], h[passed]
                    if not len(at):
                        continue
                    at, h = _once(words, at, h, span)
                    table = words.hash[at[:, None] + np.arange(span)].reshape(-1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0)[chunk.rows.start : chunk.rows.stop].take(pa.array(words.text[at])),
                            pa.array(signed(h)),
                            pa.array((at - words.first[words.text[at]]).astype(np.int32)),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * span), pa.array(signed(table))),
                        ],
                        ["id", "hash", "at", "words"],
                    )

    return run


def document_windows(docs: DataFrame, spans: list[int], gate: Exactly | Bitmap) -> DataFrame:
    """(id, hash, at, words) of the windows of ``docs`` (id, text) that pass."""
    rows = docs.select("id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_hits(spans, gate), f"id {rows.schema['id'].dataType.simpleString()}, hash long, at int, words array<long>")


def overlaps(docs: DataFrame, items: DataFrame, held: int = HELD) -> DataFrame:
    """``docs`` (id, text) against ``items`` (item, text): a row for each pair that overlaps.

    id, item, n_windows (distinct windows of the item that occur), first_word (where the first begins in the
    document), least_misses.
    """
    item = items.schema["item"].dataType.simpleString()
    given = items.select("item", F.col("text").cast("string").alias("text")).where("item is not null and text is not null")
    own = given.groupBy("text").agg(F.min("item").alias("item"))
    members = given.join(own.withColumnRenamed("item", "rep"), "text").select("rep", "item").distinct()
    tests = own.select("item", "text").mapInArrow(_items, f"item {item}, hash long, item_at int, item_words array<long>")
    sizes = tests.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.size("item_words")).alias("spans")).first()
    spans = sorted(s for s in sizes.spans if s < SPAN)
    few = sizes.n <= held
    if few:
        found = tests.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64)
        gate = Exactly(np.sort(found.view(U)) if len(found) else np.zeros(1, U))
    else:
        tests = settled(tests)
        gate = Bitmap(tests, sizes.n)
    mine = document_windows(docs, spans, gate)
    tests = F.broadcast(tests) if few else tests  # `held` rows at most
    pairs = mine.join(tests, "hash").where(F.size("words") == F.size("item_words"))
    misses = F.aggregate(
        F.zip_with("words", "item_words", lambda x, y: (x != y).cast("int")), F.lit(0), lambda a, b: a + b
    )
    pairs = pairs.withColumn("misses", misses).where(F.col("misses") <= F.when(F.size("words") < SPAN, 0).otherwise(MISS))
    found = pairs.groupBy("id", F.col("item").alias("rep")).agg(
        F.count_distinct("item_at").alias("n_windows"),
        F.min("at").cast("long").alias("first_word"),
        F.min("misses").alias("least_misses"),
    )
    return found.join(members, "rep").select("id", "item", "n_windows", "first_word", "least_misses")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that overlap with an item; the columns stay.  ``items`` is (item, text).

    Rows of one id go together.
    """
    found = overlaps(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), items)
    return without(docs, id_col, settled(found.select(F.col("id").alias(id_col)).distinct()))
