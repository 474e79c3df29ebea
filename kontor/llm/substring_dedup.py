"""Substring deduplication by level-wise doubling.

A window is ``window`` consecutive words (``[^\\x20\\x09-\\x0D]+``, unchanged) of one
document.  A word goes when some window that covers it also starts in a document
with a smaller id; windows are judged on the input.

Long windows are rare to repeat, and a window can only repeat if its parts do.  So
lengths double, from the shortest of at least ``START`` words up to ``window`` (12, 25 and 50):

1. Level one takes windows of the shortest length.  Not all of them: of those inside each
   full window only the one with the least hash is an anchor, which is a choice the words
   alone make, so equal windows have equal anchors.  About one word in twelve is an anchor.
2. What is found in one document only dies.  The survivors alone are extended to twice
   their length: full windows around a surviving anchor choose their anchors of that length
   among themselves, and so on until the length is ``window``; these are hashed with 128 bits.
3. Full windows found in one document only die; what survives has its first
   document, and the words it covers elsewhere go.  Longer repeats consist of
   repeated windows of this length, so the doubling ends here, or as soon as no candidate survives.

Documents with the same words are one class first: all but the least id go whole
(if they have a window) and take no part in the levels.  A window that a third of
the documents share is one row for each in a partial aggregate and in a join that
Spark splits; it is never a group in one task.

Defined results: a null text has no words; texts shorter than a window keep all;
repeated rows with one id are one document, of different texts under one id the least
one is searched; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import ROLLERS, anchors, chunks, covered, joined, lists, signed, sliding
from .shared import settled, sieve

WINDOW, START = 50, 12
NOTHING = hashlib.sha256(b"").hexdigest()

U = np.uint64


def levels(window: int, start: int = START) -> list[int]:
    """Lengths of the levels: each is half of the next, the first has ``start`` words or more."""
    out = [window]
    while out[0] // 2 >= max(1, start):
        out.insert(0, out[0] // 2)
    return out


def inside(words, window: int) -> np.ndarray:
    """Which full windows lie within a text."""
    n = len(words) - window + 1
    return words.text[:n] == words.text[window - 1 :] if n > 0 else np.zeros(0, bool)


def chosen(words, window: int, length: int, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a length in the usable full windows, by text, and where those of each text begin."""
    hashes = ROLLERS[0].windows(words.hash, length)
    at = np.flatnonzero(anchors(hashes, window - length + 1, usable))
    pairs = np.stack((words.text[at].astype(U), hashes[at]), 1)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(1)
    pairs = pairs[new]
    return pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(words.chunk) + 1, dtype=U))


def alive(words, window: int, length: int, keys: pa.Array, row: int) -> np.ndarray:
    """Which full windows have their anchor of a length among their text's keys; the texts are the rows from ``row`` on."""
    usable = inside(words, window)
    if not usable.any():
        return usable
    least = sliding(ROLLERS[0].windows(words.hash, length), window - length + 1, np.minimum)
    own = np.zeros(len(usable), bool)
    for i in range(len(words.chunk)):
        a, b = words.first[i], min(words.first[i + 1], len(usable))
        own[a:b] = np.isin(least[a:b], keys[row + i].values.to_numpy().view(U))
    return own & usable


def _first_level(window: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                words = chunk.words()
                keys, first = chosen(words, window, length, inside(words, window))
                whole = [r.slices(words.hash, words.first[:-1], words.first[1:]) for r in ROLLERS]
                texts = joined(words, np.ones(len(words), bool))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[chunk.rows.start : chunk.rows.stop],
                        pa.array(np.diff(words.first).astype(np.int64)),
                        pa.array(signed(whole[0])),
                        pa.array(signed(whole[1])),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                        lists(signed(keys), first),
                    ],
                    ["id", "n_words", "seq_a", "seq_b", "sha", "keys"],
                )

    return run


def _next_level(window: int, before: int, length: int):
    """(id, text, keys) to the anchors of the next length in the full windows whose anchor survived."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                words = chunk.words()
                keys, first = chosen(words, window, length, alive(words, window, before, batch.column(2), chunk.rows.start))
                yield pa.RecordBatch.from_arrays([batch.column(0)[chunk.rows.start : chunk.rows.stop], lists(signed(keys), first)], ["id", "keys"])

    return run


def _last_level(window: int, before: int):
    """(id, text, keys) to the distinct full windows whose anchor is among the text's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                words = chunk.words()
                at = np.flatnonzero(alive(words, window, before, batch.column(2), chunk.rows.start))
                if not len(at):
                    continue
                full = [r.windows(words.hash, window)[at] for r in ROLLERS]
                table = np.unique(np.stack((words.text[at].astype(U), *full), 1), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[chunk.rows.start : chunk.rows.stop].take(pa.array(table[:, 0].astype(np.int64))),
                        pa.array(signed(table[:, 1])),
                        pa.array(signed(table[:, 2])),
                    ],
                    ["id", "hash_a", "hash_b"],
                )

    return run


def _remove(window: int):
    """(id, text, keys) to what is left when the windows among the text's keys go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2)
            for chunk in chunks(batch):
                words = chunk.words()
                usable = inside(words, window)
                full = ROLLERS[0].windows(words.hash, window)
                own = np.zeros(len(usable), bool)
                for i in range(len(chunk)):
                    a, b = words.first[i], min(words.first[i + 1], len(usable))
                    own[a:b] = np.isin(full[a:b], keys[chunk.rows.start + i].values.to_numpy().view(U))
                gone = covered(np.flatnonzero(own & usable), window, len(words))
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[chunk.rows.start : chunk.rows.stop],
                        pa.array(removed.astype(np.int64)),
                        pa.array([t.decode("utf-8", "replace") for t in joined(words, ~gone)]),
                    ],
                    ["id", "n_removed", "kept"],
                )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, start: int = START) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept (the words left where some went, else null), kept_sha256."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    length, *longer = levels(window, start)
    rows = settled(base.mapInArrow(_first_level(window, length), f"id {kind}, n_words long, seq_a long, seq_b long, sha string, keys array<long>"))
    sequence = ["n_words", "seq_a", "seq_b"]
    classes = settled(
        rows.where((F.col("n_words") >= window) & F.col("id").isNotNull())
        .groupBy(*sequence)
        .agg(F.min("id").alias("rep"), F.first("keys").alias("keys"))
    )

    def survivors(found: DataFrame) -> DataFrame:
        """(id, keys) without the keys of one document only."""
        keys = found.select("id", F.explode("keys").alias("key"))
        shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
        return settled(keys.join(shared, "key").groupBy("id").agg(F.collect_set("key").alias("keys")))

    def texts(wanted: DataFrame) -> DataFrame:
        own = sieve(base, "id", wanted.select("id")).groupBy("id").agg(F.min("text").alias("text"))
        return own.join(wanted, "id").select("id", "text", "keys")

    found = survivors(classes.select(F.col("rep").alias("id"), "keys"))
    for now in longer[:-1]:
        if found.isEmpty():
            break
        found = survivors(texts(found).mapInArrow(_next_level(window, length, now), f"id {kind}, keys array<long>"))
        length = now
    full = settled(texts(found).mapInArrow(_last_level(window, length), f"id {kind}, hash_a long, hash_b long"))
    pair = ["hash_a", "hash_b"]
    shared = full.groupBy(*pair).agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    later = full.join(shared.select(*pair, "low"), pair).where("id > low")
    later = settled(later.groupBy("id").agg(F.collect_set("hash_a").alias("keys")))
    removed = texts(later).mapInArrow(_remove(window), f"id {kind}, n_removed long, kept string")
    removed = removed.withColumnRenamed("n_removed", "cut")

    named = rows.drop("keys").join(classes.select(*sequence, "rep"), sequence, "left")
    copy = F.col("rep").isNotNull() & (F.col("rep") != F.col("id"))
    named = named.join(removed, "id", "left")
    return named.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, F.lit(NOTHING)).when(F.col("cut") > 0, F.sha2("kept", 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
