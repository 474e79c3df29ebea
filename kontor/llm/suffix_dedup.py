"""Byte-substring deduplication with a sparse, distributed suffix array.

A text is its UTF-8 bytes.  A byte goes when some string of ``width`` bytes that
covers it also starts in a document with a smaller id; strings are judged on the
input, overlaps count, and matches never cross documents.

A suffix array over every byte would be many times the input.  But a string of
``width`` bytes holds ``width - lead + 1`` leads of ``lead`` bytes, and the one with
the least hash is a choice that the bytes alone make.  Only suffixes that begin at
such anchors (about one byte in thirteen) are looked at, each with the bytes
before it, so a repeated string shows up as two suffixes that agree to the right and
left of a shared anchor.

1. Equal texts are one class; all but the least id go whole.
2. Texts are laid out in parts of about ``PART`` bytes by a hash of the id.  Each part sends the
   hashes of its anchors' leads, four bytes each, to ranges of the hash space; a range answers
   each part with one bit for each hash: whether more than one document holds it.  No filter is
   broadcast, so nothing grows with the input but the number of parts and ranges.
3. Splitters are sampled from the leading bytes of anchors, and the suffixes of shared leads are
   dealt by range of their leading bytes.  A bucket sorts its suffixes by multikey quicksort
   and compares neighbours: rows that agree on ``width - l`` bytes from the anchor and on ``l``
   bytes before it hold the same string, for each l.  The least id among them decides.
4. A range boundary never cuts between suffixes with one lead, unless the sample shows that a
   lead alone would overfill a bucket.  Such a lead is dealt over several buckets, and they
   are compared across their boundaries: each names its strings' first documents by a 128-bit
   hash, and the first of all decides.

Defined results: a null text has no bytes; texts shorter than ``width`` keep all;
repeated rows with one id are one document, of different texts under one id the least one
is judged; a row without an id keeps all and takes from no other; ids are whole numbers
(others are a TypeError); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import BYTES, ROLLERS, Chunk, anchors, chunks, covered, given_back, mix, seeded, signed
from .shared import settled, without

WIDTH = 50
#: Bytes of text of a part, and of text whose leads meet in one range of hashes.
PART, RANGE = 4 << 20, 12 << 20
#: Anchors that a bucket should hold, documents that are looked at for the splitters, leads taken for each bucket (about),
#: and how many buckets' anchors one lead must have to be split.
BUCKET, SAMPLE, LEADS, FULL = 120_000, 3000, 16, 4
#: Buckets at most: the splitters go to every reader.
BUCKETS = 1 << 18
#: Bytes of text that are scanned together (a longer text in pieces), suffixes that are compared together, and sorted at once.
SCAN, ROWS, SMALL = 1 << 18, 1 << 15, 1 << 12

U = np.uint64
_LEFT = seeded(256 * 256, 31).reshape(256, 256)
_FACTORS = seeded(512, 32).reshape(2, 256) | U(1)


class Scan:
    """The anchors of a chunk: places, texts and hashes of their leads.  A long chunk is looked at piece by piece."""

    def __init__(self, chunk: Chunk, width: int):
        lead, n = width // 2, len(chunk.data)
        places, keys = [np.empty(0, np.int64)], [np.empty(0, U)]
        for low in range(0, n, SCAN):
            begin, end = max(0, low - width), min(n, low + SCAN + 2 * width)
            mark = np.zeros(end - begin, np.int32)  # a text's number, counted from the first of the piece
            inside = chunk.offsets[(chunk.offsets > begin) & (chunk.offsets < end)]
            np.add.at(mark, inside - begin, 1)
            text = np.cumsum(mark, dtype=np.int32)
            m = end - begin - width + 1
            usable = text[:m] == text[width - 1 :] if m > 0 else np.zeros(0, bool)
            hashes = ROLLERS[0].windows(BYTES[0][chunk.data[begin:end]], lead)
            at = np.flatnonzero(anchors(hashes, width - lead + 1, usable))
            at = at[(at >= low - begin) & (at < low - begin + SCAN)]
            places.append(at + begin)
            keys.append(hashes[at])
        self.at, self.key = np.concatenate(places), np.concatenate(keys)
        self.text = np.searchsorted(chunk.offsets, self.at, "right") - 1


def documents_of(table: pa.Table) -> pa.Table:
    """The rows of a part, one for each id: the one with the least text."""
    ids = table.column("id").to_numpy()
    if len(np.unique(ids)) == len(ids):
        return table
    table = table.sort_by([("id", "ascending"), ("text", "ascending")])
    ids = table.column("id").to_numpy()
    return table.filter(pa.array(np.concatenate(([True], ids[1:] != ids[:-1]))))


def scanned(table: pa.Table, width: int) -> Iterator[tuple[pa.RecordBatch, Chunk, Scan]]:
    for batch in table.to_batches():
        for chunk in chunks(batch, limit=SCAN):
            yield batch, chunk, Scan(chunk, width)


def _place(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Range of the hash space, and what tells hashes within it apart."""
    return (((keys >> U(32)) * U(ranges)) >> U(32)).astype(np.int64), keys.astype(np.uint32)


def part_keys(table: pa.Table, width: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct leads of a part, by range and then by hash, and which of them more than one of its documents holds."""
    keys, several = [np.empty(0, U)], [np.empty(0, bool)]
    for _, _, scan in scanned(table, width):
        order = np.lexsort((scan.text, scan.key))
        key, text = scan.key[order], scan.text[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        last = np.append(first[1:], len(key))[: len(first)] - 1
        keys.append(key[first])
        several.append(text[first] != text[last])
    keys, several = np.concatenate(keys), np.concatenate(several)
    keys, inverse, number = np.unique(keys, return_inverse=True, return_counts=True)
    return keys, (np.bincount(inverse, several, len(keys)) > 0) | (number > 1)


def _keys(width: int, ranges: int):
    """A part's leads for each range of hashes."""

    def run(table: pa.Table) -> pa.Table:
        table = documents_of(table)
        keys, several = part_keys(table, width, ranges)
        place, low = _place(keys, ranges)
        some, first = np.unique(place, return_index=True)
        cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True)) if len(some) else []
        part = table.column("part")[0].as_py()
        return pa.table(
            {
                "range": pa.array(some, pa.int32()),
                "part": pa.array(np.full(len(some), part), pa.int32()),
                "keys": pa.array([low[a:b].tobytes() for a, b in cuts], pa.binary()),
                "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in cuts], pa.binary()),
            }
        )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """A range of hashes: for each part, which of its leads more than one document holds."""
    blobs = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    sizes = [len(x) for x in blobs]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("several").to_pylist(), sizes, strict=True)]
    _, inverse, number = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
    shared = ((number > 1) | (np.bincount(inverse, np.concatenate(several), len(number)) > 0))[inverse]
    ends = np.cumsum(sizes)
    masks = [shared[b - n : b] for b, n in zip(ends, sizes, strict=True)]
    some = pa.array([bool(m.any()) for m in masks])
    answer = pa.table(
        {
            "part": table.column("part").combine_chunks(),
            "range": table.column("range").combine_chunks(),
            "mask": pa.array([np.packbits(m).tobytes() for m in masks], pa.binary()),
        }
    )
    given_back()
    return answer.filter(some)


def shared_leads(table: pa.Table, masks: pa.Table, width: int, ranges: int) -> np.ndarray:
    """The part's leads that more than one document of the corpus holds, sorted."""
    keys, _ = part_keys(table, width, ranges)
    place, _ = _place(keys, ranges)
    keep = np.zeros(len(keys), bool)
    for r, mask in zip(masks.column("range").to_pylist(), masks.column("mask").to_pylist(), strict=True):
        a, b = np.searchsorted(place, (r, r + 1))
        keep[a:b] = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a) == 1
    return keys[keep]


def around(chunk: Chunk, at: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes from ``width - lead`` before each anchor to ``width`` after it, zeros beyond the text; how many are real on each side."""
    before = width - width // 2
    left = np.minimum(at - chunk.offsets[text], before)
    right = np.minimum(chunk.offsets[text + 1] - at, width)
    place = at[:, None] + np.arange(-before, width)
    table = chunk.data[np.clip(place, 0, len(chunk.data) - 1)]
    steps = np.arange(-before, width)
    table[(steps < -left[:, None]) | (steps >= right[:, None])] = 0
    return table, left, right


def _leads(width: int):
    """Leading bytes of the suffixes at all anchors, for the splitters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, chunk, scan in scanned(pa.Table.from_batches([batch]), width):
                table = chunk.data[scan.at[:, None] + np.arange(width // 2)] if len(scan.at) else np.empty((0, width // 2), np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in table], pa.binary())], ["lead"])

    return run


class Splitters:
    """Bounds of the ranges of leading bytes; leads that alone overfill a bucket have some buckets of their own."""

    def __init__(self, leads: list[bytes], buckets: int, width: int):
        self.lead = width // 2
        names, counts = np.unique(np.array(leads, f"S{self.lead}"), return_counts=True)
        share = max(1.0, len(leads) / buckets)  # sampled leads of a bucket
        heavy = counts >= max(FULL * share, LEADS)
        self.heavy = names[heavy]
        self.pieces = np.ceil(counts[heavy] / share).astype(np.int64)
        rest = np.repeat(names[~heavy], counts[~heavy])
        own = max(1, round(len(rest) / share))
        self.cuts = np.unique(rest[[i * len(rest) // own for i in range(1, own)]]) if own > 1 else rest[:0]
        self.first = len(self.cuts) + 1 + np.concatenate(([0], np.cumsum(self.pieces)))

    def buckets(self, leads: np.ndarray, part: int) -> np.ndarray:
        out = np.searchsorted(self.cuts, leads, "right")
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, leads), len(self.heavy) - 1)
            out = np.where(self.heavy[at] == leads, self.first[at] + part % self.pieces[at], out)
        return out

    def split(self, bucket: int) -> bool:
        """Whether the bucket holds a piece of a lead that is dealt over several."""
        return bucket > len(self.cuts)


#: What a suffix takes with it: type and values for each.
_PACKED = {"ids": (np.int64, 1), "at": (np.int32, 1), "sides": (np.uint8, 2)}


def _deal(width: int, ranges: int, splitters):
    """A part's suffixes with shared leads and their surroundings, packed by bucket of their leading bytes."""

    def run(table: pa.Table, masks: pa.Table) -> pa.Table:
        pack, own = pa.Codec("zstd", 1), splitters.value
        table = documents_of(table)
        found: dict[str, list[np.ndarray]] = {name: [] for name in (*_PACKED, "bytes")}
        wanted = shared_leads(table, masks, width, ranges) if masks.num_rows and table.num_rows else np.empty(0, U)
        for batch, chunk, scan in scanned(table, width) if len(wanted) else ():
            hit = wanted[np.minimum(np.searchsorted(wanted, scan.key), len(wanted) - 1)] == scan.key
            at, text = scan.at[hit], scan.text[hit]
            if not len(at):
                continue
            around_, left, right = around(chunk, at, text, width)
            ids = batch.column("id")[chunk.rows.start : chunk.rows.stop].to_numpy(zero_copy_only=False).astype(np.int64)
            for name, values in zip(found, (ids[text], (at - chunk.offsets[text]).astype(np.int32), np.stack((left, right), 1).astype(np.uint8), around_), strict=True):
                found[name].append(values)
        if not found["ids"]:
            return pa.table({"bucket": pa.array([], pa.int32()), "n": pa.array([], pa.int32()), **{n: pa.array([], pa.binary()) for n in found}})
        columns = {name: np.concatenate(values) for name, values in found.items()}
        begin = width - width // 2
        leads = np.ascontiguousarray(columns["bytes"][:, begin : begin + own.lead]).view(f"S{own.lead}").reshape(-1)
        bucket = own.buckets(leads, table.column("part")[0].as_py())
        order = np.lexsort((leads, bucket))  # suffixes with one lead become neighbours, which packs them well
        names, first = np.unique(bucket[order], return_index=True)
        parts = np.split(order, first[1:])
        blobs = {n: pa.array([pack.compress(x[p].tobytes(), asbytes=True) for p in parts], pa.binary()) for n, x in columns.items()}
        sizes = pa.array([len(p) for p in parts], pa.int32())
        return pa.table({"bucket": pa.array(names, pa.int32()), "n": sizes, **blobs})

    return run


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of rows by their words: three ways around a pivot of one word, and on to the next word where it is equal."""
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        a, b, d = todo.pop()
        if b - a < 2 or d == words.shape[1]:
            continue
        own = order[a:b].copy()
        if b - a <= SMALL:
            order[a:b] = own[np.lexsort(words[own, d:].T[::-1])]
            continue
        key = words[own, d]
        few = np.sort(key[:: max(1, len(key) // 31)])
        pivot = few[len(few) // 2]
        less, more = own[key < pivot], own[key > pivot]
        order[a : a + len(less)], order[b - len(more) : b] = less, more
        order[a + len(less) : b - len(more)] = own[key == pivot]
        todo += [(a, a + len(less), d), (a + len(less), b - len(more), d + 1), (b - len(more), b, d)]
    return order


def compare(ids: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """For each suffix a bit mask: bit l is set if the string that starts l bytes before the anchor has a smaller id elsewhere."""
    before = table.shape[1] - width
    padded = np.zeros((len(ids), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = table[:, before:]
    order = multikey_quicksort(padded.view(">u8").astype(U))
    out = np.zeros(len(ids), np.int64)
    # some leads at a time: no string reaches from one into another
    lead = padded[order, : width // 2]
    starts = np.flatnonzero(np.concatenate(([True], (lead[1:] != lead[:-1]).any(1)))) if len(order) else np.empty(0, np.int64)
    while len(starts):
        later = np.searchsorted(starts, starts[0] + ROWS)
        stop = starts[later] if later < len(starts) else len(order)
        rows = order[starts[0] : stop]
        out[rows] = _compared(ids[rows], table[rows], left[rows], right[rows], width)
        starts = starts[later:]
    return out


def _compared(ids: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """``compare`` over rows that are sorted from the anchor on."""
    before = table.shape[1] - width
    differ = table[1:, before:] != table[:-1, before:]
    same = np.where(differ.any(1), differ.argmax(1), width)
    behind = np.zeros(len(ids), U)
    masks = np.zeros(len(ids), np.int64)
    for l in range(before + 1):
        if l:
            behind = mix(behind ^ _LEFT[l][table[:, before - l]])
        group = np.concatenate(([0], np.cumsum(same < width - l)))
        fit = (left >= l) & (right >= width - l)
        fit &= np.bincount(group[fit], minlength=group[-1] + 1)[group] > 1
        rows = np.flatnonzero(fit)
        if not len(rows):
            continue
        with np.errstate(over="ignore"):
            key = mix(behind[rows] + group[rows].astype(U) * U(0x9E3779B97F4A7C15))
        by = np.argsort(key)
        begin = np.flatnonzero(np.concatenate(([True], np.diff(key[by]) != 0)))
        least = np.minimum.reduceat(ids[rows[by]], begin)
        later = np.repeat(least, np.diff(np.append(begin, len(by)))) < ids[rows[by]]
        masks[rows[by[later]]] |= 1 << l
    return masks


def _first(ids: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, masks: np.ndarray, width: int) -> Iterator[tuple]:
    """(row numbers, l, hashes) of the strings whose first document a bucket holds, as far as it can tell."""
    before = table.shape[1] - width
    for l in range(before + 1):
        rows = np.flatnonzero((left >= l) & (right >= width - l) & (masks >> l & 1 == 0))
        for some in np.split(rows, range(ROWS, len(rows), ROWS)):
            with np.errstate(over="ignore"):
                strings = table[some, before - l : before - l + width]
                yield some, l, [signed(mix((BYTES[k][strings] * _FACTORS[k, :width]).sum(1, dtype=U))) for k in (0, 1)]


_HITS = pa.schema([("id", pa.int64()), ("at", pa.int32()), ("mask", pa.int64()), ("hash_a", pa.int64()), ("hash_b", pa.int64())])


def _bucket(width: int, splitters):
    """Strings of a bucket that start in a smaller document, and, of pieces of a lead, those whose first document it holds with their hashes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        pack = pa.Codec("zstd", 1)
        sizes = table.column("n").to_pylist()

        def column(name: str, kind: type, each: int) -> np.ndarray:
            size = np.dtype(kind).itemsize * each
            parts = [pack.decompress(x, decompressed_size=n * size) for x, n in zip(table.column(name).to_pylist(), sizes, strict=True)]
            return np.concatenate([np.frombuffer(x, kind) for x in parts])

        ids, at, sides = (column(name, *kind) for name, kind in _PACKED.items())
        own = column("bytes", np.uint8, 2 * width - width // 2).reshape(len(ids), -1)
        left, right = sides.reshape(-1, 2).astype(np.int64).T
        masks = compare(ids, own, left, right, width)
        hit = masks != 0
        out = [pa.table([pa.array(x) for x in (ids[hit], at[hit], masks[hit])] + [pa.nulls(hit.sum(), pa.int64())] * 2, schema=_HITS)]
        if splitters.value.split(key[0].as_py()):
            for rows, l, (a, b) in _first(ids, own, left, right, masks, width):
                out.append(pa.table([pa.array(x) for x in (ids[rows], at[rows], np.full(len(rows), 1 << l), a, b)], schema=_HITS))
        given_back()
        return pa.concat_tables(out)

    return run


def _remove(width: int):
    """A part's texts and their (id, at, mask) to what is left."""

    def run(table: pa.Table, hits: pa.Table) -> pa.Table:
        ids, cut, runs, left = [], [], [], []
        if table.num_rows and hits.num_rows:
            place = [hits.column(n).to_numpy() for n in ("id", "at", "mask")]
            table = documents_of(table)
            order = np.argsort(place[0], kind="stable")
            own, at, mask = (x[order] for x in place)
            for batch in table.to_batches():
                for chunk in chunks(batch, limit=SCAN):
                    names = batch.column("id")[chunk.rows.start : chunk.rows.stop].to_numpy(zero_copy_only=False).astype(np.int64)
                    low, high = np.searchsorted(own, names), np.searchsorted(own, names, "right")
                    for i in np.flatnonzero(low < high):
                        a, b = chunk.offsets[i], chunk.offsets[i + 1]
                        where, bits = at[low[i] : high[i]].astype(np.int64), mask[low[i] : high[i]]
                        starts = np.concatenate([where[bits >> l & 1 == 1] - l for l in range(width - width // 2 + 1)])
                        gone = covered(starts, width, b - a)
                        ids.append(names[i])
                        cut.append(int(gone.sum()))
                        runs.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()))
                        left.append(chunk.data[a:b][~gone].tobytes())
        return pa.table({"id": pa.array(ids, pa.int64()), "cut": pa.array(cut, pa.int64()), "runs": pa.array(runs, pa.int64()), "kept": pa.array(left, pa.binary())})

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept (bytes left where some went, else null), kept_sha256."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a whole number, not {docs.schema[id_col].dataType.simpleString()}")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = settled(base.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    long = rows.where((F.col("n_bytes") >= width) & F.col("id").isNotNull())
    classes = settled(long.groupBy("sha").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last"))
    copies = settled(long.join(classes, "sha").where("id > rep").select("id").distinct())
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()

    texts = without(base.where((F.octet_length("text") >= width) & F.col("id").isNotNull()), "id", copies)
    share = min(1.0, SAMPLE / max(1, total.n))
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    buckets = min(BUCKETS, max(16, 2 * total.bytes // (width // 2 + 2) // BUCKET))
    # about LEADS for each bucket, however much text there is: that share of the sampled anchors is drawn
    expected = max(1, int(share * 2 * total.bytes / (width // 2 + 2)))
    drawn = min(1.0, max(4096, LEADS * buckets) / expected)
    sampled = some.mapInArrow(_leads(width), "lead binary").where(F.rand(1) < drawn).collect()
    found = Splitters(sorted(bytes(r.lead) for r in sampled), buckets, width)
    splitters = spark.sparkContext.broadcast(found)

    # a part meets its texts three times: for the leads, for the suffixes, for what is removed; Spark deals the texts out once
    parts, ranges = max(1, total.bytes // PART), max(4, total.bytes // RANGE)
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
    laid = texts.select(part, "id", "text").repartition("part")
    keys = laid.groupBy("part").applyInArrow(_keys(width, ranges), "range int, part int, keys binary, several binary")
    masks = keys.groupBy("range").applyInArrow(_answer, "part int, range int, mask binary")
    dealt = laid.groupBy("part").cogroup(masks.groupBy("part")).applyInArrow(
        _deal(width, ranges, splitters), "bucket int, n int, ids binary, at binary, sides binary, bytes binary"
    )
    hits = dealt.groupBy("bucket").applyInArrow(_bucket(width, splitters), "id long, at int, mask long, hash_a long, hash_b long")
    if len(found.heavy):
        hits = settled(hits)
        named = hits.where("hash_a is not null")
        least = named.groupBy("hash_a", "hash_b").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
        late = named.join(least, ["hash_a", "hash_b"]).where("id > low").select("id", "at", "mask")
        hits = hits.where("hash_a is null").select("id", "at", "mask").union(late)
    hits = hits.select(part, "id", "at", "mask")
    removed = laid.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(_remove(width), "id long, cut long, runs long, kept binary")

    # digested before the join, so that a caller who drops the bytes does not have them shuffled
    removed = removed.withColumn("left_sha", F.sha2("kept", 256))
    named = rows.join(classes.select("sha", "rep"), "sha", "left").join(removed, "id", "left")
    copy = F.col("rep").isNotNull() & (F.col("rep") < F.col("id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return named.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, nothing).when(F.col("cut") > 0, F.col("left_sha")).otherwise(F.col("sha")).alias("kept_sha256"),
    )
