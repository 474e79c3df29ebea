"""Near-duplicate groups by one-permutation MinHash, banded buckets and star-shaped candidate edges.

A document is the set of its distinct five-word shingles (words ``[^\\x20\\x09-\\x0D]+``
after lower-casing A-Z; with fewer words, the whole sequence is one shingle; without
words the set is empty and linked with nothing).  Two documents are linked when
100 * intersection >= 75 * union; the classes are the connected components.

1. One pass over the text gives each row its number of shingles, a 128-bit digest
   of the set, and ``BANDS`` keys.  The signature is one permutation's minimum in
   each of ``BANDS * ROWS`` bins; empty bins are filled by optimal densification.
   A pair at the threshold shares no key with probability (1 - 0.75**4)**48, about
   1e-8.
2. Rows with the same set are one class; from here on its least id stands for it,
   however many copies there are.
3. Buckets with one member go.  In each other bucket every member gets one edge,
   to a centre: a star, so edges grow with the rows and not with their squares.
   Edges are confirmed on the full sets, and confirmed ones merge components.
4. A star can miss a link between two of its arms.  So the centre is the most typical
   member of its bucket (fewest shingles that no other candidate has), members with too
   many such shingles are dropped as they can be linked with nothing, and buckets that
   still hold more than one component get further stars around their next typical
   members, up to ``STARS`` rounds or until a round finds nothing.
5. What then shares a bucket across components is joined exactly, see ``rest``: no pair is
   left without a comparison of its sets or a proof that it cannot be linked.

Texts travel by id to where an edge needs them; nothing is collected to the driver,
and no group of rows meets in one task: sums are combined before the shuffle and
joins on keys are split by Spark where a key is frequent.

Defined results: repeated rows with one id and one text are one document, reported
once per row; of different texts under one id the least one is compared; null texts are empty; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import ROLLERS, Chunk, chunks, lists, mix, seeded, signed
from .shared import components, let_go, settled, sieve, without

SHINGLE = 5
BANDS, ROWS = 48, 4
BINS = BANDS * ROWS
#: A link needs PART * intersection >= WHOLE * union.
PART, WHOLE = 100, 75

U = np.uint64
_TARGETS = (mix(seeded(512 * BINS, 7)) % U(BINS)).astype(np.int64).reshape(512, BINS)
_WEIGHTS = seeded(ROWS, 8) | U(1)
_BAND = seeded(BANDS, 9)


def shingles(chunk: Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and offsets."""
    words = chunk.words(lower=True)
    count = np.diff(words.first)
    hashes = ROLLERS[0].windows(words.hash, size)
    inside = words.text[: len(hashes)] == words.text[size - 1 :] if len(hashes) else np.zeros(0, bool)
    text = words.text[: len(hashes)][inside]
    hashes = hashes[inside]
    short = np.flatnonzero((count > 0) & (count < size))
    whole = ROLLERS[1].slices(words.hash, words.first[short], words.first[short + 1])
    text, hashes = np.concatenate((text, short)), np.concatenate((hashes, whole))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    text, hashes = text[new], hashes[new]
    return hashes, np.searchsorted(text, np.arange(len(chunk) + 1))


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Least hash in each bin, empty bins densified; rows of empty sets are 0."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    cell = text * BINS + (((hashes >> U(40)) * U(BINS)) >> U(24)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]  # bins follow the order of the hashes
    table = np.zeros(n * BINS, U)
    table[cell[first]] = hashes[first]
    full = np.zeros(n * BINS, bool)
    full[cell[first]] = True
    rows = np.repeat(np.diff(offsets) > 0, BINS)
    empty = np.flatnonzero(~full & rows)
    row, bin_ = empty // BINS * BINS, empty % BINS
    for targets in _TARGETS:  # each empty bin asks other bins in an order of its own
        if not len(empty):
            break
        source = row + targets[bin_]
        hit = full[source]
        table[empty[hit]] = table[source[hit]]
        empty, row, bin_ = empty[~hit], row[~hit], bin_[~hit]
    for e, r in zip(empty.tolist(), row.tolist(), strict=True):  # practically never
        table[e] = table[r + int(np.flatnonzero(full[r : r + BINS])[0])]
    return table.reshape(n, BINS)


def band_keys(table: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((table.reshape(len(table), BANDS, ROWS) * _WEIGHTS).sum(2, dtype=U) + _BAND)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch):
            hashes, offsets = shingles(chunk)
            size = np.diff(offsets)
            keys = band_keys(signatures(hashes, offsets)).reshape(-1)
            full = size > 0
            bounds = np.concatenate(([0], np.cumsum(full * BANDS)))
            with np.errstate(over="ignore"):
                sums = [np.concatenate(([U(0)], np.cumsum(mix(hashes ^ s)))) for s in seeded(2, 10)]
                digest = [signed(s[offsets[1:]] - s[offsets[:-1]]) for s in sums]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[chunk.rows.start : chunk.rows.stop],
                    pa.array(size.astype(np.int64)),
                    pa.array(digest[0]),
                    pa.array(digest[1]),
                    lists(signed(keys[np.repeat(full, BANDS)]), bounds),
                ],
                ["id", "size", "set_a", "set_b", "keys"],
            )


def sketch(docs: DataFrame) -> DataFrame:
    """(id, text) to (id, size, set_a, set_b, keys)."""
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_sketch, f"id {kind}, size long, set_a long, set_b long, keys array<long>")


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch):
            hashes, offsets = shingles(chunk)
            ids = batch.column(0)[chunk.rows.start : chunk.rows.stop].take(pa.array(np.repeat(np.arange(len(chunk)), np.diff(offsets))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(signed(hashes))], ["id", "hash"])


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text, other) to the pairs whose full sets are similar enough; the sets of some pairs at a time are in memory."""
    for batch in batches:
        linked = np.zeros(batch.num_rows, bool)
        for left in chunks(batch):
            x, first = shingles(left)
            for right in chunks(batch.slice(left.rows.start, len(left)), "other"):
                y, second = shingles(right)
                for k, i in enumerate(range(right.rows.start, right.rows.stop)):
                    a, b = x[first[i] : first[i + 1]], y[second[k] : second[k + 1]]
                    common = _shared(a, b)
                    linked[left.rows.start + i] = common > 0 and PART * common >= WHOLE * (len(a) + len(b) - common)
        keep = pa.array(linked)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that the full sets confirm; ``texts`` is (id, text)."""
    left = texts.select(F.col("id").alias("a"), "text")
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("other"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text", "other")
    kind = pairs.schema["a"].dataType.simpleString()
    return rows.mapInArrow(_confirm, f"a {kind}, b {kind}")


#: Rounds of stars at most; each takes another centre in the buckets that still hold more than one component.
STARS = 2
#: Members and hashes of a block at most (on average); two blocks meet in one task's memory.
BLOCK, WEIGHT = 512, 1 << 18
#: Columns of a block's matrix that are multiplied at once, and pairs up to which sets are merged one by one.
WIDTH, FEW = 4096, 32


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, component) to (id, component, size, hash), a row for each shingle."""
    for batch in batches:
        for chunk in chunks(batch):
            hashes, offsets = shingles(chunk)
            size = np.diff(offsets)
            at = pa.array(np.repeat(np.arange(len(chunk)), size))
            part = batch.slice(chunk.rows.start, len(chunk))
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(at), part.column("component").take(at), pa.array(np.repeat(size, size)), pa.array(signed(hashes))],
                ["id", "component", "size", "hash"],
            )


def _counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets on two sides, as a product of 0-1 matrices over the hashes that both sides hold."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    cells = []
    for sets in (left, right):
        values = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        held = both[at] == values if len(both) else np.zeros(len(values), bool)
        order = np.argsort(at[held], kind="stable")
        cells.append((row[held][order], at[held][order]))
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(both), WIDTH):
        a, b = (np.zeros((len(x), min(WIDTH, len(both) - low)), np.float32) for x in (left, right))
        for matrix, (row, at) in zip((a, b), cells, strict=True):
            own = slice(*np.searchsorted(at, (low, low + WIDTH)))
            matrix[row[own], at[own] - low] = 1
        out += a @ b.T
    return out


def _meet(rows: pa.RecordBatch | pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """The links (a, b) within each group of rows; a group is one block, or two that are compared with each other."""
    rows = rows.combine_chunks().to_batches()[0] if isinstance(rows, pa.Table) else rows
    own = rows.column("component").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    size, side = rows.column("size").to_numpy(), rows.column("side").to_numpy()
    sets = rows.column("hashes")
    values, first = sets.values.to_numpy(), sets.offsets.to_numpy()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if stop - start < 2 or (own[start:stop] == own[start]).all():
            continue
        here = side[start:stop] == side[start]
        x = start + np.flatnonzero(here)
        alike = here.all()
        y = x if alike else start + np.flatnonzero(~here)
        small, large = np.minimum(size[x][:, None], size[y]), np.maximum(size[x][:, None], size[y])
        test = (own[x][:, None] != own[y]) & (PART * small >= WHOLE * large)
        if alike:
            test = np.triu(test, 1)
        i, j = np.nonzero(test)
        if not len(i):
            continue
        if len(i) <= FEW:
            common = np.array([_shared(*(values[first[k] : first[k + 1]] for k in (x[a], y[b]))) for a, b in zip(i, j, strict=True)])
        else:
            common = _counts(*([values[first[k] : first[k + 1]] for k in side_] for side_ in (x, y)))[i, j].astype(np.int64)
        hit = PART * common >= WHOLE * (size[x[i]] + size[y[j]] - common)
        found.append((x[i[hit]], y[j[hit]]))
    a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
    return pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(a)), rows.column("id").take(pa.array(b))], ["a", "b"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_meet`` over rows sorted by (family, i, j); a group may go on in the next batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([*held, batch])
        names = np.stack([rows.column(c).to_numpy() for c in ("family", "i", "j")])
        starts = np.concatenate(([0], np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1))
        if len(starts) > 1:
            yield _meet(rows.slice(0, starts[-1]), starts)
        last = rows.slice(starts[-1])
        held = last.to_batches() if isinstance(last, pa.Table) else [last]
    if held is not None:
        rows = pa.Table.from_batches(held)
        yield _meet(rows, np.array([0, rows.num_rows]))


def rest(members: DataFrame, texts: DataFrame) -> DataFrame:
    """All links (a, b) between different components of ``members`` (id, component); ``texts`` is (id, text).

    A link shares at least WHOLE / PART of either set.  Only hashes that more than one
    component holds can be shared across; members with too few of those go.  In one order
    of the hashes, rare ones first, the first shared hash of a link lies so early in both
    sets that enough others can follow; so members meet by the hashes of that prefix.

    The hashes of one passage have the same members, who should meet once and not once for
    each.  So hashes are gathered in families: a member's least prefix hash is its own, and
    a hash's family is the least of its members' own.  Who shares a hash shares its family.
    A large family is split into blocks of members that carry their sets, and the blocks of
    its most frequent component are not compared with each other; two blocks at a time are
    held in memory, and only links come out.
    """
    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.join(members, "id").select("id", "text", "component")
    rows = settled(rows.mapInArrow(_spread, f"id {kind}, component {kind}, size long, hash long"))
    least = F.expr(f"({WHOLE} * size + {PART - 1}) div {PART}")
    across = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    sets = (
        rows.join(across.where("low < high").select("hash", "n"), "hash")
        .groupBy("id", "component", "size")
        .agg(F.array_sort(F.collect_list(F.struct("n", "hash"))).alias("shared"))
        .where(F.size("shared") >= least)
    )
    prefix = F.slice("shared.hash", F.lit(1), (F.size("shared") - least + 1).cast("int"))
    sets = settled(sets.select("id", "component", "size", prefix.alias("prefix"), F.array_sort("shared.hash").alias("hashes")))
    del rows, across  # the largest step: a row for each shingle
    let_go(texts.sparkSession)
    entries = sets.select("id", "component", F.size("hashes").alias("weight"), F.array_min("prefix").alias("own"), F.explode("prefix").alias("hash"))
    family = entries.groupBy("hash").agg(F.min("own").alias("family"), F.min("component").alias("low"), F.max("component").alias("high"))
    placed = settled(entries.join(family.where("low < high").select("hash", "family"), "hash").select("id", "component", "weight", "family").distinct())
    split = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / WEIGHT))
    top, tops = F.col("top.component"), split(F.col("top.n"), F.col("top.w"))
    others = split(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w"))
    single = split(F.col("n"), F.col("w")) == 1
    groups = (
        placed.groupBy("family", "component")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
        .groupBy("family")
        .agg(F.max(F.struct("n", "w", "component")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("k"))
        .where("k > 1")
        # a small family is one block without a most frequent component
        .select("family", F.when(~single, top).alias("top"), F.when(single, 0).otherwise(tops).alias("tops"), F.when(single, 1).otherwise(others).alias("others"))
    )
    # blocks of the other components are 0 to others - 1, those of the most frequent one follow
    mine = F.col("component").eqNullSafe(F.col("top"))
    side = F.when(mine, F.col("others") + F.pmod(F.xxhash64("id"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("id"), F.col("others")))
    other = F.when(mine, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("tops") - 1))
    dealt = placed.join(groups, "family").select("id", "family", side.alias("side"), F.explode(other).alias("other"))
    dealt = dealt.select("id", "family", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    dealt = dealt.join(sets.select("id", "component", "size", "hashes"), "id")
    dealt = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return dealt.mapInArrow(_met, f"a {kind}, b {kind}").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stars: int = STARS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = settled(sketch(base))
    classes = settled(
        rows.where("size > 0")
        .groupBy("set_a", "set_b")
        .agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    )
    entries = classes.select(F.col("rep").alias("id"), "size", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    entries = settled(entries.join(shared, "key"))
    ids = settled(entries.select("id").distinct())
    texts = settled(sieve(base, "id", ids).join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))

    # shingles that one candidate has alone: they bound its similarity to any other, and tell how typical it is
    kind = base.schema["id"].dataType.simpleString()
    alone = (
        texts.mapInArrow(_explode, f"id {kind}, hash long")
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
        .where("n = 1")
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("alone"))
    )
    entries = entries.join(alone, "id", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    entries = entries.where(F.lit(PART) * (F.col("size") - F.col("alone")) >= F.lit(WHOLE) * F.col("size"))
    entries = settled(entries.select("key", "id", "size", (F.col("alone") / F.col("size")).alias("odd")))
    del alone, shared, ids
    let_go(base.sparkSession)

    links = tested = centres = labels = None
    for _ in range(stars):
        now = entries.withColumn("component", F.col("id"))
        if labels is not None:
            of = labels.withColumnRenamed("component", "own")
            now = entries.join(of, "id", "left").withColumn("component", F.coalesce("own", "id")).drop("own")
        free = now if centres is None else now.join(centres, ["key", "id"], "left_anti")
        best = free.groupBy("key").agg(F.min(F.struct("odd", "id", "component", "size")).alias("best"))
        mixed = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        best = settled(best.join(mixed.select("key"), "key").select("key", "best.id", "best.component", "best.size"))
        star = best.select("key", F.col("id").alias("centre"), F.col("component").alias("of"), F.col("size").alias("width"))
        edges = now.join(star, "key").where(
            (F.col("component") != F.col("of"))
            & (F.lit(PART) * F.least("size", "width") >= F.lit(WHOLE) * F.greatest("size", "width"))
        )
        edges = edges.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
        if tested is not None:
            edges = edges.join(tested, ["a", "b"], "left_anti")
        edges = settled(edges)
        found = settled(confirm(edges, texts))
        links = found if links is None else links.union(found)
        if not found.isEmpty():
            labels = components(links)
        elif labels is not None or edges.isEmpty():
            break
        tested = edges if tested is None else tested.union(edges)
        chosen = best.select("key", "id")
        centres = chosen if centres is None else centres.union(chosen)
        del now, free, best, mixed, star, edges, found
        let_go(base.sparkSession)

    now = entries.withColumn("component", F.col("id"))
    if labels is not None:
        now = entries.join(labels.withColumnRenamed("component", "own"), "id", "left").withColumn("component", F.coalesce("own", "id"))
    mixed = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    members = settled(now.join(mixed.select("key"), "key").select("id", "component").distinct())
    del now, mixed, entries
    let_go(base.sparkSession)
    if not members.isEmpty():
        found = settled(rest(members, texts))
        if not found.isEmpty():
            labels = components(found if links is None else links.union(found))

    named = rows.select("id", "size", "set_a", "set_b").join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"], "left")
    named = named.withColumn("rep", F.coalesce("rep", "id"))
    if labels is not None:
        named = named.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("rep", F.coalesce("component", "rep"))
    return named.select(
        F.col("id").alias(id_col),
        F.col("size").alias("n_shingles"),
        F.col("rep").alias("component_id"),
        F.col("id").eqNullSafe(F.col("rep")).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the least id; the columns stay."""
    gone = near_dedup(docs, id_col, text_col).where(~F.col("kept")).select(id_col).distinct()
    return without(docs, id_col, settled(gone))
