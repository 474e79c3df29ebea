"""Hard negatives by Kronecker-packed products.

The score of a row for an anchor is the exact integer inner product of their vectors,
whose components are ``floor(256 x)``.  All rows take part for each anchor, in blocks:
anchors are cut into blocks of about ``ANCHORS``, rows into blocks of about ``ROWS``
(more where there are few, so that all cores have work), and each pair of blocks is a
cell that Spark shuffles together and one task multiplies.

Within a cell the components are biased to be non-negative and several rows' components
are packed into separated fields of one wide integer; the fields are as wide as the
largest possible sum, so nothing carries over.  An anchor's component multiplies each
wide integer once, and shifts and masks unpack the exact scores of all rows in it.

Two passes: the first finds an anchor's positives, its best rows of the same label; the
second the best rows of other labels whose score lies in a positive's window.  A cell
hands on at most as many rows as the whole answer has, and a ranked window takes the
best of them.

Defined results: rows without an id, a label or a vector, and rows with a null or
non-finite component, take no part; scores exist only between vectors of one length,
which may be 0; identical rows are rows of their own; of several anchor rows with one id
the least by label and vector is the anchor, and no row with its id is a partner;
components and scores beyond 64 bits are held at their bounds (such scores tie); an
anchor without a positive, or a positive without a negative, has no row; ids and labels
may be of any type that can be ordered; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import settled

#: Anchors and rows of a cell, about; cells at least for each core; scores held at a time.
ANCHORS, ROWS, SPREAD, HELD = 2048, 32768, 4, 1 << 19
WIDE = 62  # bits of a packed integer that can be used
LEAST, MOST = -(2**63), 2**63 - 1


def quantised(values: np.ndarray) -> np.ndarray:
    """``floor(256 x)`` as int64, or as Python integers where that is too narrow to calculate with."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * 256)
    if not scaled.size or np.abs(scaled).max() < 2.0**WIDE:
        return scaled.astype(np.int64)
    return np.array([min(max(int(min(max(x, -1e19), 1e19)), LEAST), MOST) for x in scaled.ravel().tolist()], object).reshape(scaled.shape)


def products(anchors: np.ndarray, rows: np.ndarray, held: int = HELD) -> Iterator[np.ndarray]:
    """Inner products (anchor, row) of whole numbers, for some anchors after others; several rows share a multiplication."""
    d = anchors.shape[1]
    if not d or not len(anchors) or not len(rows):
        yield np.zeros((len(anchors), len(rows)), np.int64)
        return
    low_a, low_r = int(anchors.min()), int(rows.min())
    top_a, top_r = int(anchors.max()), int(rows.max())
    width = max(1, (d * (top_a - low_a) * (top_r - low_r)).bit_length())
    whole = d * max(abs(low_a), abs(top_a)) * max(abs(low_r), abs(top_r)) * 4 < 2**WIDE
    kind = np.int64 if whole and width <= WIDE else object
    biased_a, biased_r = anchors.astype(kind) - low_a, rows.astype(kind) - low_r
    fields = max(1, WIDE // width)
    m = -(-len(rows) // fields)
    packed = np.zeros((d, m), kind)
    for f in range(fields):
        part = biased_r[f * m : (f + 1) * m].T
        packed[:, : part.shape[1]] += part * (1 << (f * width))
    mask, of_rows = (1 << width) - 1, low_a * biased_r.sum(1) + d * low_a * low_r
    step = max(1, held // len(rows))
    for i in range(0, len(anchors), step):
        some = biased_a[i : i + step]
        total = np.zeros((len(some), m), kind)
        for k in range(d):
            total += some[:, k, None] * packed[k]
        out = np.concatenate([(total >> (f * width)) & mask for f in range(fields)], 1)[:, : len(rows)]
        out += low_r * some.sum(1)[:, None] + of_rows
        yield out if kind is np.int64 else np.clip(out, LEAST, MOST)


class Ranked:
    """The usable columns of a row of scores by rising score, equal scores by falling column; columns stand in the order of ids."""

    def __init__(self, scores: np.ndarray, usable: np.ndarray):
        columns = np.flatnonzero(usable)
        own, n = scores[columns], len(scores)
        shift = n.bit_length()
        base = int(own.min()) if len(own) else 0
        if len(own) and (int(own.max()) - base).bit_length() + shift <= WIDE and own.dtype != object:
            key = np.sort(((own - base) << shift) | (n - 1 - columns))  # one sort of plain numbers
            self.columns, self.scores = n - 1 - (key & ((1 << shift) - 1)), (key >> shift) + base
        else:
            order = sorted(range(len(own)), key=lambda i: (own[i], -i))
            self.columns, self.scores = columns[order], own[order]

    def best(self, most: int, low: int = LEAST, high: int = MOST) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of the ``most`` highest within the bounds, highest first."""
        a, b = (np.searchsorted(self.scores, min(max(x, LEAST), MOST), side) for x, side in ((low, "left"), (high, "right")))
        a = max(a, b - most)
        return self.columns[a:b][::-1], self.scores[a:b][::-1]


def _matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length of the vectors -> (numbers of the rows that have it, their components)."""
    column = table["vector"].combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    out = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        out[d] = at, quantised(flat[(ends[at] - d)[:, None] + np.arange(d)])
    return out


def _numbers(values: pa.ChunkedArray, of: pa.ChunkedArray) -> np.ndarray:
    """Where each value stands in ``of``; -1 for none."""
    found = pc.index_in(values, value_set=of.combine_chunks())
    return pc.fill_null(found, -1).to_numpy().astype(np.int64)


def _cell(wanted, out: pa.Schema):
    """A cell: for each anchor, what ``wanted`` takes of the scores of all its rows."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray, dict]] = []
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by("id")
            kinds = anchors["label"].combine_chunks().unique()
            label_a, label_r = (_numbers(t["label"], pa.chunked_array([kinds])) for t in (anchors, rows))
            own = _numbers(rows["id"], anchors["id"])
            mine = _matrices(anchors)
            for d, (at_r, of_rows) in _matrices(rows).items():
                at_a, of_anchors = mine.get(d, (np.empty(0, np.int64), None))
                for some, others in wanted.parts(at_a, at_r, label_a, label_r):
                    columns, lines = at_r[others], (line for strip in products(of_anchors[some], of_rows[others]) for line in strip)
                    for a, line in zip(at_a[some].tolist(), lines, strict=True):
                        usable = (own[columns] != a) & ((label_r[columns] == label_a[a]) == wanted.same)
                        found += ((a, columns[at], score, more) for at, score, more in wanted.take(Ranked(line, usable), anchors, a))
        which = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
        other = np.concatenate([f[1] for f in found]).astype(np.int64) if found else np.empty(0, np.int64)
        score = [int(s) for f in found for s in f[2]]
        columns = {"anchor_id": anchors["id"].take(pa.array(which)), "other_id": rows["id"].take(pa.array(other)), "other_score": pa.array(score, pa.int64())}
        for name in out.names[3:]:
            columns[name] = pa.array([f[3][name] for f in found for _ in f[1]], out.field(name).type)
        return pa.table(columns).cast(out) if which.size else out.empty_table()

    return run


class Positives:
    """The best rows of the anchor's label."""

    same = True

    def __init__(self, most: int):
        self.most = most

    def parts(self, at_a, at_r, label_a, label_r):
        """Only rows of one label meet."""
        of_a, of_r = label_a[at_a], label_r[at_r]
        order = np.argsort(of_r, kind="stable")
        for kind in np.unique(of_a).tolist():
            a, b = np.searchsorted(of_r[order], [kind, kind + 1])
            if b > a:
                yield np.flatnonzero(of_a == kind), order[a:b]

    def take(self, ranked: Ranked, anchors: pa.Table, a: int):
        yield (*ranked.best(self.most), {})


class Negatives:
    """For each positive the best rows of other labels between two shares of its score, in per cent."""

    same = False

    def __init__(self, most: int, low: int, high: int):
        self.most, self.low, self.high = most, low, high

    def parts(self, at_a, at_r, label_a, label_r):
        if len(at_a) and len(at_r):
            yield np.arange(len(at_a)), np.arange(len(at_r))

    def take(self, ranked: Ranked, anchors: pa.Table, a: int):
        for position, score in enumerate(anchors["scores"][a].as_py()):
            yield (*ranked.best(self.most, -(-self.low * score // 100), self.high * score // 100), {"position": position})


def _best(df: DataFrame, by: list[str], most: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("other_score"), "other_id")
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchors_held: int = ANCHORS, rows_held: int = ROWS
) -> DataFrame:
    """``vectors`` is (id, label, vector, anchor boolean): anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where("id is not null and label is not null and vector is not null").where(finite)
    rows = settled(rows.select("id", "label", "vector", "anchor", F.monotonically_increasing_id().alias("number")))
    anchors = rows.where("anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a")).first()
    across = max(1, -(-sizes.a // anchors_held))
    least = rows.sparkSession.sparkContext.defaultParallelism * SPREAD // across
    down = max(1, -(-sizes.n // rows_held), min(sizes.n // 256, least))
    name = rows.schema["id"].dataType.simpleString()

    def cells(own: DataFrame, wanted, extra: str = "") -> DataFrame:
        mine = own.withColumnsRenamed({c: f"{c}_" for c in own.columns}).withColumnsRenamed({f"{c}_": c for c in own.columns})  # columns of its own
        mine = mine.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(across).cast("long"))).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
        theirs = rows.select("number", *(F.col(c).alias(c) for c in ("id", "label", "vector"))).withColumn("r", F.col("number") % F.lit(down).cast("long")).drop("number")
        theirs = theirs.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
        schema = f"anchor_id {name}, other_id {name}, other_score long{extra}"
        run = _cell(wanted, to_arrow_schema(StructType.fromDDL(schema)))
        return mine.groupBy("a", "r").cogroup(theirs.groupBy("a", "r")).applyInArrow(run, schema)

    found = settled(_best(cells(anchors, Positives(positives)), ["anchor_id"], positives, "position").withColumn("position", F.col("position") - 1))
    lists = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("position", "other_score"))).alias("s"))  # `positives` of each at most
    ready = anchors.join(lists.select(F.col("anchor_id").alias("id"), F.col("s.other_score").alias("scores")), "id")
    mined = _best(cells(ready, Negatives(negatives, low, high), ", position int"), ["anchor_id", "position"], negatives, "rank")
    named = found.select("anchor_id", "position", F.col("other_id").alias("positive_id"), F.col("other_score").alias("positive_score"))
    out = mined.withColumnsRenamed({"other_id": "negative_id", "other_score": "negative_score"}).join(named, ["anchor_id", "position"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
