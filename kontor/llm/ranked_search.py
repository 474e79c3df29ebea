"""Ranked lexical search over impact vectors, in buckets of falling norm.

A document's impact for a term is ``(1000000000 tf) div (1000 tf + 20 m)`` with m from its
length; a query's weights come from the terms' document frequencies.  The score of a
document is the inner product of both, in 64-bit integers, and each query wants its
``top`` best documents.  Few of them can matter, and norms tell which:

1. documents become impact vectors over the terms that some query has (counts and
   statistics are over all terms of all documents), and are ordered by the lengths of these
   vectors: buckets are classes of a length, eight to each doubling, and a bucket with many
   terms is cut into pieces, so one task holds a bounded part of it;
2. the buckets with the longest vectors, ``SEEDS`` documents or more, are searched first;
   what is then the last of a query's best is a floor for its score;
3. a bucket whose greatest length times the query's is below the floor (Cauchy-Schwarz)
   cannot reach it and is pruned: buckets that are pruned for a whole block of queries are
   not even shuffled;
4. within a bucket the same test cuts off the shorter vectors, and a bound by coordinates
   filters the others: the exact sum over the query's ``FOCUS`` heaviest terms, plus the
   Cauchy-Schwarz bound of what is left of both vectors;
5. survivors are scored exactly, and raise the floor for the rest of the bucket.

Queries are dealt with in blocks of about ``ITEMS``; each block meets each live piece of a
bucket once.  Terms are known by 64-bit hashes.  Up to ``VOCABULARY`` different query
terms (32 MB of hashes) are sent to the readers, so that other terms are only counted;
with more, documents are vectors over all their terms, which is no more than their text.

Defined results: a null or empty text has no term, is no document and asks for nothing;
rows of a query's id are one query with the terms of all of them; documents that repeat an
id count and rank as rows of their own; queries without an id are left out, documents
without an id count in the statistics and are not ranked; scores are above 0; other
columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .flat import NOT_ALNUM, chunks, lists, signed
from .shared import settled

#: Best documents of a query; queries of a block; terms of a piece of a bucket; documents that are searched first.
TOP, ITEMS, PIECE, SEEDS = 50, 512, 1 << 20, 8192
#: Terms that the coordinate bound takes exactly; documents of a strip; query terms that are sent to the readers.
FOCUS, STRIP, VOCABULARY = 8, 8192, 1 << 22
STEPS = 8  # classes of length to each doubling
SLACK = 1 + 1e-9  # bounds are in doubles, of sums far below 2**53

U = np.uint64


def _vectors(vocabulary: np.ndarray | None):
    """id, n (terms with repeats), and the different terms with their counts; texts without a term have no row.

    With a ``vocabulary`` (sorted hashes) only its terms are listed, by their numbers in it.
    """
    if vocabulary is not None:
        gate = np.zeros(1 << 20, bool)
        gate[vocabulary >> U(44)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                words = chunk.words(lower=True, breaks=NOT_ALNUM)
                text, term = words.text, words.hash
                if vocabulary is not None:
                    may = np.flatnonzero(gate[term >> U(44)])
                    at = np.searchsorted(vocabulary, term[may])
                    hit = vocabulary[np.minimum(at, len(vocabulary) - 1)] == term[may]
                    text, term = text[may[hit]], at[hit].astype(np.int32)
                else:
                    term = signed(term)
                order = np.lexsort((term, text))
                text, term = text[order], term[order]
                first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (term[1:] != term[:-1])))[: len(text)])
                counts = np.diff(np.concatenate((first, [len(text)]))).astype(np.int32)
                ends = np.searchsorted(text[first], np.arange(len(chunk) + 1))
                n = np.diff(words.first)
                some = pa.array(np.flatnonzero(n > 0))
                ids = batch.column(0)[chunk.rows.start : chunk.rows.stop]
                columns = [ids, pa.array(n.astype(np.int64)), lists(term[first], ends), lists(counts, ends)]
                yield pa.RecordBatch.from_arrays([c.take(some) for c in columns], ["id", "n", "terms", "tfs"])

    return run


def vectors(rows: DataFrame, vocabulary: np.ndarray | None) -> DataFrame:
    """``rows`` is (id, text)."""
    kind, term = rows.schema["id"].dataType.simpleString(), "long" if vocabulary is None else "int"
    return rows.mapInArrow(_vectors(vocabulary), f"id {kind}, n long, terms array<{term}>, tfs array<int>")


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Impact of each term with its document's length beside it, for that many documents and terms in all."""
    m = 50 + (50 * n * documents) // total
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m)


def _sized(documents: int, total: int):
    """Counts become impacts; ``class`` says how long the vector is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, tfs = batch.column(2), batch.column(3)
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(tfs).to_numpy())))
            imp = impacts(tfs.flatten().to_numpy(), np.repeat(batch.column(1).to_numpy(), np.diff(ends)), documents, total)
            square = np.concatenate(([0.0], np.cumsum(imp.astype(np.float64) ** 2)))
            norm = np.sqrt(np.maximum(np.diff(square[ends]), 0))
            some = np.flatnonzero(np.add.reduceat(np.concatenate((imp, [0])), np.minimum(ends[:-1], len(imp))) * (np.diff(ends) > 0) > 0)
            kind = np.floor(STEPS * np.log2(np.maximum(norm, 1))).astype(np.int32)
            columns = [batch.column(0), batch.column(4), pa.array(kind), pa.array(np.diff(ends).astype(np.int32)), terms, lists(imp.astype(np.int32), ends)]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(some)) for c in columns], ["id", "number", "class", "size", "terms", "imps"])

    return run


def longest(kind: int) -> float:
    """No vector of the class is longer."""
    return 2 ** ((kind + 1) / STEPS) * SLACK


class Bucket:
    """A piece of a bucket: documents by falling length, with the inverted lists of its strips."""

    def __init__(self, docs: pa.Table, vocabulary: np.ndarray):
        terms, imps = (docs[c].combine_chunks() for c in ("terms", "imps"))
        size = pc.list_value_length(terms).to_numpy()
        text, term, imp = np.repeat(np.arange(len(size)), size), terms.flatten().to_numpy(), imps.flatten().to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
        asked = vocabulary[at] == term  # by this block of queries
        text, self.term, self.imp = text[asked], at[asked], imp[asked]
        norm = np.sqrt(np.bincount(text, self.imp.astype(np.float64) ** 2, len(size)))
        self.order = np.argsort(-norm, kind="stable")
        self.norm = norm[self.order]
        place = np.empty_like(self.order)
        place[self.order] = np.arange(len(place))
        self.place = place[text]

    def strips(self):
        """(documents, their norms, inverted lists: term -> slice of documents and impacts)."""
        order = np.lexsort((self.place, self.term, self.place // STRIP))
        place, term, imp = self.place[order], self.term[order], self.imp[order]
        for a in range(0, len(self.norm), STRIP):
            i, j = np.searchsorted(place // STRIP, [a // STRIP, a // STRIP + 1])
            names, first = np.unique(term[i:j], return_index=True)
            ends = np.append(first, j - i)
            yield self.order[a : a + STRIP], self.norm[a : a + STRIP], place[i:j] - a, imp[i:j], dict(zip(names.tolist(), zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), strict=True))


class Query:
    """Terms by falling weight, and the best documents so far."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, floor: int, top: int):
        order = np.argsort(-weights, kind="stable")
        self.terms, self.weights = terms[order].tolist(), weights[order].tolist()
        squares = weights[order].astype(np.float64) ** 2
        self.norm, self.rest = math.sqrt(squares.sum()), math.sqrt(squares[FOCUS:].sum())
        self.floor, self.top = floor, top
        self.docs = self.scores = np.empty(0, np.int64)

    def search(self, documents, norm, place, imp, where, rank) -> bool:
        """Look at a strip; False if it is too short for the query, as all after it are."""
        reach = int(np.searchsorted(-norm * SLACK * self.norm, -max(self.floor, 1), "right"))  # Cauchy-Schwarz
        if not reach:
            return False
        spans = [(w, *where[t]) for t, w in zip(self.terms[:FOCUS], self.weights[:FOCUS], strict=True) if t in where]
        score, seen = np.zeros(len(norm), np.int64), np.zeros(len(norm))
        for w, a, b in spans:
            score[place[a:b]] += w * imp[a:b]
            seen[place[a:b]] += imp[a:b].astype(np.float64) ** 2
        left = np.sqrt(np.maximum(norm[:reach] ** 2 * SLACK - seen[:reach], 0))
        bound = (score[:reach] + self.rest * left) * SLACK + 1e-6
        alive = np.zeros(len(norm), bool)
        alive[:reach] = bound >= max(self.floor, 1)  # coordinates
        if alive.any():
            for t, w in zip(self.terms[FOCUS:], self.weights[FOCUS:], strict=True):
                if t in where:
                    a, b = where[t]
                    hit = alive[place[a:b]]
                    score[place[a:b][hit]] += w * imp[a:b][hit]
            found = np.flatnonzero(alive & (score >= max(self.floor, 1)))
            docs, scores = np.append(self.docs, documents[found]), np.append(self.scores, score[found])
            best = np.lexsort((rank[docs], -scores))[: self.top]
            self.docs, self.scores = docs[best], scores[best]
            if len(best) == self.top:
                self.floor = max(self.floor, int(self.scores[-1]))
        return True


def _cell(top: int, out: pa.Schema):
    def run(items: pa.Table, docs: pa.Table) -> pa.Table:
        if not items.num_rows or not docs.num_rows:
            return out.empty_table()
        terms, weights = (items[c].combine_chunks() for c in ("terms", "weights"))
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(terms).to_numpy()))).tolist()
        vocabulary, term = np.unique(terms.flatten().to_numpy(), return_inverse=True)
        weight, floors = weights.flatten().to_numpy(), items["floor"].to_numpy().tolist()
        bucket = Bucket(docs, vocabulary)
        queries = [Query(term[a:b], weight[a:b], f, top) for a, b, f in zip(ends[:-1], ends[1:], floors, strict=True)]
        rank = np.empty(docs.num_rows, np.int64)
        rank[pc.sort_indices(docs["id"]).to_numpy()] = np.arange(docs.num_rows)
        live = queries
        for strip in bucket.strips():
            live = [q for q in live if q.search(*strip, rank)]
            if not live:
                break
        which = np.repeat(np.arange(len(queries)), [len(q.docs) for q in queries])
        found = np.concatenate([q.docs for q in queries])
        columns = [items["id"].take(pa.array(which)), docs["id"].take(pa.array(found)), pa.array(np.concatenate([q.scores for q in queries]))]
        return pa.table(columns, names=out.names).cast(out)

    return run


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = TOP, items_held: int = ITEMS, piece: int = PIECE, seeds: int = SEEDS, vocabulary_held: int = VOCABULARY
) -> DataFrame:
    """``docs`` and ``items`` are (id, text): item_id, rank, doc_id, score of the ``top`` best documents of each item."""
    spark = docs.sparkSession
    asked = items.where("id is not null").select("id", F.col("text").cast("string").alias("text"))
    known = vectors(asked, None).select(F.explode("terms").alias("t")).distinct()
    size = known.count()
    vocabulary = np.sort(known.toPandas()["t"].to_numpy(np.int64).view(U)) if 0 < size <= vocabulary_held else None
    kinds = {"item_id": items.schema["id"].dataType, "doc_id": docs.schema["id"].dataType}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in kinds] + [T.StructField("score", T.LongType())])
    result = ["item_id", "rank", "doc_id", "score"]
    nothing = spark.createDataFrame([], schema).withColumn("rank", F.lit(1)).select(*result)
    if not size:
        return nothing

    held = settled(vectors(docs.select("id", F.col("text").cast("string").alias("text")), vocabulary).withColumn("number", F.monotonically_increasing_id()))
    total = held.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    if not total.documents:
        return nothing
    holders = held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(total.documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    blocks = max(1, -(-asked.select("id").distinct().count() // items_held))
    queries = vectors(asked, vocabulary).select("id", F.explode("terms").alias("t")).distinct().join(holders, "t").withColumn("w", weight).where("w > 0")
    queries = queries.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("tw"))  # the terms of one query
    length = F.sqrt(F.aggregate("tw", F.lit(0.0), lambda s, x: s + x["w"].cast("double") * x["w"]))
    queries = settled(
        queries.select("id", F.col("tw.t").alias("terms"), F.col("tw.w").alias("weights"), length.alias("length"), F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long")).alias("block"))
    )

    kind, term = docs.schema["id"].dataType.simpleString(), held.schema["terms"].dataType.simpleString()
    sized = held.where("id is not null").mapInArrow(
        _sized(total.documents, total.terms), f"id {kind}, number long, class int, size int, terms {term}, imps array<int>"
    )
    classes = sorted(sized.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("terms")).collect(), reverse=True)  # some hundred at most
    if not classes:
        return nothing
    cells: list[tuple[int, int, int]] = []  # class, first cell, cells
    for c in classes:
        cells.append((c["class"], sum(x[2] for x in cells), max(1, -(-c["terms"] // piece))))
    count = sum(x[2] for x in cells)
    split = next((first + k for (_, first, k), n in zip(cells, np.cumsum([c.n for c in classes]), strict=True) if n >= seeds), count)
    pieces = F.create_map(*(F.lit(x) for c, first, k in cells for x in (c, F.struct(F.lit(first).alias("first"), F.lit(k).alias("k")))))
    dealt = sized.withColumn("p", F.element_at(pieces, F.col("class"))).withColumn("cell", (F.col("p.first") + F.col("number") % F.col("p.k")).cast("int"))

    def searched(own: DataFrame, start: int, stops: list[int]) -> DataFrame:
        """``own`` (block, id, terms, weights, floor) in the cells from ``start`` up to the block's stop."""
        stop = F.array(*(F.lit(s) for s in stops))
        mine = own.select(*(F.col(c).alias(c) for c in ("id", "terms", "weights", "floor")), F.col("block").cast("int").alias("b"))
        mine = mine.where(F.element_at(stop, F.col("b") + 1) > start)
        mine = mine.withColumn("c", F.explode(F.sequence(F.lit(start), F.element_at(stop, F.col("b") + 1) - 1)))
        live = F.filter(F.sequence(F.lit(0), F.lit(len(stops) - 1)), lambda b: F.element_at(stop, b + 1) > F.col("cell"))
        theirs = dealt.where((F.col("cell") >= start) & (F.col("cell") < max(stops)))
        theirs = theirs.select(F.col("cell").alias("c"), F.explode(live).alias("b"), *(F.col(c).alias(c) for c in ("id", "terms", "imps")))
        found = mine.groupBy("b", "c").cogroup(theirs.groupBy("b", "c")).applyInArrow(_cell(top, to_arrow_schema(schema)), schema)
        return found

    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    first = settled(best(searched(queries.withColumn("floor", F.lit(0).cast("long")), 0, [split] * blocks)))
    if split == count:
        return first.select(*result)
    floors = first.where(F.col("rank") == top).select(F.col("item_id").alias("id"), F.col("score").alias("floor"))
    ready = settled(queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(0).cast("long"))))
    needed = {r.block: r.need for r in ready.groupBy("block").agg(F.min(F.col("floor") / F.col("length")).alias("need")).collect()}  # a number for each block
    stops = [max([split, *(f + k for c, f, k in cells if longest(c) >= needed.get(b, math.inf))]) for b in range(blocks)]
    if max(stops) == split:
        return first.select(*result)
    rest = searched(ready, split, stops)
    return best(first.drop("rank").unionByName(rest)).select(*result)
