"""A hidden Markov language model trained by distributed Baum-Welch.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end token for
each text (a null text has only that).  Everything is learnt from the training rows:

1. Words are counted, batch by batch and hash range by hash range, over all training
   texts: N tokens, V distinct ones, and a count for each word.
2. The most frequent words, ``WORDS`` at most and seen ``LEAST`` times or more, are symbols
   of the model: whole steps of a logarithmic scale of counts, from the top, as long as
   they fit.  Every other word is a rare word of one of ``CLASSES`` classes (a hash of its
   last two bytes); its class is the symbol, and within its class it has probability
   (c + 1) / (N' + V' + 1) with the class's own sums, which leaves the share of one word
   seen once to all unseen words of the class, each of which is scored with it.
3. Baum-Welch: each task runs scaled forward and backward recursions over its texts (in
   segments of at most ``SEGMENT`` tokens, each begun afresh; all texts take part) and adds
   up expected counts; these are summed across partitions by range of symbols, and the
   driver divides them.  Rounds go on until the log-likelihood of a token gains less than
   ``GAIN``, ``ROUNDS`` at most.  The model has a fixed number of parameters.  States start from a
   clustering of a bounded sample (``SAMPLE`` texts) by which frequent words occur.
4. Scoring runs the forward recursion over each whole text, so the likelihood is exact.
   Counts of rare words come by a join on the word's hash.

The base score is the add-one unigram score: the sum over tokens of
log10((c + 1) / (N + V + 1)).

Defined results: an empty text is its end token alone; repeated rows repeat, and
count as often as they occur in training; very long texts are scored whole; other
columns are ignored; without training rows N = V = 0 and every base score is 0; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import Chunk, chunks, lists, seeded, signed
from .shared import settled

WORDS, LEAST, CLASSES, STATES = 1 << 16, 4, 256, 8
ROUNDS, GAIN, SEGMENT = 3, 0.02, 128
#: Steps of the scale of counts in each doubling.
STEPS = 16
#: Texts of the clustering, about, and the frequent words that it looks at.
SAMPLE, PROFILE = 4000, 256
#: Weight of the unigram distribution in each state's emissions, in tokens.
PRIOR = 20.0

U = np.uint64
END = int(seeded(1, 41)[0])


def words_of(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of each word, and where the words of each text begin."""
    words = chunk.words(lower=True)
    if not len(words):
        return words.hash, np.empty(0, np.int64), words.first
    low = chunk.data | np.where((chunk.data >= 65) & (chunk.data < 91), 32, 0).astype(np.uint8)
    last = low[words.stop - 1].astype(np.int64)
    before = np.where(words.stop - words.start > 1, low[np.maximum(words.stop - 2, 0)], 0).astype(np.int64)
    return words.hash, (before * 37 + last * 101) % CLASSES, words.first


def _count(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, kinds = [np.array([END], U)], [np.array([batch.num_rows])], [np.zeros(1, np.int64)]
            for chunk in chunks(batch):
                hashes, kind, _ = words_of(chunk)
                key, at, count = np.unique(hashes, return_index=True, return_counts=True)
                keys.append(key)
                counts.append(count)
                kinds.append(kind[at])
            key, at, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            count = np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64)
            kind = np.concatenate(kinds)[at].astype(np.uint8)
            # the ranges that occur; there may be many more than a batch has words
            some, first = np.unique(((key >> U(32)) * U(ranges)) >> U(32), return_index=True)
            cut = np.append(first, len(key))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32))]
                + [pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (key, count, kind)],
                ["range", "keys", "counts", "kinds"],
            )

    return run


def _merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Counts and classes of the words of a range of hashes."""
    keys = np.concatenate([np.frombuffer(x, U) for x in group["keys"]])
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in group["counts"]])
    kinds = np.concatenate([np.frombuffer(x, np.uint8) for x in group["kinds"]])
    keys, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
    counts = np.bincount(inverse, counts).astype(np.int64)
    return pd.DataFrame({"keys": [keys.tobytes()], "counts": [counts.tobytes()], "kinds": [kinds[at].tobytes()]})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The count and the class of each word as rows."""
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            values = [np.frombuffer(x.as_py(), kind) for x, kind in zip(row, (np.int64, np.int64, np.uint8), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(values[0]), pa.array(values[1]), pa.array(values[2].astype(np.int32))], ["key", "c", "kind"])


class Symbols:
    """The model's symbols: frequent words, then classes of rare words, then the end."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, kinds: np.ndarray, tokens: np.ndarray, words: np.ndarray, ends: int):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        n = len(keys)
        self.tokens = int(tokens.sum()) + ends
        self.distinct = int(words.sum()) + (ends > 0)
        rare = tokens - np.bincount(kinds, counts, CLASSES).astype(np.int64)
        kinds_left = words - np.bincount(kinds, minlength=CLASSES)
        self.within = np.log10(rare + kinds_left + 1.0)
        self.size, self.end, self.ends = n + CLASSES + 1, n + CLASSES, ends
        weight = np.concatenate((self.counts, rare + 1.0, [ends + 1.0]))
        self.unigram = weight / weight.sum()
        # a table of slots finds most keys; those that share a slot are searched for
        slot = (self.keys >> U(43)).astype(np.int64)
        self.slots = np.full(1 << 21, -1, np.int32)
        self.slots[slot[::-1]] = np.arange(n - 1, -1, -1)
        crowded = np.bincount(slot, minlength=1 << 21) > 1
        self.crowded = crowded if crowded.any() else None

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word among the frequent ones, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        slot = (hashes >> U(43)).astype(np.int64)
        at = self.slots[slot].astype(np.int64)
        at[(at >= 0) & (self.keys[at] != hashes)] = -1
        if self.crowded is not None:
            look = np.flatnonzero(self.crowded[slot])
            where = np.minimum(np.searchsorted(self.keys, hashes[look]), len(self.keys) - 1)
            at[look] = np.where(self.keys[where] == hashes[look], where, -1)
        return at

    def sequence(self, chunk: Chunk):
        """Symbols of all texts with their ends, flat, and offsets; also number, hash and class of each word, and offsets of words."""
        hashes, kind, first = words_of(chunk)
        at = self.find(hashes)
        symbols = np.where(at >= 0, at, len(self.keys) + kind)
        flat = np.insert(symbols, first[1:], self.end)
        return flat, first + np.arange(len(first)), at, hashes, kind, first


class Model:
    def __init__(self, symbols: Symbols, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.symbols, self.start, self.move, self.emit = symbols, start, move, emit

    def forward(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log-likelihood of each sequence by the scaled forward recursion."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        begin, ordered = first[:-1][order], size[order]
        out = np.zeros(len(size))
        if not len(size):
            return out
        live = len(size) - np.searchsorted(ordered[::-1], np.arange(ordered[0]), "right")
        alpha = np.broadcast_to(self.start, (len(size), len(self.start)))
        total = np.zeros(len(size))
        for t, n in enumerate(live.tolist()):
            alpha = (alpha[:n] if t == 0 else alpha[:n] @ self.move) * self.emit[flat[begin[:n] + t]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            total[:n] += np.log(scale)
        out[order] = total
        return out

    def expect(self, flat: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Adds expected emissions to ``counts`` (symbols x states); returns expected starts, moves, and the log-likelihood."""
        begin = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(first[:-1], first[1:], strict=True)])
        stop = np.minimum(begin + SEGMENT, first[np.searchsorted(first, begin, "right")])
        order = np.argsort(begin - stop, kind="stable")
        begin, size = begin[order], (stop - begin)[order]
        live = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), "right")
        states = len(self.start)
        alphas, emits, scales = [], [], []
        alpha = np.broadcast_to(self.start, (len(size), states))
        for t, n in enumerate(live.tolist()):
            emit = self.emit[flat[begin[:n] + t]]
            alpha = (alpha[:n] if t == 0 else alpha[:n] @ self.move) * emit
            scale = alpha.sum(1, keepdims=True)
            alpha = alpha / scale
            alphas.append(alpha)
            emits.append(emit)
            scales.append(scale)
        moves = np.zeros((states, states))
        beta = np.ones((live[-1], states))
        places, weights = [], []
        for t in range(len(live) - 1, -1, -1):
            n = int(live[t])
            if t + 1 < len(live):
                m = int(live[t + 1])
                ahead = emits[t + 1] * beta / scales[t + 1]
                moves += alphas[t][:m].T @ ahead
                beta = np.concatenate((ahead @ self.move.T, np.ones((n - m, states))))
            gamma = alphas[t] * beta
            gamma /= gamma.sum(1, keepdims=True)
            places.append(begin[:n] + t)
            weights.append(gamma)
        starts = weights[-1][np.isin(begin, first[:-1])].sum(0)
        place, weight = flat[np.concatenate(places)], np.concatenate(weights)
        for s in range(states):
            counts[:, s] += np.bincount(place, weight[:, s], len(counts))
        return starts, moves * self.move, float(sum(np.log(x).sum() for x in scales))


def _expect(model):
    """Expected counts of a task, in blocks of symbols; block -1 holds starts, moves and the log-likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        counts = np.zeros((own.symbols.size, STATES))
        starts, moves, likely, some = np.zeros(STATES), np.zeros((STATES, STATES)), 0.0, False
        for batch in batches:
            for chunk in chunks(batch):
                flat, first = own.symbols.sequence(chunk)[:2]
                a, b, c = own.expect(flat, first, counts)
                starts, moves, likely, some = starts + a, moves + b, likely + c, True
        if some:
            parts = [counts[i : i + 1024] for i in range(0, len(counts), 1024)]
            blocks = [*range(len(parts)), -1]
            parts.append(np.concatenate((starts[None], moves, np.full((1, STATES), likely))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "sums"]
            )

    return run


def _add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(group["sums"].iloc[0]) // 8)
    for x in group["sums"]:
        total += np.frombuffer(x, np.float64)
    return pd.DataFrame({"block": [key[0]], "sums": [total.tobytes()]})


def _profile(symbols, frequent: np.ndarray):
    """Which of the frequent words each text has, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = symbols.value
        number = np.full(own.size, -1)
        number[frequent] = np.arange(len(frequent))
        for batch in batches:
            for chunk in chunks(batch):
                flat, first = own.sequence(chunk)[:2]
                table = np.zeros((len(chunk), len(frequent)), bool)
                text = np.repeat(np.arange(len(chunk)), np.diff(first))
                hit = number[flat] >= 0
                table[text[hit], number[flat[hit]]] = True
                yield pa.RecordBatch.from_arrays([pa.array([np.packbits(r).tobytes() for r in table], pa.binary())], ["bits"])

    return run


def clusters(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means from farthest-first centres; the share of each column in each cluster, smoothed."""
    x = x.astype(float)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    chosen = [int(np.argmax(x.sum(1)))]
    near = unit @ unit[chosen[0]]
    for _ in range(k - 1):
        chosen.append(int(np.argmin(np.where(x.any(1), near, 2.0))))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    centre = unit[chosen]
    for _ in range(rounds):
        member = np.argmax(unit @ centre.T, 1)
        for c in range(k):
            if (member == c).any():
                mean = unit[member == c].mean(0)
                centre[c] = mean / max(1e-9, np.linalg.norm(mean))
    overall = x.mean(0)
    return np.stack([(x[member == c].sum(0) + 5 * overall) / ((member == c).sum() + 5) for c in range(k)])


def learn(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model from ``train`` (id, text), and the count of each word as (key, c)."""
    spark = train.sparkSession
    size = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = max(16, (size.bytes or 0) // 8_000_000)
    counted = train.mapInArrow(_count(ranges), "range int, keys binary, counts binary, kinds binary")
    merged = settled(counted.groupBy("range").applyInPandas(_merge, "keys binary, counts binary, kinds binary"))
    rows = merged.mapInArrow(_rows, "key long, c long, kind int")
    plain = rows.where(F.col("key") != F.lit(int(signed(np.array([END], U))[0])))
    # at most CLASSES rows, and some hundred steps of the scale
    tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in plain.groupBy("kind").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        tokens[r.kind], words[r.kind] = r.c, r.n
    step = F.floor(F.log2("c") * STEPS)
    scale = plain.where(F.col("c") >= LEAST).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, room = None, WORDS
    for r in sorted(scale, key=lambda r: -r.step):
        room -= r.n
        if room < 0:
            break
        least = r.step
    best = plain.where((F.col("c") >= LEAST) & (step >= least)).collect() if least is not None else []
    keys, counts, kinds = np.array([r.key for r in best], np.int64).view(U), np.array([r.c for r in best], np.int64), np.array([r.kind for r in best], np.int64)
    symbols = Symbols(keys, counts, kinds, tokens, words, size.n)
    model = _first(train, symbols, size.n)
    before = -np.inf
    for _ in range(ROUNDS if size.n else 0):
        shipped = spark.sparkContext.broadcast(model)
        sums = train.mapInArrow(_expect(shipped), "block int, sums binary").groupBy("block").applyInPandas(_add, "block int, sums binary")
        found = {r.block: np.frombuffer(r.sums, np.float64).reshape(-1, STATES) for r in sums.collect()}
        if not found:
            break
        emit = np.concatenate([found[b] for b in sorted(found) if b >= 0])
        model = _divided(symbols, found[-1][0], found[-1][1:-1], emit)
        likely = found[-1][-1, 0] / symbols.tokens
        if likely - before < GAIN:
            break
        before = likely
    return model, rows.select("key", "c")


def _divided(symbols: Symbols, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    """The M-step: expected counts to probabilities, emissions smoothed towards the unigram distribution."""
    start = (start + 0.1) / (start + 0.1).sum()
    move = (move + 0.1) / (move + 0.1).sum(1, keepdims=True)
    emit = emit + PRIOR * symbols.unigram[:, None]
    return Model(symbols, start, move, emit / emit.sum(0))


def _first(train: DataFrame, symbols: Symbols, n: int) -> Model:
    """States that favour the frequent words of one cluster each."""
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    emit = np.repeat(symbols.unigram[:, None], STATES, 1)
    frequent = np.argsort(-symbols.counts, kind="stable")[:PROFILE]
    share = min(1.0, SAMPLE / max(1, n))
    if len(frequent) and n:
        shipped = train.sparkSession.sparkContext.broadcast(symbols)
        some = train.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
        rows = some.mapInArrow(_profile(shipped, frequent), "bits binary").limit(4 * SAMPLE).collect()
        x = np.stack([np.unpackbits(np.frombuffer(r.bits, np.uint8))[: len(frequent)] for r in rows]) if rows else np.empty((0, 1))
        if len(x) >= STATES:
            emit[frequent] *= (clusters(x, STATES) / np.maximum(x.mean(0), 1e-6)).T
    return Model(symbols, np.full(STATES, 1 / STATES), move, emit / emit.sum(0))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        symbols = own.symbols
        logs = np.log10(symbols.counts + 1.0)
        for batch in batches:
            for chunk in chunks(batch, limit=2 << 20):
                flat, first, at, hashes, kind, words = symbols.sequence(chunk)
                likely = own.forward(flat, first) / np.log(10)
                text = np.repeat(np.arange(len(chunk)), np.diff(words))
                known = at >= 0
                base = np.bincount(text[known], logs[at[known]], len(chunk)) + np.log10(symbols.ends + 1.0)
                inside = np.bincount(text[~known], symbols.within[kind[~known]], len(chunk))
                pair = np.stack((text[~known].astype(U), hashes[~known]), 1)
                pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
                new = np.ones(len(pair), bool)
                new[1:] = (pair[1:] != pair[:-1]).any(1)
                begin = np.flatnonzero(new)
                number = np.diff(np.append(begin, len(pair))).astype(np.int32)
                cut = np.searchsorted(pair[begin, 0], np.arange(len(chunk) + 1, dtype=U))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[chunk.rows.start : chunk.rows.stop],
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.array(np.bincount(text[known], minlength=len(chunk)) + int(symbols.ends > 0)),
                        pa.array(base),
                        pa.array(likely - inside),
                        lists(signed(pair[begin, 1]), cut),
                        lists(number, cut),
                    ],
                    ["id", "n_tokens", "known", "base", "likely", "keys", "numbers"],
                )

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(id, text) to id, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.schema["id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.mapInArrow(
        _score(shipped),
        f"id {kind}, n_tokens long, known long, base double, likely double, keys array<long>, numbers array<int>",
    )
    # a number for each row, so that rows with one id stay apart
    rows = settled(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode(F.arrays_zip("keys", "numbers")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.numbers").alias("n"))
    found = rare.join(counts, "key").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("also")
    )
    n, v = model.symbols.tokens, model.symbols.distinct
    both = rows.drop("keys", "numbers").join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return both.select(
        "id",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("likely") + more).alias("score"),
    )


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 7 == 2


def language_model(docs: DataFrame) -> DataFrame:
    """``documents`` scored by a model trained on the rows that are not held out."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    model, counts = learn(rows.where(~held_out("id")))
    return score(rows, model, counts).withColumnRenamed("id", "doc_id").withColumn("held_out", held_out())
