"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes: insult, threat, target, negation, reported speech, other.
Five small transducers read the classes of a clause side by side; their product
(``compose``) is one machine whose arcs carry the combined weights.  An insult
counts by its own weight, more when a target stands before it, less within the
reach of a negation or under a verb of speech.  A word of threat counts little by
itself; the arc from it to a target within ``AIM`` words carries the threat's weight, so
"kill you" is a threat and "kill time" is not; it is damped like an insult.  What is
scored is the clause; a text is scored from its matched clauses, those with an insult
or an aimed threat (strongest clause, their sum, their number, how much of it is
negated or reported, and threats) by a logistic function.

Which words are insults is learnt: whole words and word beginnings whose share
of toxic texts is high are candidates, and a greedy cover of the toxic texts
takes the fewest of them that explain each text ``COVER`` times.  Learning uses a
sample of at most about ``SAMPLE`` labelled rows, chosen by a hash of the id;
equal texts count once.  The other classes are short fixed lists.

Defined results: null and empty texts have no clause and get the lowest score;
texts are read whole; repeated rows repeat; a text with more than one label is
toxic if one of them says so; without a label of both kinds nothing can be learnt
and every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import NOT_ALNUM, Chunk, chunks, signed, word_hashes
from .shared import chosen_share, settled, without

#: Labelled rows that learning sees at most (about, as a hash chooses them), candidates kept, times that each toxic text is explained.
SAMPLE = 20_000
CANDIDATES = 4096
COVER = 3
#: Lengths in bytes of word beginnings, and the share of toxic texts that a candidate needs.
PREFIXES = (4, 5, 6, 7)
PURITY = 0.8

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
# Words of the classes that are not learnt (English, German, French, Spanish).
LISTS = {
    THREAT: "kill hurt destroy murder beat crush burn töten umbringen vernichten tuer détruire frapper matar destruir golpear",
    TARGET: "you your yours u he she they them du dich dein ihr euch tu toi vous votre tú usted ustedes vosotros",
    NEGATION: "not no never isn aren don doesn nicht kein keine nie ne pas jamais nunca jamás tampoco",
    REPORT: "said says say wrote claimed called quoted reported sagte sagt schrieb dit disait écrit dijo dice escribió",
}

# Clauses end at these bytes.
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?;,:\n|\"()"]] = True


class Transducer:
    """States with arcs (state, class) -> (state, factor); a class without an arc stays where it is, with factor 1."""

    def __init__(self, states: int, arcs: dict[tuple[int, int], tuple[int, float]]):
        self.states, self.arcs = states, arcs

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.arcs.get((state, symbol), (state, 1.0))


#: Words after a word of threat within which a target makes it a threat, and words that a negation reaches.
AIM = REACH = 3


def machines() -> list[Transducer]:
    """Insult, threat, target, negation and reported speech."""
    insult = Transducer(2, {(0, INSULT): (1, 1.0), (1, INSULT): (1, 1.1)})
    # the threat is paid on the arc that finds its target; a word of threat without one pays nothing
    aimed = {(0, THREAT): (AIM, 0.0)}
    for left in range(AIM, 0, -1):
        aimed |= {(left, s): (left - 1, 1.0) for s in (OTHER, NEGATION, REPORT, INSULT)}
        aimed |= {(left, THREAT): (AIM, 0.0), (left, TARGET): (0, 1.0)}
    target = Transducer(2, {(0, TARGET): (1, 1.0), (1, INSULT): (1, 1.3)})
    reach = {(0, NEGATION): (REACH, 1.0)}
    for left in range(REACH, 0, -1):
        reach |= {(left, s): (left - 1, 1.0) for s in (OTHER, REPORT, THREAT)}
        reach |= {(left, NEGATION): (REACH, 1.0), (left, INSULT): (0, 0.5), (left, TARGET): (left - 1, 0.5)}
    report = Transducer(2, {(0, REPORT): (1, 1.0), (1, INSULT): (1, 0.7), (1, TARGET): (1, 0.7)})
    return [insult, Transducer(AIM + 1, aimed), target, Transducer(REACH + 1, reach), report]


class Product:
    """The product of transducers: next state and factor for (state, class), and each part's state in each of its states.

    State 0 is where all parts begin.
    """

    def __init__(self, parts: list[Transducer]):
        start = (0,) * len(parts)
        number, todo, rows = {start: 0}, [start], {}
        while todo:
            state = todo.pop()
            for symbol in range(6):
                steps = [p.step(s, symbol) for p, s in zip(parts, state, strict=True)]
                after = tuple(s for s, _ in steps)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                rows[number[state], symbol] = (number[after], float(np.prod([f for _, f in steps])))
        self.states = list(number)
        self.following, self.factor = np.zeros((len(number), 6), np.int64), np.ones((len(number), 6))
        for (s, c), (after, f) in rows.items():
            self.following[s, c], self.factor[s, c] = after, f

    def active(self, part: int) -> list[bool]:
        """For each state, whether the part is out of its first state."""
        return [s[part] > 0 for s in self.states]


FEATURES = 6
#: What an aimed threat adds to its clause, in the insults' unit (log odds).
THREATENED = 3.0


class Grammar:
    """Learnt insult arcs, fixed lists, the composed machine, and the logistic weights over clause features."""

    def __init__(self, lengths: np.ndarray, hashes: np.ndarray, weights: np.ndarray):
        self.lengths, self.hashes, self.weights = lengths, hashes, weights
        fixed = [(h, c) for c, ws in LISTS.items() for h in word_hashes(ws.split()).tolist()]
        fixed.sort()
        self.fixed = np.array([h for h, _ in fixed], np.uint64)
        self.kinds = np.array([c for _, c in fixed], np.int8)
        self.machine = Product(machines())
        self.logit = np.zeros(FEATURES + 1)

    def classes(self, chunk: Chunk):
        """Words of the chunk, class of each, and weight of those that are insults."""
        words = chunk.words(lower=True, breaks=NOT_ALNUM)
        kind = np.zeros(len(words), np.int8)
        weight = np.zeros(len(words))
        if not len(words):
            return words, kind, weight
        at = np.minimum(np.searchsorted(self.fixed, words.hash), len(self.fixed) - 1)
        hit = self.fixed[at] == words.hash
        kind[hit] = self.kinds[at[hit]]
        for length in np.unique(self.lengths):
            own = self.lengths == length
            order = np.argsort(self.hashes[own])
            keys, values = self.hashes[own][order], self.weights[own][order]
            hashes = words.hash if length == 0 else words.hashes(0, np.minimum(words.start + length, words.stop))
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[at] == hashes
            if length:
                hit &= words.stop - words.start > length
            kind[hit] = INSULT
            weight[hit] = np.maximum(weight[hit], values[at[hit]])
        return words, kind, weight

    def features(self, chunk: Chunk) -> np.ndarray:
        """Per text: strongest clause, log of the clauses' sum, of their number, share negated, share reported, log of threats."""
        out = np.zeros((len(chunk), FEATURES))
        words, kind, weight = self.classes(chunk)
        marked = np.flatnonzero(kind)
        if not len(marked):
            return out
        ends = np.cumsum(_ENDS[chunk.data])
        clause = ends[words.start[marked]] + words.text[marked]  # a text begins a clause, too
        strong = np.isin(kind[marked], (INSULT, THREAT))
        keep = np.isin(clause, clause[strong])
        marked, clause = marked[keep], clause[keep]
        total, number, damped, quoted, threats = (np.zeros(len(chunk)) for _ in range(5))
        cuts = np.flatnonzero(np.diff(clause)) + 1
        following, factors = self.machine.following.tolist(), self.machine.factor.tolist()
        aiming, denying, speaking = (self.machine.active(k) for k in (1, 3, 4))
        for run in np.split(marked, cuts) if len(marked) else ():
            state, score, threat, before = 0, 0.0, 0.0, run[0]
            text = words.text[run[0]]
            spoken = denied = matched = False
            for w in run.tolist():
                for _ in range(min(max(AIM, REACH), w - before - 1)):
                    state = following[state][OTHER]
                symbol, at = kind[w], state
                state = following[at][symbol]
                if symbol == INSULT or symbol == TARGET and aiming[at]:
                    matched = True
                    denied |= denying[at]
                    spoken |= speaking[at]
                    if symbol == INSULT:
                        score += weight[w] * factors[at][symbol]
                    else:
                        threat += factors[at][symbol]
                before = w
            if matched:
                score += THREATENED * threat
                threats[text] += threat
                out[text, 0] = max(out[text, 0], score)
                total[text] += score
                number[text] += 1
                damped[text] += denied
                quoted[text] += spoken
        some = np.maximum(number, 1)
        out[:, 1], out[:, 2] = np.log1p(total), np.log1p(number)
        out[:, 3], out[:, 4], out[:, 5] = damped / some, quoted / some, np.log1p(threats)
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.logit[0] + features @ self.logit[1:])))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, hash) of the words and beginnings of each text, with the texts of either label that have it."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for chunk in chunks(batch):
            words = chunk.words(lower=True, breaks=NOT_ALNUM)
            toxic = label[chunk.rows] == 1
            for length in (0, *PREFIXES):
                hashes = words.hash if length == 0 else words.hashes(0, np.minimum(words.start + length, words.stop))
                fit = words.stop - words.start > length
                pair = np.unique(np.stack((hashes[fit], words.text[fit].astype(np.uint64)), 1), axis=0)
                key, inverse = np.unique(pair[:, 0], return_inverse=True)
                bad = np.bincount(inverse, toxic[pair[:, 1].astype(np.int64)], len(key)).astype(np.int64)
                every = np.bincount(inverse, minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), length, np.int32)), pa.array(signed(key)), pa.array(bad), pa.array(every - bad)],
                    ["length", "hash", "toxic", "clean"],
                )


def _found(grammar: Grammar):
    """Per text: label and which candidates it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch):
                words = chunk.words(lower=True, breaks=NOT_ALNUM)
                rows = [[] for _ in range(len(chunk))]
                for length in np.unique(grammar.lengths):
                    own = np.flatnonzero(grammar.lengths == length)
                    own = own[np.argsort(grammar.hashes[own])]
                    hashes = words.hash if length == 0 else words.hashes(0, np.minimum(words.start + length, words.stop))
                    at = np.minimum(np.searchsorted(grammar.hashes[own], hashes), len(own) - 1)
                    hit = np.flatnonzero((grammar.hashes[own[at]] == hashes) & (words.stop - words.start > length))
                    for t, c in set(zip(words.text[hit].tolist(), own[at[hit]].tolist(), strict=True)):
                        rows[t].append(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[chunk.rows]), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "found"]
                )

    return run


def _features(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[chunk.rows]), pa.array(list(grammar.features(chunk)), pa.list_(pa.float64()))],
                    ["toxic", "features"],
                )

    return run


def cover(found: list[list[int]], toxic: np.ndarray, n: int, times: int = COVER) -> list[int]:
    """Candidates, best first: each brings at least two more (text, time) pairs of toxic texts, fewer for clean ones."""
    holders: list[list[int]] = [[] for _ in range(n)]
    clean = np.zeros(n)
    for i, own in enumerate(found):
        for c in own:
            if toxic[i]:
                holders[c].append(i)
            else:
                clean[c] += 1
    need = np.where(toxic, times, 0)
    arrays = [np.array(h, np.int64) for h in holders]
    gain = np.array([len(a) for a in arrays]) - 3 * clean
    chosen: list[int] = []
    open_ = set(np.flatnonzero(gain > 1).tolist())
    while open_:
        best = max(open_, key=lambda c: (gain[c], -c))
        new = (need[arrays[best]] > 0).sum() - 3 * clean[best]
        if new < gain[best]:  # gains only fall: look again before taking it
            gain[best] = new
            if new < 2:
                open_.discard(best)
            continue
        chosen.append(best)
        open_.discard(best)
        need[arrays[best]] -= 1
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first weight is the constant."""
    x = np.concatenate((np.ones((len(x), 1)), x), 1)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar | None:
    """The grammar from labelled texts: ``docs`` (id, text) and ``labels`` (id, toxic).  None without both labels."""
    known = labels.where("toxic is not null and id is not null")
    share = sample / max(1, known.count())
    if share < 1:
        known = known.where(chosen_share(F.lit(share)))
    known = known.groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # a sample of about `sample` rows: small enough to broadcast, whatever the table
    texts = docs.where("text is not null").join(F.broadcast(known), "id")
    texts = settled(texts.groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", "toxic"))
    texts = texts.select("text", "toxic")
    kinds = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not kinds.get(0) or not kinds.get(1):
        return None
    counts = texts.mapInArrow(_count, "length int, hash long, toxic long, clean long")
    counts = counts.groupBy("length", "hash").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    pure = counts.where(f"toxic >= 2 and toxic >= {PURITY} * (toxic + clean)")
    best = pure.orderBy(F.desc("toxic"), "clean", "length", "hash").limit(CANDIDATES).toPandas()
    lengths, hashes = best["length"].to_numpy(), best["hash"].to_numpy().view(np.uint64)
    odds = np.log((best["toxic"] + 0.5) / (kinds[1] + 1)) - np.log((best["clean"] + 0.5) / (kinds[0] + 1))
    grammar = Grammar(lengths, hashes, odds.to_numpy(float))
    if len(best):
        table = texts.mapInArrow(_found(grammar), "toxic int, found array<int>").toPandas()
        chosen = cover([list(f) for f in table["found"]], table["toxic"].to_numpy() == 1, len(best))
        grammar = Grammar(lengths[chosen], hashes[chosen], odds.to_numpy(float)[chosen])
    table = texts.mapInArrow(_features(grammar), "toxic int, features array<double>").toPandas()
    grammar.logit = logistic(np.stack(table["features"]), table["toxic"].to_numpy(float))
    return grammar


def _score(grammar: Grammar | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, clauses = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for chunk in chunks(batch):
                if grammar is not None:
                    features = grammar.features(chunk)
                    scores[chunk.rows] = grammar.score(features)
                    clauses[chunk.rows] = np.rint(np.expm1(features[:, 2]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(clauses)], ["id", "score", "clauses"])

    return run


def score(docs: DataFrame, grammar: Grammar | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score in 0..1, number of matched clauses."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("clauses", T.LongType()),
        ]
    )
    return rows.mapInArrow(_score(grammar), schema).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` scored by a grammar that learnt from ``labels``, rows held out excepted: doc_id, held_out, score, predicted, clauses."""
    seen = labels.select(F.col("doc_id").alias("id"), "toxic").where(~held_out("id"))
    grammar = learn(docs.select(F.col("doc_id").alias("id"), "text"), seen)
    return score(docs, grammar).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses"
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``toxicity`` rejects; the columns stay.  Rows of one id go together."""
    gone = toxicity(docs, labels).where("predicted = 1").select("doc_id").distinct()
    return without(docs, "doc_id", settled(gone))
