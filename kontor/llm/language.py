"""Language identification in two steps: the family first, then the languages within it.

Each step is a set of one-versus-one linear support vector machines over the
relative frequencies of hashed byte trigrams (lower case, everything that is not
a letter is one blank).  The first step separates the families, the second the
languages of the winning family; votes decide, then the sum of margins.

The machines are fitted on a bounded sample: about ``SAMPLE`` texts of each language,
fewer where there are many languages (``ROWS`` texts in all, ``FEWEST`` of each), chosen
by a hash of the id, come to the driver as shares of the hashed trigrams that they have.
Every language with a text is learnt.  Languages of no listed family are families of
their own, or, beyond ``GROUP`` of them, share families of that size in order of their
codes, so the number of machines does not grow with the square of the languages.
Prediction reads whole texts.

Defined results: a null text, and one without any letter, is ``und`` with score 0
(so is every text when nothing could be learnt); repeated rows repeat; other
columns are ignored; an empty table gives an empty result.  The score is the
product of the two steps' confidences, each a logistic function of the winner's
least margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import Chunk, chunks
from .shared import chosen_share

BUCKETS = 1 << 13
#: Texts of each language that fitting sees, about, of all languages together, and of each at least; unlisted languages of a family.
SAMPLE, ROWS, FEWEST = 400, 4000, 20
GROUP = 16
UNKNOWN = "und"

# Families of languages by their codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ca ro gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "turkic": "tr az kk ky uz tt",
    "indic": "hi mr ne bn gu pa ur",
    "sinitic": "zh yue",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[:128] = 32
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)


def families(codes: list[str]) -> dict[str, str]:
    """The family of each code."""
    listed = {c: _FAMILY.get(c.lower().split("-")[0].split("_")[0]) for c in codes}
    rest = sorted(c for c, f in listed.items() if f is None)
    alone = len(rest) <= GROUP
    return {c: f or (c if alone else f"others {rest.index(c) // GROUP}") for c, f in listed.items()}


def trigrams(chunk: Chunk) -> np.ndarray:
    """Bucket of the trigram at each byte; ``BUCKETS`` where none begins (blanks only, or the end of a text)."""
    c = _CLASS[chunk.data]
    out = np.full(len(c), BUCKETS, np.int64)
    if len(c) >= 3:
        key = c[:-2] | (c[1:-1] << np.uint32(8)) | (c[2:] << np.uint32(16))
        blank = (c[:-2] == 32) & (c[1:-1] == 32)
        hashed = (key * np.uint32(2654435761)) >> np.uint32(32 - 13)
        out[:-2] = np.where(blank, BUCKETS, hashed)
    ends = chunk.offsets[1:]
    for back in (1, 2):
        out[np.maximum(ends - back, 0)[ends >= back]] = BUCKETS
    return out


def has_letter(chunk: Chunk) -> np.ndarray:
    low = chunk.data | 32
    plain = (low >= 97) & (low <= 122) & (chunk.data < 128)
    count = np.concatenate(([0], np.cumsum(plain)))[chunk.offsets]
    out = np.diff(count) > 0
    for i in np.flatnonzero(~out & (np.diff(chunk.offsets) > 0)):
        out[i] = any(c.isalpha() for c in chunk.text(i).decode("utf-8", "replace"))
    return out


def support_vectors(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 40) -> np.ndarray:
    """A linear SVM (hinge loss, last weight the constant) by dual coordinate ascent; y is -1 or 1."""
    x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), 1)
    square = (x * x).sum(1)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            new = min(cost, max(0.0, alpha[i] + (1 - y[i] * (x[i] @ w)) / square[i]))
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class Shares:
    """Rows of shares of the trigrams, held by what they have; only the rows of one machine are dense at a time."""

    def __init__(self, which: list[bytes], values: list[bytes]):
        self.rows = [(np.frombuffer(w, np.uint16), np.frombuffer(v, np.float32)) for w, v in zip(which, values, strict=True)]

    def __getitem__(self, chosen: np.ndarray) -> np.ndarray:
        out = np.zeros((int(chosen.sum()), BUCKETS))
        for row, i in zip(out, np.flatnonzero(chosen), strict=True):
            which, values = self.rows[i]
            row[which] = values.astype(np.float64) * SCALE
        return out


class Machines:
    """One-versus-one machines for families and, within each family, for languages."""

    def __init__(self, x: Shares | np.ndarray, lang: np.ndarray):
        self.languages = sorted(set(lang.tolist()))
        family = families(self.languages)
        own = np.array([family[code] for code in lang.tolist()], object)
        self.families = sorted(set(own.tolist()))
        self.steps: list[tuple[list[str], list[tuple[int, int, int]]]] = []
        weights: list[np.ndarray] = []

        def step(names: list[str], classes: np.ndarray) -> None:
            pairs = []
            for a, b in combinations(range(len(names)), 2):
                rows = (classes == names[a]) | (classes == names[b])
                pairs.append((a, b, len(weights)))
                weights.append(support_vectors(x[rows], np.where(classes[rows] == names[a], 1.0, -1.0)))
            self.steps.append((names, pairs))

        step(self.families, own)
        for name in self.families:
            step([c for c in self.languages if family[c] == name], lang)
        table = np.stack(weights, 1) if weights else np.zeros((BUCKETS + 1, 0))
        self.constant = table[-1]
        self.weights = table.astype(np.float32)
        self.weights[-1] = 0

    def margins(self, chunk: Chunk) -> np.ndarray:
        found = trigrams(chunk)
        total = np.concatenate((np.zeros((1, self.weights.shape[1])), np.cumsum(self.weights[found], 0, dtype=np.float64)))
        number = np.concatenate(([0], np.cumsum(found < BUCKETS)))
        size = np.maximum(1, np.diff(number[chunk.offsets]))
        return np.diff(total[chunk.offsets], axis=0) / size[:, None] * SCALE + self.constant

    def decide(self, margins: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the winner and its least margin, of one step."""
        names, pairs = self.steps[which]
        n = len(margins)
        votes, sums = np.zeros((n, len(names))), np.zeros((n, len(names)))
        least = np.full((n, len(names)), np.inf)
        for a, b, at in pairs:
            m = margins[:, at]
            for c, own in ((a, m), (b, -m)):
                votes[:, c] += own > 0
                sums[:, c] += own
                least[:, c] = np.minimum(least[:, c], own)
        best = np.argmax(votes + np.tanh(sums / 100) / 2, 1)
        return best, least[np.arange(n), best]

    def predict(self, chunk: Chunk) -> tuple[list[str], np.ndarray]:
        margins = self.margins(chunk)
        first, sure = self.decide(margins, 0)
        score = 1 / (1 + np.exp(-2 * sure))
        out = np.empty(len(chunk), object)
        for f in np.unique(first):
            rows = np.flatnonzero(first == f)
            second, sure = self.decide(margins[rows], 1 + f)
            out[rows] = np.array(self.steps[1 + f][0], object)[second]
            score[rows] *= 1 / (1 + np.exp(-2 * sure))
        letters = has_letter(chunk)
        out[~letters], score[~letters] = UNKNOWN, 0.0
        return out.tolist(), score


#: Relative frequencies are small; this brings margins to about 1.
SCALE = 30.0


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed trigrams that each text has, with their shares."""
    for batch in batches:
        for chunk in chunks(batch):
            found = trigrams(chunk)
            which, shares = [], []
            for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True):
                counts = np.bincount(found[a:b], minlength=BUCKETS + 1)[:BUCKETS]
                which.append(np.flatnonzero(counts).astype(np.uint16).tobytes())
                shares.append((counts[counts > 0] / max(1, counts.sum())).astype(np.float32).tobytes())
            langs = batch.column(1)[chunk.rows.start : chunk.rows.stop]
            yield pa.RecordBatch.from_arrays([langs, pa.array(which, pa.binary()), pa.array(shares, pa.binary())], ["lang", "which", "shares"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> Machines | None:
    """Machines from ``docs`` (id, text, lang); None where no language has a text."""
    known = docs.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return None
    each = min(sample, max(FEWEST, ROWS // len(sizes)))
    shares = F.create_map(*(F.lit(x) for r in sizes for x in (r.lang, min(1.0, each / r["count"]))))
    chosen = known.where(chosen_share(F.element_at(shares, F.col("lang")))).select("text", "lang")
    table = chosen.mapInArrow(_sums, "lang string, which binary, shares binary").toPandas()
    table = table[table["which"].map(len) > 0]
    if not len(table):
        return None
    return Machines(Shares(table["which"].tolist(), table["shares"].tolist()), table["lang"].to_numpy(object))


def _predict(machines: Machines | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if machines is not None:
                for chunk in chunks(batch):
                    names[chunk.rows], scores[chunk.rows] = machines.predict(chunk)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"]
            )

    return run


def predict(docs: DataFrame, machines: Machines | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return rows.mapInArrow(_predict(machines), schema).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def language(docs: DataFrame) -> DataFrame:
    """``documents`` with machines fitted on the rows that are not held out: doc_id, held_out, lang_pred, score."""
    machines = learn(docs.where(~held_out()).select(F.col("doc_id").alias("id"), "text", "lang"))
    return predict(docs, machines).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
