"""Quality rules as a learned decision list.

Each text is measured by a fixed set of statistics (whole texts, in Arrow batches), and
documents with a quality label teach an ordered list of rules: conjunctions of
thresholds on these statistics, such as ``symbol_share >= 0.31 and n_words <= 4200``.

Sequential covering: the labelled rows that no rule covers yet are split into two parts.
A rule grows on the first, condition by condition, each time the one with the highest
information gain, until it covers no good document or nothing gains; then it is pruned on
the second part, from the end, to the conjunction with the best balance there.  A rule is
taken if it is right often enough (``PRECISION``) on the rows that pruned it, and what it
covers is put aside; the first rule that fails ends the list.  The list becomes one ordered
Spark conditional expression (``verdict``), evaluated without Python.

The list is fitted on at most ``SAMPLE`` labelled documents, chosen by a hash of the id;
documents with crc32(id as text) mod 5 = 0 are held out, so its accuracy can be measured.
Statistics of all other documents come from the second, unbounded pass.

Defined results: a null text is an empty one; a text of fewer than 50 words, or with more
than half of its words in repeated windows, fails the base rule, is not kept and teaches
nothing; shares of nothing are 0; a document of several labels has the more frequent one,
good if they are even; of rows with one id one teaches; rows without an id are measured
and judged, teach nothing and are not held out; with labels of one kind only, or none,
every text that passes the base rule is kept; repeated rows repeat; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import _SPACE, Chunk, chunks, mix, seeded

#: Labelled documents that teach, at most; rules and conditions at most; thresholds tried for a statistic.
SAMPLE, RULES, CONDITIONS, CUTS = 20_000, 32, 6, 64
#: Share of bad documents among what a rule covers, at least, and how many bad ones it must cover.
PRECISION, FEWEST = 0.9, 3
HELD_OUT = 5

U = np.uint64
_NEWLINE = np.arange(256) == 10
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_MARK = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 192 for c in range(256)])  # a character beyond ASCII counts once
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_BEGINS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character
_FACTORS, _SALT = seeded(3, 31) | U(1), seeded(1, 32)[0]

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_top", "n_upper", "n_letters", "n_digits", "n_marks", "longest")

#: Statistics that rules are made of, from the counts.
SHARES = {
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "top_share": ("n_top", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "n_words"),
    "line_words": ("n_words", "n_lines"),
}
FEATURES = ("n_words", "longest", *SHARES)


def _within(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(marked, dtype=np.int64)))[offsets])


def _runs(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (text, value, place), which of it begin a value, and how often each of it occurs."""
    order = np.lexsort((h, text))
    new = np.ones(len(order), bool)
    new[1:] = (text[order[1:]] != text[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
    number = np.cumsum(new) - 1
    return order, new, np.bincount(number, minlength=1)[number] if len(number) else number


def measure(chunk: Chunk) -> list[np.ndarray]:
    """The counts of each text."""
    data, offsets, texts = chunk.data, chunk.offsets, len(chunk)
    words, lines = chunk.words(), chunk.words(breaks=_NEWLINE)
    solid = ~_SPACE[data]
    ink = np.concatenate(([0], np.cumsum(solid & _BEGINS[data], dtype=np.int64)))
    n_words, per = np.diff(words.first), lambda text, which: np.bincount(text[which], minlength=texts)

    full = np.flatnonzero(ink[lines.stop] > ink[lines.start])  # lines with a word
    line_text = lines.text[full]
    order, new, _ = _runs(line_text, lines.hash[full])
    dup_lines = per(line_text[order], ~new)

    order, new, times = _runs(words.text, words.hash)
    top = np.zeros(texts, np.int64)
    np.maximum.at(top, words.text[order], times)
    distinct = per(words.text[order], new)
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, words.text, ink[words.stop] - ink[words.start])

    n = max(0, len(words) - 2)
    with np.errstate(over="ignore"):
        window = mix(words.hash[:n] * _FACTORS[0] + words.hash[1 : n + 1] * _FACTORS[1] + words.hash[2 : n + 2] * _FACTORS[2] + _SALT)
    at = np.flatnonzero(words.text[:n] == words.text[2 : n + 2])
    order, _, times = _runs(words.text[at], window[at])
    again = at[order[times > 1]]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[again + k] = True

    counted = [_within(table[data], offsets) for table in (_UPPER, _LETTER, _DIGIT, _MARK)]
    return [n_words, np.diff(ink[offsets]), _within(_SYMBOL[data], offsets), dup_lines, per(words.text, covered), per(line_text, slice(None)), distinct, top, *counted, longest]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch):
            ids = batch.column(0)[chunk.rows.start : chunk.rows.stop]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c.astype(np.int64)) for c in measure(chunk))], ["id", *COUNTS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, the counts, the shares, and whether the base rule fails."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_measure, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    shares = {name: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0) for name, (a, b) in SHARES.items()}
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumns(shares).withColumn("base_failed", failed)


@dataclass(frozen=True)
class Condition:
    feature: str
    least: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        values = table[self.feature]
        return values >= self.threshold if self.least else values <= self.threshold

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value >= F.lit(self.threshold) if self.least else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.least else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(table)
    return out


def _thresholds(values: np.ndarray) -> list[float]:
    """Middles between quantiles, rounded to four digits so that a rule reads well."""
    cuts = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 1), method="inverted_cdf"))
    return sorted({float(f"{(a + b) / 2:.4g}") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)})


def grow(table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition with the highest gain until only bad rows are covered."""
    rule: list[Condition] = []
    covered = np.ones(len(bad), bool)
    while len(rule) < CONDITIONS and (covered & ~bad).any():
        p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
        best, gain = None, 1e-9
        for feature in FEATURES:
            own, hit = table[feature][covered], bad[covered]
            cuts = _thresholds(own)
            if not cuts:
                continue
            order = np.argsort(own, kind="stable")
            ranked, below = own[order], np.concatenate(([0], np.cumsum(hit[order])))
            for least in (True, False):
                at = np.searchsorted(ranked, cuts, "left" if least else "right")
                p, size = (p0 - below[at], len(own) - at) if least else (below[at], at)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(p > 0, p * (np.log2(p / size) - np.log2(p0 / (p0 + n0))), 0)
                k = int(np.argmax(gains))
                if gains[k] > gain:
                    best, gain = Condition(feature, least, cuts[k]), gains[k]
        if best is None:
            break
        rule.append(best)
        covered &= best.holds(table)
    return tuple(rule)


def prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule with the best balance of bad and good rows; the shortest of equals."""

    def balance(k: int) -> float:
        hit = _holds(rule[:k], table, len(bad))
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (balance(k), -k))] if rule else rule


def learn(table: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """The ordered rules; each covers bad documents that those before it leave."""
    rules: list[Rule] = []
    draw = np.random.default_rng(seed)
    rest = np.arange(len(bad))
    while len(rules) < RULES and bad[rest].sum() >= FEWEST and not bad[rest].all():
        part = draw.random(len(rest)) < 2 / 3
        of = lambda rows: ({f: table[f][rows] for f in FEATURES}, bad[rows])
        grown, (pruning, truth) = grow(*of(rest[part])), of(rest[~part])
        rule = prune(grown, pruning, truth)
        if not rule:
            break
        hit = _holds(rule, pruning, len(truth))
        if not hit.any():  # too few rows to prune with: all that is left must judge
            pruning, truth = of(rest)
            hit = _holds(rule, pruning, len(truth))
        if (hit & truth).sum() < PRECISION * hit.sum():
            break
        covered = _holds(rule, of(rest)[0], len(rest))
        if (covered & bad[rest]).sum() < FEWEST:
            break
        rules.append(rule)
        rest = rest[~covered]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, counted from 1; 0 where none does, and the document is good."""
    out = F.lit(0)
    for number, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column()
        out = F.when(holds, F.lit(number)).otherwise(out)
    return out


def held_out(id_col: str = "id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % HELD_OUT == 0, F.lit(False))


def rules_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1), without the documents that are held out."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg((F.avg("quality") < 0.5).alias("bad"))
    chosen = one.where(~held_out()).orderBy(F.xxhash64("id"), "id").limit(sample)  # a bounded sample, so it can be sent to the readers
    taught = docs.join(F.broadcast(chosen.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    rows = statistics(taught).where(~F.col("base_failed"))
    rows = rows.groupBy("id").agg(F.min(F.struct(*FEATURES)).alias("s")).join(F.broadcast(chosen), "id").orderBy("id")
    known = rows.select(*(F.col(f"s.{f}").cast("double").alias(f) for f in FEATURES), "bad").toPandas()
    return learn({f: known[f].to_numpy(np.float64) for f in FEATURES}, known["bad"].to_numpy(bool))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept, rule (which one rejects it; 0 for none)."""
    out = statistics(docs).withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(verdict(rules)))
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept")
    return out.select(F.col("id").alias("doc_id"), *first, kept, "rule", held_out().alias("held_out"))


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` (doc_id, text) judged by the rules that ``labels`` (doc_id, quality) teach."""
    return judge(docs, rules_of(docs, labels, sample))
