"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (pattern, then a test that a match must pass; matches are leftmost
and non-overlapping within a kind, and one that fails its test is dropped):

* ``email``  local part, ``@``, dotted domain
* ``ip``     four dotted numbers, each at most 255
* ``card``   14 to 19 digits with single blanks or hyphens, Luhn
* ``phone``  ``+`` and 10 to 15 digits

Further kinds: ``iban`` (ISO 13616 layout, mod-97), ``ssn`` (3-2-4 digits; no
checksum exists, so context must vouch for it), ``secret`` (a hex or base64 value of 24
characters or more; likewise) and ``key`` (keys whose public layout names them).  They need a score of ``THRESHOLD``; base spans stay
whatever their score is.

Each span has a score in 0..1: the kind's prior, raised by a context word of
the kind within ``REACH`` characters before it, lowered by a word that speaks
against it (an order number, a version, an example).

Defined results: a null or empty text has no spans; positions are code points,
ends exclusive; very long texts are read whole, in linear time; repeated rows
give repeated rows; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import chunks

# The base kinds in the order in which ties are listed, then the further ones.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret", "key")
THRESHOLD = 0.5
REACH = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}(?![A-Za-z0-9+/_-])")
# Public layouts of keys that name themselves (cloud access key, code host tokens, chat tokens, signed web token, private key block).
_KEY = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r"|-----BEGIN (?:[A-Z]{2,9} )?PRIVATE KEY-----)(?![A-Za-z0-9_])"
)
_DIGIT = re.compile(r"[^0-9]")

# Prior score of each kind, words that speak for it and words that speak against any kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "secret": 0.3, "key": 0.9}
FOR = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security", "taxpayer"),
    "secret": ("token", "secret", "key", "password", "passwd", "credential", "bearer", "authorization"),
    "key": ("token", "secret", "key", "password", "passwd", "credential", "bearer", "authorization"),
}
AGAINST = ("order", "version", "example", "invoice", "isbn", "part no")
_FOR = {k: re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, v)) + ")") for k, v in FOR.items()}
_AGAINST = re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, AGAINST)) + ")")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    bare = iban.replace(" ", "")
    if not 15 <= len(bare) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match holds one ``@`` and starts where the run of local characters before it does."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        done = max(done, at + 1)
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Of dotted numbers, each four in turn are a match."""
    for found in _DOTTED.finditer(text):
        parts = found[0].split(".")
        at = found.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def _plain(text: str, digits: bool) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for start, stop in _emails(text):
            yield "email", start, stop
    if not digits:
        return
    for start, stop in _ips(text):
        yield "ip", start, stop
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(bare := _DIGIT.sub("", m[0])) <= 19 and luhn(bare):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.sub("", m[0])) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", *m.span()
    for m in _SSN.finditer(text):
        yield "ssn", *m.span()
    for m in _SECRET.finditer(text):
        yield "secret", *m.span()
    for m in _KEY.finditer(text):
        yield "key", *m.span()


def spans(text: str, digits: bool = True) -> list[tuple[str, int, int, float]]:
    """(kind, start, stop, score) by start, then kind.  ``digits``: whether the text holds an ASCII digit."""
    out = []
    for kind, start, stop in _plain(text, digits):
        near = text[max(0, start - REACH) : start].lower()
        score = PRIOR[kind] + 0.3 * bool(_FOR[kind].search(near)) - 0.2 * bool(_AGAINST.search(near))
        score = round(min(1.0, max(0.0, score)), 2)
        if kind in BASE or score >= THRESHOLD:
            out.append((kind, start, stop, score))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("stop", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for chunk in chunks(batch):
            data = chunk.data
            digit = (data - np.uint8(48)) < 10
            # texts without digit or @ hold nothing; their bytes are never decoded
            count = np.add.reduceat(np.concatenate((digit, [False])), np.minimum(chunk.offsets[:-1], len(data)), dtype=np.int64) if len(chunk) else []
            ats = np.searchsorted(chunk.offsets, np.flatnonzero(data == 64), "right") - 1
            empty = np.diff(chunk.offsets) == 0
            for i in np.union1d(np.flatnonzero((count > 0) & ~empty), ats):
                text = chunk.text(i).decode("utf-8", "replace")
                found[chunk.rows.start + i] = [
                    {"kind": k, "start": a, "stop": b, "score": s} for k, a, b, s in spans(text, bool(count[i]))
                ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], ["id", "spans"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and its spans, array<struct<kind, start, stop, score>>."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("spans", T.ArrayType(SPAN))])
    return rows.mapInArrow(_scan, schema).withColumnRenamed("id", id_col)


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind and of all spans, digest of the base spans and all spans as text, from ``find_personal_data``."""

    def joined(only_base: bool):
        kept = F.filter("spans", lambda s: s["kind"].isin(*BASE)) if only_base else F.col("spans")
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        id_col,
        *map(count, BASE),
        F.sha2(joined(True), 256).alias("base_sha256"),
        joined(False).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
        F.size("spans").cast("long").alias("n_spans"),
    )
