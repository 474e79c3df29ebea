"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The vocabulary comes from a model file whose path is a parameter; it is read on
the driver, and the tables made from it (some 32,000 pieces, whatever the input)
travel with the function, so executors need no file.

Encoding.  Blanks become ``▁`` and one is put before the text.  No piece holds a
``▁`` behind another character, so a run of ``▁`` and what follows it up to the
next run merge on their own: a *segment*.  The distinct segments of a chunk that
are not yet known become flat symbol arrays.  Each round looks up the rank of
every neighbouring pair, takes the least per segment, merges its places from the
left, and compacts; segments without a pair leave.  Where the merged piece is
part of a piece of the same or better rank (``unsafe``), merging all its places
at once could differ from merging one at a time, so only the leftmost is merged.
Characters outside the vocabulary become byte pieces.

Decoding joins the bytes of the pieces, turns ``▁`` into blanks, drops the blank
put before the text and control ids.

Defined results: a null or empty text has no pieces, only the end id, and decodes
to an empty text; texts are encoded whole; repeated rows repeat; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import BYTES, ROLLERS, Chunk, chunks

MARK = "▁"
NONE = np.iinfo(np.int64).max
#: Segments remembered by a worker; when there are more, it begins anew.
REMEMBER = 500_000


class Vocabulary:
    """Pieces, bytes of each, and the pairs that merge; made once on the driver."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.end = model.eos_id()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        names = [model.id_to_piece(i) for i in range(n)]
        ids = {names[i]: i for i in range(n) if not special[i]}
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        scores = np.array([model.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece holds a blank behind another character; segments would not be independent")
        pairs = {}
        unsafe = np.zeros(n, bool)
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * n + right] = i
                for part in (left, right):
                    if part is not None and rank[i] <= rank[part]:
                        unsafe[part] = True
        self.n, self.rank, self.unsafe = n, rank, unsafe
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        symbols = {ord(p): i for p, i in ids.items() if len(p) == 1}
        self.symbol = np.full(0x110000, -1, np.int32)
        self.symbol[list(symbols)] = list(symbols.values())
        written = [
            b"" if model.is_control(i)
            else bytes([int(names[i][3:5], 16)]) if model.is_byte(i)
            else (" ⁇ " if model.is_unknown(i) else names[i].replace(MARK, " ")).encode()
            for i in range(n)
        ]
        self.bytes = np.frombuffer(b"".join(written), np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(w) for w in written]))).astype(np.int64)
        # the longest piece of blanks: long runs are that piece again and again
        self.widest, self.blank = max(((len(p), i) for p, i in ids.items() if not p.strip(MARK)), default=(1 << 60, -1))

    def merge(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat symbols; ``segment`` does not fall.  Returns pieces and their segments, in order."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols) > 1:
            left, right = symbols[:-1].astype(np.int64), symbols[1:]
            key = left * self.n + right
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (segment[:-1] == segment[1:]) & (left >= 0) & (right >= 0)
            piece = self.merged[at]
            rank = np.append(np.where(hit, self.rank[piece], NONE), NONE)
            begin = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            size = np.diff(np.append(begin, len(segment)))
            least = np.minimum.reduceat(rank, begin)
            over = np.repeat(least == NONE, size)
            if over.any():
                done.append((symbols[over], segment[over]))
            chosen = np.flatnonzero((rank == np.repeat(least, size)) & ~over)
            if not len(chosen):
                symbols, segment = symbols[:0], segment[:0]
                break
            # of neighbours that share a symbol every other one, from the left
            fresh = np.concatenate(([True], np.diff(chosen) != 1))
            offset = np.arange(len(chosen)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            first = np.concatenate(([True], segment[chosen[1:]] != segment[chosen[:-1]]))
            chosen = chosen[((offset % 2 == 0) & ~self.unsafe[piece[chosen]]) | first]
            symbols[chosen] = piece[chosen]
            keep = ~over
            keep[chosen + 1] = False
            symbols, segment = symbols[keep], segment[keep]
        done.append((symbols, segment))
        symbols, segment = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(segment, kind="stable")
        return symbols[order], segment[order]

    def segments(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of segments (blanks, then others), flat, and how many each has."""
        cut, tail = [], []
        for t in texts:  # a long run of blanks: all but its end is pieces of the longest kind
            blanks = len(t) - len(t.lstrip(b" "))
            blocks = max(0, (blanks - 32) // self.widest)
            cut.append(blocks)
            tail.append(t[blocks * self.widest :].replace(b" ", MARK.encode()))
        string = b"".join(tail).decode("utf-8", "replace")
        points = np.frombuffer(string.encode("utf-32-le"), np.uint32)
        chars = np.array([len(t) - 2 * t.count(MARK.encode()) for t in tail])  # bytes, a mark as one
        high = np.array([sum(b & 0xC0 == 0x80 for b in t.replace(MARK.encode(), b"")) for t in tail])
        size = chars - high
        segment = np.repeat(np.arange(len(tail)), size)
        symbols = self.symbol[points]
        unknown = symbols < 0
        symbols, segment = self.merge(np.where(unknown, -1 - points.astype(np.int64), symbols), segment)
        lost = np.flatnonzero(symbols < 0)
        if len(lost):
            spelled = [np.frombuffer(chr(-1 - s).encode(), np.uint8) for s in symbols[lost].tolist()]
            width = np.ones(len(symbols), np.int64)
            width[lost] = [len(s) for s in spelled]
            out = np.repeat(symbols, width)
            out[np.repeat(symbols < 0, width)] = self.byte[np.concatenate(spelled)]
            symbols, segment = out, np.repeat(segment, width)
        count = np.bincount(segment, minlength=len(tail))
        cut = np.array(cut)
        if cut.any():
            ends = np.cumsum(count) - count
            symbols = np.insert(symbols, np.repeat(ends, cut), self.blank)
            count = count + cut
        return symbols.astype(np.int32), count


def _take(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated slices of ``pool``."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(start - (ends - size), size)]


class Encoder:
    """Encodes chunks and remembers the segments it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.start = self.size = np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and offsets; each text ends with the end id."""
        data, offsets = chunk.data, chunk.offsets
        n = len(chunk)
        marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        if len(marks):  # the mark itself in a text is as good as a blank
            data = data.copy()
            data[marks] = 32
            data = np.delete(data, np.concatenate((marks + 1, marks + 2)))
            offsets = offsets - 2 * np.searchsorted(marks, offsets)
        full = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][full], 32)  # the blank before each text
        starts = offsets[:-1] + np.cumsum(full) - full
        blank = data == 32
        first = np.zeros(len(data), bool)
        first[starts[full]] = True
        begin = np.flatnonzero((blank & ~np.concatenate(([False], blank[:-1]))) | first)
        stop = np.append(begin[1:], len(data)) if len(begin) else begin
        hashes = ROLLERS[0].slices(BYTES[0][data], begin, stop)
        unique, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        fresh = ~np.isin(unique, self.known, assume_unique=True)
        if fresh.any():
            if len(self.known) > REMEMBER:
                self.forget()
                fresh[:] = True
            places = sample[fresh]
            ids, count = self.vocabulary.segments([data[a:b].tobytes() for a, b in zip(begin[places], stop[places], strict=True)])
            known = np.concatenate((self.known, unique[fresh]))
            order = np.argsort(known)
            self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(count) - count))[order]
            self.size = np.concatenate((self.size, count))[order]
            self.known, self.pool = known[order], np.concatenate((self.pool, ids))
        where = np.searchsorted(self.known, unique)[inverse]
        sizes = self.size[where]
        flat = _take(self.pool, self.start[where], sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(begin, np.append(starts, len(data)))]
        flat = np.insert(flat, ends[1:], self.vocabulary.end)
        return flat, ends + np.arange(n + 1)


def decode(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the decoded texts, flat, and their offsets."""
    sizes = (vocabulary.at[1:] - vocabulary.at[:-1])[ids]
    flat = _take(vocabulary.bytes, vocabulary.at[ids], sizes)
    ends = np.concatenate(([0], np.cumsum(sizes)))[offsets]
    begins = ends[:-1][np.diff(ends) > 0]
    led = begins[flat[begins] == 32]
    drop = np.zeros(len(flat) + 1, np.int64)
    drop[led + 1] = 1
    keep = np.ones(len(flat), bool)
    keep[led] = False
    return flat[keep], ends - np.cumsum(drop)[ends]


def _round_trip(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for chunk in chunks(batch):
                ids, offsets = encoder.encode(chunk)
                text, bounds = decode(vocabulary, ids, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[chunk.rows.start : chunk.rows.stop],
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                        pa.StringArray.from_buffers(
                            len(chunk), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))
                        ),
                    ],
                    ["id", "ids", "decoded"],
                )

    return run


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, piece ids with the end id (``ids``), and the text they decode to (``decoded``)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
        ]
    )
    return rows.mapInArrow(_round_trip(Vocabulary(model_path)), schema).withColumnRenamed("id", id_col)


def digest_columns(encoded: DataFrame, id_col: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    return encoded.select(
        id_col,
        *extra,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
