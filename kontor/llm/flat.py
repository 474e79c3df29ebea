"""Flat numpy views of text columns, shared by the text operators.

An Arrow string column is already one byte buffer plus offsets.  The helpers
here cut record batches into chunks of bounded size and compute word
boundaries and rolling hashes for a whole chunk at once, so no operator loops
over words in Python.  All hashes are fixed functions of the bytes: the same
word or window has the same hash in every task, run and table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0x632BE59BD9B4E019 % 2**64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Breaks between words of letters and digits; every byte of a character beyond ASCII counts as a letter.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False


class Roller:
    """Polynomial hashes, modulo 2**64, of slices of a sequence of 64-bit values."""

    def __init__(self, seed: int):
        self.base = int(seeded(1, seed)[0]) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def _powers(self, n: int) -> None:
        if len(self.up) >= n:
            return
        size = max(n, 1 << 16)
        for name, base in (("up", self.base), ("down", self.inverse)):
            out = np.full(size, base, U)
            out[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(out, out=out)
            setattr(self, name, out)

    def slices(self, values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of ``values[start:stop]`` for each pair."""
        self._powers(len(values) + 1)
        with np.errstate(over="ignore"):
            total = np.empty(len(values) + 1, U)
            total[0] = 0
            np.cumsum(values * self.up[: len(values)], out=total[1:])
            return mix((total[stop] - total[start]) * self.down[start] + (stop - start).astype(U))

    def windows(self, values: np.ndarray, k: int) -> np.ndarray:
        """Hash of each run of ``k`` values; empty where there are fewer."""
        n = len(values) - k + 1
        if n <= 0:
            return np.empty(0, U)
        self._powers(len(values) + 1)
        with np.errstate(over="ignore"):
            total = np.empty(len(values) + 1, U)
            total[0] = 0
            np.cumsum(values * self.up[: len(values)], out=total[1:])
            return mix((total[k:] - total[:-k]) * self.down[:n])


BYTES = (seeded(256, 1), seeded(256, 2))
ROLLERS = (Roller(11), Roller(12))


class Chunk:
    """Some whole texts: ``data`` holds their bytes, ``offsets`` where each begins; ``rows`` is their slice of the batch."""

    def __init__(self, rows: slice, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, lower: bool = False, seed: int = 0, breaks: np.ndarray | None = None) -> Words:
        return Words(self, lower, seed, breaks)


class Words:
    """The words of a chunk: byte bounds, text number and hash of each; ``first[i]:first[i+1]`` are those of text i.

    ``breaks`` tells which bytes stand between words; without it words are ``[^\\x20\\x09-\\x0D]+``.
    """

    def __init__(self, chunk: Chunk, lower: bool, seed: int, breaks: np.ndarray | None = None):
        data, offsets = chunk.data, chunk.offsets
        space = (_SPACE if breaks is None else breaks)[data]
        edge = np.ones(len(data) + 1, bool)
        if len(data):
            edge[1:-1] = False
            edge[offsets] = True
            before = np.concatenate(([True], space[:-1])) | edge[:-1]
            after = np.concatenate((space[1:], [True])) | edge[1:]
            self.start = np.flatnonzero(~space & before)
            self.stop = np.flatnonzero(~space & after) + 1
        else:
            self.start = self.stop = np.empty(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.chunk, self.lower = chunk, lower
        self.text = np.repeat(np.arange(len(chunk)), np.diff(self.first))
        self.hash = self.hashes(seed)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int, stop: np.ndarray | None = None) -> np.ndarray:
        """Hash of each word, or of its beginning up to ``stop``."""
        data = _LOWER[self.chunk.data] if self.lower else self.chunk.data
        return ROLLERS[seed].slices(BYTES[seed][data], self.start, self.stop if stop is None else stop)


def _trim():
    """The C library's call that gives freed memory back to the system, or nothing where there is none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def given_back() -> None:
    """Freed buffers go back to the system, so that a worker that is kept for later stages does not hold its peak."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a batch into chunks of about ``limit`` bytes; a longer text is a chunk of its own.  A null text is empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if not n:
        return
    _, where, buffer = texts.buffers()
    bounds = np.frombuffer(where, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Chunk(slice(i, j), data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        i = j
    given_back()


def word_hashes(words: list[str]) -> np.ndarray:
    """The hashes that ``Words`` gives these words."""
    return Chunk(slice(0, 1), *_flat([w.encode() for w in words])).words().hash


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))


def sliding(values: np.ndarray, width: int, ufunc: np.ufunc) -> np.ndarray:
    """``ufunc`` (minimum or maximum) over each run of ``width`` values."""
    done = 1
    while done * 2 <= width:
        values = ufunc(values[done:], values[:-done])
        done *= 2
    if done < width:
        values = ufunc(values[width - done :], values[: len(values) - (width - done)])
    return values


def anchors(keys: np.ndarray, width: int, usable: np.ndarray) -> np.ndarray:
    """Which keys are the least of some run of ``width`` keys whose start is usable.

    The choice depends on the run alone, so equal runs choose equal places
    wherever they stand.  ``usable`` has one entry for each run.
    """
    if len(usable) == 0:
        return np.zeros(len(keys), bool)
    least = np.where(usable, sliding(keys, width, np.minimum), U(0))
    pad = np.zeros(width - 1, U)
    return sliding(np.concatenate((pad, least, pad)), width, np.maximum) == np.maximum(keys, U(1))


def covered(start: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in some run of ``width`` places that begins at ``start``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + width, n), -1)
    return np.cumsum(step)[:n] > 0


def joined(words: Words, kept: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one blank."""
    data = words.chunk.data.copy()
    number = np.flatnonzero(kept)
    last = np.ones(len(number), bool)
    last[:-1] = words.text[number[1:]] != words.text[number[:-1]]
    size = (words.stop - words.start)[number]
    take = np.zeros(len(data) + 1, np.int8)
    np.add.at(take, words.start[number], 1)
    np.add.at(take, words.stop[number], -1)
    take = np.cumsum(take[:-1], dtype=np.int8) > 0
    gaps = words.stop[number[~last]]  # the white space behind a kept word that is not the last
    data[gaps] = 32
    take[gaps] = True
    ends = np.zeros(len(words.chunk) + 1, np.int64)
    np.add.at(ends, words.text[number] + 1, size + ~last)
    ends = np.cumsum(ends)
    flat = data[take].tobytes()
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
