"""Words of a batch of texts, found and hashed in its bytes without a Python object for each.

A word is a run of bytes that a table of 256 does not call separators, known by a 64-bit
hash of its bytes with A-Z lower-cased.  Texts are hashed some 64 KB at a time, a longer one
in parts, so that the working memory is small and only the words' places grow with a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that are hashed at once; one word may have more.
BYTES = 1 << 16
#: Seed of Spark's xxhash64, by which a text is known there and here.
SEED = 42

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)
#: White space: space and the controls 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(32))) * _M1
    x = (x ^ (x >> _U(29))) * _M2
    return x ^ (x >> _U(32))


def _codes() -> np.ndarray:
    codes = mixed(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
    codes[65:91] = codes[97:123]
    return codes


_CODES = _codes()


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = pow(_BASE, -1, 1 << 64)
_UP, _DOWN = powers(_BASE, BYTES + 1), powers(_INVERSE, BYTES + 1)
#: Multipliers of the words of a run, by place.
PLACES = powers(int(_M2), 256)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def text_hash(text: pa.Scalar) -> int:
    """Spark's ``xxhash64`` of a text that is not null."""
    return signed(xxhash.xxh64_intdigest(text.as_buffer(), SEED))


def words(data: np.ndarray, separates: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and hash of each word; ``data`` must not end within a word that goes on."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    edge = np.empty(n + 1, dtype=bool)
    space = separates[data]
    edge[0], edge[n] = not space[0], not space[-1]
    np.not_equal(space[1:], space[:-1], out=edge[1:n])
    at = np.flatnonzero(edge)
    start, end = at[::2], at[1::2]
    up, down = (_UP, _DOWN) if n <= BYTES else (powers(_BASE, n + 1), powers(_INVERSE, n + 1))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_CODES[data] * up[:n], out=sums[1:])
    return start, end, mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


#: Bytes of a word that are hashed in numpy, eight at a time, and what keeps the first bytes of eight.
SHORT = 64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def numbered(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start (bytes) and a 64-bit hash of each run of bytes other than white space."""
    n = len(data)
    raw = np.frombuffer(data + bytes(SHORT), dtype=np.uint8)
    edge = np.zeros(n + 1, dtype=bool)
    if n:
        space = SPACE[raw[:n]]
        edge[0], edge[n] = not space[0], not space[-1]
        np.not_equal(space[1:], space[:-1], out=edge[1:n])
    at = np.flatnonzero(edge)
    start, length = at[::2], at[1::2] - at[::2]
    eight = np.ndarray((n + SHORT - 7,), dtype="<u8", buffer=raw, strides=(1,))
    out = mixed((eight[start] & _FIRST[np.minimum(length, 8)]) * _U(_BASE) + length.astype(np.uint64))
    long = np.flatnonzero(length > 8)
    for k in range(8, SHORT, 8):
        if not len(long):
            break
        part = eight[start[long] + k] & _FIRST[np.minimum(length[long] - k, 8)]
        out[long] = mixed((out[long] ^ part) * _U(_BASE) + _U(k))
        long = long[length[long] > k + 8]
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + length[i]], SEED)
    return start, out


def _pieces(data: np.ndarray, separates: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of at most ``BYTES`` that end at a separator (longer where a single word is)."""
    at = 0
    while at < len(data):
        end = min(len(data), at + BYTES)
        if end < len(data) and not separates[data[end]]:
            back = np.flatnonzero(separates[data[at:end]][::-1])
            if len(back):
                end -= int(back[0])
            else:
                on = np.flatnonzero(separates[data[end:]])
                end = end + int(on[0]) if len(on) else len(data)
        yield at, end
        at = end


class Words:
    """The words of some texts in a row.

    Arrays by word: ``start``, ``end`` (bytes in ``data``), ``hash``.  ``begin[i]`` to
    ``begin[i + 1]`` are the words of text ``i``, ``offsets`` its bytes.  A space separates.
    """

    def __init__(self, texts: pa.Array, separates: np.ndarray = SPACE):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if len(texts) else None
        self.data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.texts = texts
        self._words(separates)

    def _words(self, separates: np.ndarray) -> None:
        parts: list[tuple[np.ndarray, ...]] = []
        at, last = 0, len(self.offsets) - 1
        # Whole texts together up to BYTES, a longer one alone; no word reaches over a text's end.
        while at < last:
            to = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + BYTES, side="right")) - 1)
            low, high = int(self.offsets[at]), int(self.offsets[to])
            if to == at + 1:
                for a, b in _pieces(self.data[low:high], separates):
                    start, end, h = words(self.data[low + a : low + b], separates)
                    parts.append((start + (low + a), end + (low + a), h))
            else:
                # A text's end cuts a word: a space is put between texts.
                inner = self.offsets[at + 1 : to]
                gap = np.arange(1, to - at)
                spaced = np.insert(self.data[low:high], inner - low, np.uint8(32))
                start, end, h = words(spaced, separates)
                shift = np.searchsorted(inner - low + gap, start, side="right")
                parts.append((start - shift + low, end - shift + low, h))
            at = to
        self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
        self.begin = np.searchsorted(self.start, self.offsets)

    def characters(self, text: int) -> np.ndarray:
        """How many characters of a text are before each of its bytes."""
        data = self.data[self.offsets[text] : self.offsets[text + 1]]
        return np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])

    def spell(self, first: int, count: int) -> bytes:
        """Some words as they are in a text, lower-cased."""
        return self.data[self.start[first] : self.end[first + count - 1]].tobytes().lower()


def parsed(batches: Iterator[pa.RecordBatch], text_column: int, kind: Callable, size: int = 4 * BYTES) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of batches of about ``size`` bytes of text (one text may have more), with what ``kind`` makes of the texts; null ones count as empty."""
    for batch in batches:
        column = batch.column(text_column)
        if not len(column):
            continue
        if column.null_count:
            column = column.fill_null("")
        lengths = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1])
        part = (np.cumsum(lengths.astype(np.int64)) - lengths) // size
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a), kind(column.slice(a, b - a))
