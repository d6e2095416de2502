"""Paragraphs of a batch of texts, by the hashes of their words (:mod:`.words`).

Every place between two words may end a paragraph.  Each place has a number, smaller where the word before it ends a sentence or
a line, and else a hash of the words beside it.  A sentence or line ends a paragraph if no
other within ``NEAR`` words has a smaller number; a place inside a sentence does if no
other within ``FAR`` words has, so that long stretches without punctuation are cut too.
Nothing else decides, so a passage is cut alike wherever it stands, but for the words near
its ends.  Paragraphs have more than ``NEAR`` words, and a text of fewer is left out.

Only words that repeat with a short period have no least number (equal places in a row);
what gets longer than ``LONGEST`` words of them is cut every ``LONGEST`` words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import PLACES, Words, mixed, powers

#: Words without a cut on each side of a cut at a sentence or line end, and of a cut inside a sentence.
NEAR, FAR = 7, 8
LONGEST = 64
SHINGLE = 5

_U = np.uint64
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True
_INSIDE, _END = _U(2) << _U(62), _U(1) << _U(62)
_BESIDE = powers(0xFF51AFD7ED558CCD, 2)[1]


def least(values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of the ``reach`` values before each, and of those after (nothing there: the largest number)."""
    n = len(values)
    most = np.iinfo(values.dtype).max
    run = np.concatenate([np.full(reach, most, values.dtype), values, np.full(reach, most, values.dtype)])
    # run[i] becomes the least of the next ``width`` values.
    width = 1
    while width * 2 <= reach:
        run[: len(run) - width] = np.minimum(run[: len(run) - width], run[width:])
        width *= 2
    if width < reach:
        run[: len(run) - reach + width] = np.minimum(run[: len(run) - reach + width], run[reach - width :])
    return run[:n], run[reach + 1 : reach + 1 + n]


class Parsed(Words):
    """The words and paragraphs of some texts in a row.

    By paragraph: ``first``, ``count`` (words), ``text`` (which text), ``content`` (a hash of its words).
    """

    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        self._paragraphs()

    def _cuts(self) -> np.ndarray:
        """Whether a paragraph ends after each word."""
        n = len(self.hash)
        h = self.hash
        after = np.append(h[1:], _U(0))
        value = mixed(h * _BESIDE + after) >> _U(2)
        last = self.data[self.end - 1]
        before = self.data[np.maximum(self.end - 2, 0)]
        ends = _STOP[last] & ~_STOP[before] & (self.end - self.start > 1)
        lines = np.flatnonzero(self.data == 10)
        follows = np.searchsorted(self.start, lines)
        ends[follows[follows > 0] - 1] = True
        # The ends of texts are least of all.
        close = np.unique(self.begin[1:][self.begin[1:] > self.begin[:-1]]) - 1
        value |= np.where(ends, _END, _INSIDE)
        value[close] = 0
        # The start of the first text has no place before it: one is put there.
        near = np.where(value < _INSIDE, value, np.iinfo(np.uint64).max)
        near = np.concatenate([np.zeros(1, np.uint64), near])
        left, right = least(near, NEAR)
        cut = ends & (near[1:] < left[1:]) & (near[1:] <= right[1:])
        every = np.concatenate([np.zeros(1, np.uint64), value])
        left, right = least(every, FAR)
        cut |= ~ends & (value < left[1:]) & (value <= right[1:])
        cut[close] = True
        at = np.flatnonzero(cut)
        gaps = np.diff(at, prepend=-1)
        for k in np.flatnonzero(gaps > LONGEST).tolist():
            low = int(at[k] - gaps[k])
            cut[np.arange(low + LONGEST, int(at[k]) - NEAR, LONGEST)] = True
        return cut

    def _paragraphs(self) -> None:
        stop = np.flatnonzero(self._cuts()) + 1 if len(self.hash) else np.empty(0, np.int64)
        first = np.concatenate([np.zeros(min(1, len(stop)), np.int64), stop[:-1]])
        enough = stop - first > NEAR
        self.first, self.count = first[enough], (stop - first)[enough]
        self.text = np.searchsorted(self.begin, self.first, side="right") - 1
        place = np.arange(len(self.hash)) - np.repeat(first, stop - first) if len(stop) else np.empty(0, np.int64)
        sums = np.add.reduceat(self.hash * PLACES[place], first) if len(stop) else np.empty(0, np.uint64)
        self.content = mixed(sums[enough] + self.count.astype(np.uint64))

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``SHINGLE`` words inside paragraphs, and where each paragraph's start."""
        s = np.zeros(max(0, len(self.hash) - SHINGLE + 1), dtype=np.uint64)
        for j in range(SHINGLE):
            s += self.hash[j : j + len(s)] * PLACES[j + 1]
        counts = self.count - (SHINGLE - 1)
        starts = np.cumsum(counts) - counts
        return s[np.repeat(self.first - starts, counts) + np.arange(int(counts.sum()))], starts
