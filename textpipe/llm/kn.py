"""Interpolated Kneser-Ney n-gram models as sorted hash arrays.

A unit is a number (a code point, or the hash of a word), a gram a run of units with the
polynomial hash ``sum m(u) K^j`` modulo 2^64.  Counting is a Spark aggregation, sharded by
gram and summed in each task before the shuffle; what reaches the driver is the counts of
a bounded sample, whose bound is a parameter of the caller.  From them come, for each
order, a sorted array of hashes with the interpolated log probability in every model, and
one of contexts with the log of their back-off weight.  A gram that was seen is found by
one look-up; only others go down an order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
SLICE = 1 << 18

Units = Callable[[str], np.ndarray]


def padded(units: np.ndarray, order: int) -> np.ndarray:
    """Units with ``order - 1`` zeros before them; real units are never zero."""
    return np.concatenate([np.zeros(order - 1, dtype=np.uint64), units])


def hashes(units: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the gram of each order that ends at each unit (orders 0 to ``order``; short ones at the start are of fewer units)."""
    out = [np.zeros(len(units), dtype=np.uint64)]
    own = (units + np.uint64(1)) * MIX
    for _ in range(order):
        below = np.concatenate([np.zeros(1, dtype=np.uint64), out[-1][:-1]])
        out.append(own + K * below)
    return out


class Sorted:
    """A sorted array of mixed hashes, with the place where each run of equal top bits starts."""

    def __init__(self, h: np.ndarray):
        g = h * K
        self.order = np.argsort(g, kind="stable")
        self.keys = g[self.order]
        bits = max(1, len(h).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.start).max()) if len(h) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the sorted array, or -1."""
        g = h * K
        top = (g >> self.shift).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        out = np.full(len(h), -1, dtype=np.int32)
        live = np.flatnonzero(at < end)
        at, end, g = at[live], end[live], g[live]
        for _ in range(self.longest):
            if not len(live):
                break
            key = self.keys[at]
            hit = key == g
            out[live[hit]] = at[hit]
            more = ~hit & (key < g)
            more &= at + 1 < end
            live, at, end, g = live[more], at[more] + 1, end[more], g[more]
        return out


def count(rows: DataFrame, units: Units, order: int, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams (n x order), model of each and count, of a bounded sample ``model, text``; ``keys`` are the models."""
    place = {k: i for i, k in enumerate(keys)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = units(text)
                if len(found):
                    grams, n = np.unique(np.lib.stride_tricks.sliding_window_view(padded(found, order), order), axis=0, return_counts=True)
                    raw = np.ascontiguousarray(grams).view(f"V{8 * order}").ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), place[model]), pa.int32()), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array(n, pa.int64())], names=["model", "gram", "n"])

    shards = rows.select("model", "text").mapInArrow(run, "model int, gram binary, n long").groupBy("model", "gram").agg(F.sum("n").alias("n"))
    got = shards.toArrow()
    if not got.num_rows:
        return np.empty((0, order), dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    raw = b"".join(got.column("gram").to_pylist())
    return np.frombuffer(raw, dtype=np.uint64).reshape(-1, order), got.column("model").to_numpy().astype(np.int64), got.column("n").to_numpy().astype(np.int64)


#: Held-back documents that a language's limits need; folds in which languages with fewer are scored.
FEW, FOLDS = 5, 5


def left_out(rows: DataFrame, rare: list[str], id_col: str) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For languages of few documents: rows to learn from and rows to score, such that each document is scored once by the others.

    A language with one document has no others and is left out.
    """
    if not rare:
        return
    own = Window.partitionBy("model")
    rows = rows.where(F.col("model").isin(rare)).withColumn("of", F.count("*").over(own)).where("of > 1")
    rows = written(rows.withColumn("fold", F.row_number().over(own.orderBy(F.xxhash64(F.lit("fold"), id_col), "text")) % FOLDS), "folds")
    for k in range(FOLDS):
        yield rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)


def _hash(grams: np.ndarray) -> np.ndarray:
    out = np.zeros(len(grams), dtype=np.uint64)
    for j in range(grams.shape[1]):
        out = out * K + (grams[:, j] + np.uint64(1)) * MIX
    return out


def discounts(counts: np.ndarray, modified: bool) -> np.ndarray:
    """What is taken off a count of 0, 1, 2 and 3 or more."""
    return discounts_of([(counts == k).sum() for k in range(1, 5)], modified)


def discounts_of(few: list[int], modified: bool) -> np.ndarray:
    """The same from how many counts are 1, 2, 3 and 4."""
    n = list(map(float, few))
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    if not modified:
        return np.array([0, y, y, y])
    each = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else y for k in range(1, 4)]
    return np.array([0, *(min(max(d, 0.05), k - 0.05) if k > 1 else min(max(d, 0.05), 0.95) for k, d in enumerate(each, 1))])


class Model:
    """Log probabilities of units in several models at once."""

    def __init__(self, grams: np.ndarray, model: np.ndarray, n: np.ndarray, models: int, order: int, modified: bool):
        self.order, self.models = order, models
        self.tables: list[tuple[Sorted, np.ndarray]] = []
        self.contexts: list[tuple[Sorted, np.ndarray]] = []
        # From the highest order down: grams, their model and count; a lower order counts the distinct units to the left.
        levels = {order: (grams, model, n)}
        for k in range(order - 1, 0, -1):
            above, m, _ = levels[k + 1]
            both = np.column_stack([m.astype(np.uint64), above[:, 1:]])
            distinct, c = np.unique(both, axis=0, return_counts=True)
            levels[k] = distinct[:, 1:], distinct[:, 0].astype(np.int64), c
        units = len(np.unique(levels[1][0])) if len(grams) else 0
        self.unknown = -np.log(units + 1.0)
        below: np.ndarray | None = None
        below_at: Sorted | None = None
        for k in range(1, order + 1):
            g, m, c = levels[k]
            d = np.stack([discounts(c[m == i], modified) for i in range(models)]) if models else np.zeros((0, 4))
            h, first, inverse = np.unique(_hash(g), return_index=True, return_inverse=True)
            at = Sorted(h)
            ctx, ctx_of = np.unique(_hash(g[:, :-1]) if k > 1 else np.zeros(len(g), dtype=np.uint64), return_inverse=True)
            total = np.zeros((len(ctx), models))
            np.add.at(total, (ctx_of, m), c)
            taken = d[m, np.minimum(c, 3)]
            lost = np.zeros((len(ctx), models))
            np.add.at(lost, (ctx_of, m), taken)
            weight = np.where(total > 0, lost / np.maximum(total, 1), 1.0)
            p = np.zeros((len(h), models))
            p[inverse, m] = (c - taken) / total[ctx_of, m]
            lower = np.full((len(h), models), 1.0 / (units + 1.0))
            if below_at is not None:
                # Any gram's suffix was counted, so it is found; rows are in sorted order.
                lower = np.exp(below[below_at.find(_hash(g[first][:, 1:]))])
            p += weight[ctx_of[first]] * lower
            below, below_at = np.log(p)[at.order], at
            self.tables.append((at, below.astype(np.float32)))
            where = Sorted(ctx)
            self.contexts.append((where, np.log(weight)[where.order].astype(np.float32)))
        for at, _ in [*self.tables, *self.contexts]:
            del at.order

    def score(self, units: np.ndarray) -> np.ndarray:
        """Sum of the log probabilities of a text's units, in each model; memory does not grow with the text."""
        out = np.zeros(self.models)
        stream = padded(units, self.order)
        for at in range(self.order - 1, len(stream), SLICE):
            out += self._logs(stream[at - self.order + 1 : at + SLICE]).sum(axis=0, dtype=np.float64)
        return out

    def score_many(self, texts: list[np.ndarray]) -> np.ndarray:
        """One row of :meth:`score` for each text; short ones are looked up together."""
        out, held, size = np.zeros((len(texts), self.models)), [], 0

        def flush() -> None:
            nonlocal size
            if held:
                each = [padded(texts[i], self.order) for i in held]
                ends = np.cumsum([len(x) for x in each])
                logs = self._logs(np.concatenate(each), whole=True)
                starts = np.concatenate([[0], ends[:-1]])
                pads = (starts[:, None] + np.arange(self.order - 1)).ravel()
                logs[pads] = 0
                out[held] = np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
            held.clear()
            size = 0

        for i, x in enumerate(texts):
            if len(x) > SLICE:
                out[i] = self.score(x)
            elif len(x):
                held.append(i)
                size += len(x)
                if size >= SLICE:
                    flush()
        flush()
        return out

    def _logs(self, stream: np.ndarray, whole: bool = False) -> np.ndarray:
        """Log probability of each unit of a padded stream (all but the first ``order - 1``, unless ``whole``)."""
        h = hashes(stream, self.order)
        skip = 0 if whole else self.order - 1
        out = np.zeros((len(stream) - skip, self.models), dtype=np.float32)
        todo = np.arange(skip, len(stream))
        for k in range(self.order, 0, -1):
            table, logs = self.tables[k - 1]
            found = table.find(h[k][todo])
            hit = found >= 0
            out[todo[hit] - skip] += logs[found[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            where, weights = self.contexts[k - 1]
            before = h[k - 1][np.maximum(todo - 1, 0)] if k > 1 else np.zeros(len(todo), dtype=np.uint64)
            known = where.find(before)
            seen = known >= 0
            out[todo[seen] - skip] += weights[known[seen]]
        out[todo - skip] += np.float32(self.unknown)
        return out


#: Bytes of a text from which models learn at most; longer ones are no part of a sample, which bounds it in bytes too.
MAX_BYTES = 1 << 18


def sample(rows: DataFrame, model: str, keys: list[str], most: int) -> DataFrame:
    """About ``most`` rows of each model at most, chosen by a hash of the columns ``keys``, equal rows once; whole texts."""
    counts = {r[0]: r[1] for r in rows.groupBy(model).count().toLocalIterator()}
    share = None
    for key, n in counts.items():
        case = F.when(F.col(model) == F.lit(key), F.lit(min(1.0, most / n))) if share is None else share.when(F.col(model) == F.lit(key), F.lit(min(1.0, most / n)))
        share = case
    if share is None:
        return rows.limit(0)
    draw = F.pmod(F.xxhash64(F.lit("sample"), *map(F.col, keys)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(draw < share).dropDuplicates([model, *keys])
