"""Modified Kneser-Ney word trigrams of any number of texts: shards of counts, joined to every document's grams.

A trigram ``u v w`` belongs to the shard of its middle word, where its count, those of its
context ``u v`` and of the pair ``v w`` (distinct words to the left) and of ``v`` are all
found.  What is counted of ``w`` alone (distinct words to the left) is spread over the
shards and summed in the shard of ``w``, which tells the others.  With

    P(w | u v) = a3 + g3 (a2 + g2 P(w)) = A(u v w) + G(u v) P(w)

the logarithm of a text is the sum of log P(w) over its words, which the shards of the words
add up, and of log(A + G P(w)) - log P(w), or log G where the pair was never seen, which
those of the middle words add up.  Only these sums come back to a document; texts are never
exchanged, and each of a chunk's grams goes to one shard as places in a list
of the words that it shares with the others.

Where there is much text, shards take turns: a round reads all texts, but only the grams and
counts of its own shards are exchanged, and they go before the next round's are sent.  All
rounds together exchange every gram and every count once.  What each found is kept by chunk,
and added up before it becomes a row for each document, so that rows do not grow with the
rounds.  Only chunks that a round read in another order than others have rows of their own,
which are added up by the document's id, language and text.

Everything is exact but for 64-bit hashes of words and sums in single precision: all grams
of all texts count, however many there are.  The driver sees a few numbers for each model.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .backoff import _packed, _shard, _unpacked
from .common import parallelism, sliced, written
from .kn import Units, discounts_of

#: Words whose grams a task holds at once, and grams that a shard merges at once.
CHUNK, PENDING = 1 << 21, 1 << 22
#: Rounds in which shards take turns, at most, and bytes of text for each.
ROUNDS, ROUND_BYTES = 5, 1 << 26
#: Bytes of text for each shard on average.
SHARD_BYTES = 1 << 24
COUNTS, REPLY, TABLE, GRAMS, WORDS, HEAD, STATS = range(7)
_ROW = "kind byte, shard int, chunk long, a binary, b binary, c binary, d binary"


def _row(kind: int, shard: int, chunk: int, *parts: bytes) -> list[pa.Array]:
    blobs = [*parts, *[None] * (4 - len(parts))]
    return [pa.array([kind], pa.int8()), pa.array([shard], pa.int32()), pa.array([chunk], pa.int64()), *[pa.array([x], pa.binary()) for x in blobs]]


_NAMES = ["kind", "shard", "chunk", "a", "b", "c", "d"]


def _batch(*row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(_row(*row), names=_NAMES)


def _places(data: bytes) -> np.ndarray:
    return _unpacked(data).astype(np.int64)


def _slots(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data).astype(np.int64))


def _ascending(words: np.ndarray) -> bytes:
    return _packed(np.diff(words, prepend=np.uint64(0)))


def _dictionary(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _numbers(units: Units, texts: list[str | None]) -> list[np.ndarray]:
    """The units of each text, in one call where they have one for many."""
    many = getattr(units, "many", None)
    return many(texts) if many else [units(x) for x in texts]


def _turns(shards: int, rounds: int) -> list[range]:
    """The shards of each round."""
    edges = [shards * k // rounds for k in range(rounds + 1)]
    return [range(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def _grams(texts: list[np.ndarray], slots: np.ndarray, shards: int, turn: range) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """For each shard of the turn its words, the places in them of all u, all v and all w, and the slot of each gram."""
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    slot = np.repeat(slots, lengths)
    at = np.arange(len(slot)) + 2 * np.repeat(np.arange(1, len(texts) + 1), lengths)
    # Two zeros before each text.
    stream = np.zeros(len(at) + 2 * len(texts), dtype=np.uint64)
    stream[at] = np.concatenate(texts)
    shard = _shard(stream[at - 1], shards).astype(np.int64)
    if len(turn) < shards:
        now = np.flatnonzero((shard >= turn.start) & (shard < turn.stop))
        at, slot, shard = at[now], slot[now], shard[now]
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(turn.start, turn.stop + 1))
    for i in np.flatnonzero(np.diff(edges)).tolist():
        mine = order[edges[i] : edges[i + 1]]
        w = at[mine]
        words, inverse = np.unique(np.concatenate([stream[w - 2], stream[w - 1], stream[w]]), return_inverse=True)
        yield turn.start + i, _ascending(words), _packed(inverse), _packed(np.diff(slot[mine], prepend=0))


def _merged(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Model, v, u, w and count: sorted, equal ones summed."""
    m, v, u, w, c = columns
    order = np.lexsort((w, u, v, m))
    m, v, u, w, c = (x[order] for x in (m, v, u, w, c))
    new = np.ones(len(m), dtype=bool)
    new[1:] = (m[1:] != m[:-1]) | (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    starts = np.flatnonzero(new)
    return [m[starts], v[starts], u[starts], w[starts], np.add.reduceat(c, starts) if len(c) else c]


def _few(model: np.ndarray, counts: np.ndarray, models: int) -> np.ndarray:
    """How many grams of each model were counted once, twice, three and four times."""
    low = counts <= 4
    return np.bincount(model[low] * 4 + counts[low] - 1, minlength=4 * models).reshape(models, 4)


def _pairs(m: np.ndarray, v: np.ndarray, w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Model, v, w of each distinct pair, and its count."""
    key, n = np.unique((m * size + v) * size + w, return_counts=True)
    rest, w = np.divmod(key, size)
    m, v = np.divmod(rest, size)
    return m, v, w, n


class Counts:
    """What :func:`learn` counted, in tables by shard, and the few numbers of each model that all shards need."""

    def __init__(self, shards: int, models: int, tables: list[DataFrame], words: DataFrame):
        self.shards, self.models, self.units, self.tables = shards, models, 0, [*tables, words]
        counts = reduce(DataFrame.unionByName, tables)
        high, low = np.zeros((2, models, 4), dtype=np.int64), np.zeros((models, 6), dtype=np.int64)
        for r in counts.where(F.col("kind") == STATS).select("a").toLocalIterator():
            high += np.frombuffer(r.a, dtype=np.int64).reshape(high.shape)
        for r in words.where(F.col("kind") == STATS).select("a", "chunk").toLocalIterator():
            low += np.frombuffer(r.a, dtype=np.int64).reshape(low.shape)
            self.units += r.chunk
        self.d1, self.d2, self.d3 = (np.array([discounts_of(n, True) for n in each.tolist()]).reshape(models, 4) for each in (low[:, :4], high[0], high[1]))
        self.total = low[:, 5]
        lost = self.d1[:, 1] * low[:, 0] + self.d1[:, 2] * low[:, 1] + self.d1[:, 3] * low[:, 4]
        self.lost = np.where(self.total > 0, lost / np.maximum(self.total, 1), 1.0)
        self.rows = counts.where(F.col("kind") == COUNTS).unionByName(words.where(F.col("kind").isin(REPLY, TABLE)))

    def numbers(self) -> dict[str, object]:
        return {k: v for k, v in vars(self).items() if k not in ("rows", "tables")}


def _unigram(by: dict, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Probability in models ``m`` of words with ``n`` distinct words to their left."""
    return (n - by["d1"][m, np.minimum(n, 3)]) / np.maximum(by["total"][m], 1) + by["lost"][m] / (by["units"] + 1.0)


def learn(rows: DataFrame, units: Units, names: list[str], shards: int, rounds: int = 1) -> Counts:
    """Counts of all rows ``model, text``; ``names`` are the models."""
    place, models = {k: i for i, k in enumerate(names)}, len(names)

    def send(turn: range, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for s, *parts in _grams(held, np.array(of), shards, turn):
                yield _batch(GRAMS, s, 0, *parts)

        for batch in sliced(batches):
            for model, found in zip(batch.column(0).to_pylist(), _numbers(units, batch.column(1).to_pylist())):
                if len(found):
                    held.append(found), of.append(place[model])
                    size += len(found)
                if size >= CHUNK:
                    yield from flush()
                    held, of, size = [], [], 0
        if held:
            yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, pending, shard = [], 0, None
        for batch in batches:
            for shard, a, b, c in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4, 5))):  # noqa: B007
                u, v, w = _dictionary(a)[_places(b)].reshape(3, -1)
                parts.append([_slots(c), v, u, w, np.ones(len(u), dtype=np.int64)])
                pending += len(u)
                if pending >= PENDING:
                    parts = [_merged([np.concatenate(x) for x in zip(*parts)])]
                    pending = 0
        if shard is None:
            return
        m, v, u, w, c = _merged([np.concatenate(x) for x in zip(*parts)])
        vocabulary = np.unique(np.concatenate([u, v, w]))
        u, v, w = (np.searchsorted(vocabulary, x) for x in (u, v, w))
        pm, _, pw, n = _pairs(m, v, w, len(vocabulary))
        yield _batch(COUNTS, shard, 0, _ascending(vocabulary), _ascending(((m * len(vocabulary) + v) * len(vocabulary) + u).astype(np.uint64)), _packed(w), _packed(c))
        yield _batch(STATS, shard, 0, np.stack([_few(pm, n, models), _few(m, c, models)]).astype(np.int64).tobytes())
        # Distinct words to the left of each word, of those in this shard.
        known, at = np.unique(pw, return_inverse=True)
        left = np.bincount(pm * len(known) + at, minlength=models * len(known)).reshape(models, -1)
        known = vocabulary[known]
        edges = np.searchsorted(_shard(known, shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            mine = slice(edges[s], edges[s + 1])
            yield _batch(WORDS, s, shard, _ascending(known[mine]), _packed(left[:, mine].ravel()))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, shard = [], None
        for batch in batches:
            for shard, of, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):  # noqa: B007
                got.append((of, _dictionary(a), _places(b).reshape(models, -1)))
        if shard is None:
            return
        words, at = np.unique(np.concatenate([x for _, x, _ in got]), return_inverse=True)
        n = np.stack([np.bincount(at, weights=w, minlength=len(words)) for w in np.concatenate([x for *_, x in got], axis=1)]).astype(np.int64)
        start = 0
        for of, x, _ in got:
            yield _batch(REPLY, of, shard, None, _packed(n[:, at[start : start + len(x)]].ravel()))
            start += len(x)
        yield _batch(TABLE, shard, 0, _ascending(words), _packed(n.ravel()))
        m, w = np.nonzero(n)
        few = _few(m, n[m, w], models)
        yield _batch(STATS, shard, len(words), np.column_stack([few, (n >= 3).sum(axis=1), n.sum(axis=1)]).astype(np.int64).tobytes())

    tables = []
    for turn in _turns(shards, rounds):
        grams = rows.select("model", "text").mapInArrow(partial(send, turn), _ROW)
        tables.append(passing(grams.repartitionById(len(turn), F.col("shard") - turn.start).mapInArrow(count, _ROW), "gram-counts"))
    words = passing(reduce(DataFrame.unionByName, tables).where(F.col("kind") == WORDS).repartitionById(shards, F.col("shard")).mapInArrow(tell, _ROW), "word-counts")
    return Counts(shards, models, tables, words)


def _find(keys: np.ndarray, wanted: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Places of the wanted that are live in the sorted keys, or -1."""
    out = np.full(len(wanted), -1, dtype=np.int64)
    if len(keys):
        live = np.flatnonzero(live)
        at = np.minimum(np.searchsorted(keys, wanted[live]), len(keys) - 1)
        hit = keys[at] == wanted[live]
        out[live[hit]] = at[hit]
    return out


def _or(values: np.ndarray, at: np.ndarray, default: float) -> np.ndarray:
    return np.where(at >= 0, values[at], default) if len(values) else np.full(len(at), default)


class Shard:
    """Probabilities of the grams whose middle word belongs here, and of the words that belong here."""

    def __init__(self, by: dict):
        self.by, self.vocabulary, self.words = by, np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.contexts = self.grams = self.pairs = self.middles = np.empty(0, np.int64)
        self.a3 = self.g3 = self.a2 = self.g2 = np.empty(0)
        self.left = np.zeros((by["models"], 0), dtype=np.int64)
        self.n = np.zeros((by["models"], 0), dtype=np.int64)

    def counts(self, a: bytes, b: bytes, c: bytes, d: bytes) -> None:
        by = self.by
        self.vocabulary, w, c = _dictionary(a), _places(c), _places(d)
        size = len(self.vocabulary)
        rest, u = np.divmod(_dictionary(b).astype(np.int64), size)
        m, v = np.divmod(rest, size)
        self.left = np.zeros((by["models"], size), dtype=np.int64)
        self.contexts, at = np.unique((m * size + v) * size + u, return_inverse=True)
        total, taken = np.bincount(at, weights=c), by["d3"][m, np.minimum(c, 3)]
        self.g3 = np.bincount(at, weights=taken) / total
        self.grams = at * size + w
        order = np.argsort(self.grams)
        self.grams, self.a3 = self.grams[order], ((c - taken) / total[at])[order]
        pm, pv, pw, n = _pairs(m, v, w, size)
        self.pairs = (pm * size + pv) * size + pw
        self.asked = np.unique(pw)
        self.edges = np.searchsorted(_shard(self.vocabulary[self.asked], by["shards"]), np.arange(by["shards"] + 1))
        self.middles, at = np.unique(pm * size + pv, return_inverse=True)
        total, taken = np.bincount(at, weights=n), by["d2"][pm, np.minimum(n, 3)]
        self.g2, self.a2 = np.bincount(at, weights=taken) / total, (n - taken) / total[at]

    def reply(self, of: int, b: bytes) -> None:
        """The words asked for, in the order in which they were sent."""
        self.left[:, self.asked[self.edges[of] : self.edges[of + 1]]] = _places(b).reshape(self.by["models"], -1)

    def table(self, a: bytes, b: bytes) -> None:
        self.words, self.n = _dictionary(a), _places(b).reshape(self.by["models"], -1)

    def grams_logs(self, a: bytes, b: bytes, m: np.ndarray) -> np.ndarray:
        """What each gram adds to the logarithm of its last word's own probability."""
        words, size = _dictionary(a), max(1, len(self.vocabulary))
        u, v, w = _find(self.vocabulary, words, np.ones(len(words), dtype=bool))[_places(b)].reshape(3, -1)
        # Neighbours in order look in the same places of the tables.
        order = np.argsort((m * size + v) * size + u)
        m, u, v, w = m[order], u[order], v[order], w[order]
        mv = m * size + v
        g2 = _or(self.g2, _find(self.middles, mv, v >= 0), 1.0)
        a2 = _or(self.a2, _find(self.pairs, mv * size + w, (v >= 0) & (w >= 0)), 0.0)
        context = _find(self.contexts, mv * size + u, (v >= 0) & (u >= 0))
        g3 = _or(self.g3, context, 1.0)
        a3 = _or(self.a3, _find(self.grams, context * size + w, (context >= 0) & (w >= 0)), 0.0)
        above, rest = a3 + g3 * a2, g3 * g2
        out, seen = np.log(rest), above > 0
        p = _unigram(self.by, m[seen], self.left[m[seen], w[seen]])
        out[seen] = np.log(above[seen] + rest[seen] * p) - np.log(p)
        back = np.empty_like(out)
        back[order] = out
        return back

    def word_logs(self, a: bytes, places: np.ndarray, m: np.ndarray) -> np.ndarray:
        words = _dictionary(a)
        at = _find(self.words, words, np.ones(len(words), dtype=bool))[places]
        n = np.where(at >= 0, self.n[m, at], 0) if len(self.words) else np.zeros(len(m), dtype=np.int64)
        return np.log(_unigram(self.by, m, n))


def entropies(docs: DataFrame, units: Units, names: list[str], counts: Counts, rounds: int = 1) -> DataFrame:
    """``doc_id, lang, n_words, model, h`` of each row: cross-entropy by the model of its language, or by the one that fits best where it has none.

    Where there are several rounds they are done at once, one after the other, and nothing reads the counts after them.
    """
    turns = _turns(counts.shards, rounds)
    found = [_sums(docs, units, names, counts, turn) for turn in turns] if len(turns) == 1 else [passing(_sums(docs, units, names, counts, turn), "sums") for turn in turns]
    # Equal rows have equal sums: each copy was in every round.
    own = ["doc_id", "lang", "same", "n_words"]
    each = _by_document(found, counts.shards).groupBy(*own, "model").agg(F.sum("log").alias("log"), (F.sum("rounds") / len(turns)).alias("copies"))
    h = F.when(F.col("model").isNotNull(), -F.col("log") / F.col("copies") / F.col("n_words"))
    best = each.groupBy(*own).agg(F.min(F.struct(h.alias("h"), "model")).alias("best"), F.max(F.col("copies").cast("int")).alias("copies"))
    return best.select("doc_id", "lang", "n_words", F.col("best.model").alias("model"), F.col("best.h").alias("h"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def _by_document(found: list[DataFrame], shards: int) -> DataFrame:
    """``doc_id, lang, same, n_words, model, log, rounds`` of each row and model that scores it, of what :func:`_sums` found in some rounds.

    A chunk that was the same in all rounds has one row for each of its texts, whatever the number of rounds.
    """
    id_type = found[0].schema["ids"].dataType.elementType

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By chunk what its texts were, most often once; with the sums and in how many rounds.
        held: dict[int, list[list]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, of, models, log = (batch.column(j)[i].as_py() for j in range(4))
                head, log = (of, models, *(batch.column(j)[i].values for j in range(4, 8))), np.frombuffer(log, dtype=np.float64)
                mine = held.setdefault(chunk, [])
                for other in mine:
                    if other[0][:2] == head[:2] and all(x.equals(y) for x, y in zip(other[0][2:], head[2:])):
                        other[1], other[2] = other[1] + log, other[2] + 1
                        break
                else:
                    mine.append([head, log, 1])
        for (of, models, ids, langs, same, lengths), log, rounds in (x for mine in held.values() for x in mine):
            # A row for each slot, and one for each text without words.
            of, models, none = _places(of), _places(models), np.flatnonzero(lengths.to_numpy() == 0)
            at, model = pa.array(np.concatenate([of, none])), np.concatenate([models, np.full(len(none), -1)])
            log = np.concatenate([log, np.zeros(len(none))])
            yield pa.RecordBatch.from_arrays([*(x.take(at) for x in (ids, langs, same, lengths)), pa.array(model, pa.int32(), mask=model < 0), pa.array(log), pa.array(np.full(len(log), rounds), pa.int32())], names=["doc_id", "lang", "same", "n_words", "model", "log", "rounds"])

    # A single round has each chunk once.
    chunks = found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).repartition(shards, "chunk")
    return chunks.mapInArrow(spread, f"doc_id {id_type.simpleString()}, lang string, same long, n_words long, model int, log double, rounds int")


def _sums(docs: DataFrame, units: Units, names: list[str], counts: Counts, turn: range) -> DataFrame:
    """``chunk, of, models, log, ids, langs, same, lengths`` of each chunk of rows.

    ``of`` and ``models`` are the text and model of its slots, ``log`` what the turn's shards add to the logarithm of each; ``same`` is a hash of a text.
    """
    place, shards, by = {k: i for i, k in enumerate(names)}, counts.shards, counts.numbers()
    id_type = docs.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)
    heads = {"ids": pa.list_(arrow_id), "langs": pa.list_(pa.string()), "same": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64())}
    listed = f"ids array<{id_type.simpleString()}>, langs array<string>, same array<bigint>, lengths array<bigint>"
    schema = f"{_ROW}, {listed}"

    def full(batch: pa.RecordBatch, *lists) -> pa.RecordBatch:
        lists = lists or [None] * 4
        return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([x], t) for x, t in zip(lists, heads.values())]], names=[*_NAMES, *heads])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk, rows, size = (context.partitionId() if context else 0) << 24, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = [len(x) for *_, x in rows]
            # A text with a model has one slot, another one for each model.
            slots = [(i, k) for i, (_, lang, _, x) in enumerate(rows) if len(x) for k in ([place[lang]] if lang in place else range(len(names)))]
            of, models = np.array([i for i, _ in slots], dtype=np.int64), np.array([k for _, k in slots], dtype=np.int64)
            yield full(_batch(HEAD, turn[chunk % len(turn)], chunk, _packed(of), _packed(models)), *([row[j] for row in rows] for j in range(3)), lengths)
            if not slots:
                return
            texts, told = [rows[i][3] for i in of], _packed(models)
            for s, *parts in _grams(texts, np.arange(len(slots)), shards, turn):
                yield full(_batch(GRAMS, s, chunk, *parts, told))
            words, of = np.concatenate(texts), np.repeat(np.arange(len(slots)), [len(x) for x in texts])
            if len(turn) < shards:
                shard = _shard(words, shards)
                now = np.flatnonzero((shard >= turn.start) & (shard < turn.stop))
                words, of = words[now], of[now]
            vocabulary, code = np.unique(words, return_inverse=True)
            key, n = np.unique(of + code * len(slots), return_counts=True)
            word, slot = np.divmod(key, len(slots))
            owned = np.searchsorted(_shard(vocabulary, shards), np.arange(turn.start, turn.stop + 1))
            edges = np.searchsorted(word, owned)
            for i in np.flatnonzero(np.diff(edges)).tolist():
                mine = slice(edges[i], edges[i + 1])
                entry = np.concatenate([np.diff(word[mine], prepend=owned[i]), np.diff(slot[mine], prepend=0) % len(slots), n[mine]])
                yield full(_batch(WORDS, turn.start + i, chunk, _ascending(vocabulary[owned[i] : owned[i + 1]]), _packed(entry), None, told))

        for batch in sliced(batches):
            for d, lang, same, found in zip(*(c.to_pylist() for c in batch.columns[:3]), _numbers(units, batch.column(3).to_pylist())):
                rows.append((d, lang, same, found))
                size += len(found) * (1 if lang in place else len(names)) + 16
                if size >= CHUNK:
                    yield from flush()
                    chunk, rows, size = chunk + 1, [], 0
        if rows:
            yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(by)
        for batch in batches:
            for i in range(batch.num_rows):
                kind, s, chunk, a, b, c, d = (batch.column(j)[i].as_py() for j in range(7))
                if kind == COUNTS:
                    shard.counts(a, b, c, d)
                elif kind == REPLY:
                    shard.reply(chunk, b)
                elif kind == TABLE:
                    shard.table(a, b)
                elif kind == HEAD:
                    yield batch.slice(i, 1)
                else:
                    models = _places(d)
                    if kind == GRAMS:
                        slot = _slots(c)
                        logs = shard.grams_logs(a, b, models[slot])
                    else:
                        word, slot, n = _places(b).reshape(3, -1)
                        slot = np.cumsum(slot) % len(models)
                        logs = n * shard.word_logs(a, np.cumsum(word), models[slot])
                    sums = np.bincount(slot, weights=logs, minlength=len(models)).astype(np.float32)
                    yield full(_batch(kind, s, chunk, sums.tobytes()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        head = {}
        for batch in batches:
            for i in range(batch.num_rows):
                kind, chunk, a = (batch.column(j)[i].as_py() for j in (0, 2, 3))
                if kind == HEAD:
                    head[chunk] = a, batch.column(4)[i].as_py(), *(batch.column(j)[i].values for j in (7, 8, 9, 10))
                else:
                    more = np.frombuffer(a, dtype=np.float32).astype(np.float64)
                    sums[chunk] = sums[chunk] + more if chunk in sums else more
        for chunk, (of, models, *lists) in head.items():
            # The turn may have no shard of these texts' words.
            log = sums[chunk] if chunk in sums else np.zeros(len(_places(of)))
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([x], pa.binary()) for x in (of, models, log.tobytes())), *(pa.array([x], t) for x, t in zip(lists, heads.values()))], names=["chunk", "of", "models", "log", *heads])

    here = F.col("shard").between(turn.start, turn.stop - 1)
    sent = docs.select("doc_id", "lang", F.xxhash64("text").alias("same"), "text").mapInArrow(send, schema).unionByName(counts.rows.where(here), allowMissingColumns=True)
    summed = sent.repartitionById(len(turn), F.col("shard") - turn.start).sortWithinPartitions("kind").mapInArrow(add, schema)
    back = F.pmod(F.xxhash64("chunk"), F.lit(shards)).cast("int")
    return summed.repartitionById(shards, back).mapInArrow(gather, f"chunk long, of binary, models binary, log binary, {listed}")


def bytes_of(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shards_for(docs: DataFrame, size: int) -> int:
    """As many as shuffle partitions, more where the texts are large."""
    return max(parallelism(docs.sparkSession), -(-size // SHARD_BYTES))


def rounds_for(size: int) -> int:
    return max(1, min(ROUNDS, size // ROUND_BYTES))


def passing(df: DataFrame, label: str) -> DataFrame:
    """:func:`written`, after which the exchanges that it took go, as nothing else reads ``df``."""
    found = written(df, label)
    del df
    # The JVM hears of objects let go here a moment later, and executors of what it then finds unused: a single collection leaves the exchanges.
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        found.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.7)
    return found
