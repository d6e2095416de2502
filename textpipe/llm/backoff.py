"""Stupid-backoff language-model scores as a join of blocks of documents with shards of counts.

Words are lower-cased (A-Z) runs between white space, known by their 64-bit hash.  Counts
come from all documents.  A word w after v scores ``(c(v w) - own) / c(v)`` where ``own`` is
what the document itself adds to the count of the pair (else every pair would be known), and
``ALPHA * c(w) / N`` where no other document has the pair; the first word of a text always
scores the latter.  N is the number of words of all documents, c(v) counts v everywhere.

Both sides of the join are kept as sorted arrays of hashes, since one row for each n-gram
of each document would be many times the size of the texts:

1. Documents are dealt into blocks by their id.  A block's n-grams are exploded and summed
   up, and each range of hashes of them goes to its shard: hash differences and counts.
2. A shard merges what all blocks sent, which is its part of the count table, and answers
   each block with the counts that other blocks add, where they add any.
3. Each block explodes its documents again, joins the answers by place, and sums the
   logarithms per document.

A block sends an n-gram once, however frequent it is, so neither a hot n-gram nor a hot
source loads one shard.  Blocks and shards are as many as shuffle partitions, and more where
a block would have over ``block_bytes`` of text on average: what a task holds does not grow
with the input.  Equal ids share a block.

Null and empty texts have no words and null scores.  Rows with equal ids are one document in
the leaving-out and the result has one row for each id; null ids are one such id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import parallelism, sliced, written

ALPHA = 0.4
#: Bytes of text in a block on average; a task holds some 20 times as much.
BLOCK_BYTES = 1 << 24
_MIX = np.uint64(0x9E3779B97F4A7C15)
PAIRS, WORDS = 0, 1
_PRESS, _UNPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes; high bytes are mostly zero and cost little."""
    raw = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return _PRESS.compress(raw.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_UNPRESS.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view("<u8")


class Block:
    """The n-grams of a block of documents: distinct hashes in order, and where each stands."""

    def __init__(self, rows: list[tuple[object, np.ndarray]]):
        self.ids = list(dict.fromkeys(doc for doc, _ in rows))
        place = {doc: i for i, doc in enumerate(self.ids)}
        lengths = np.array([len(w) for _, w in rows], dtype=np.int64)
        total = int(lengths.sum())
        words = np.concatenate([w for _, w in rows])
        doc = np.repeat(np.array([place[d] for d, _ in rows], dtype=np.int64), lengths)
        first = np.zeros(total + 1, dtype=bool)
        first[np.cumsum(lengths) - lengths] = True
        first = first[:-1]
        self.n_words = np.bincount(doc, minlength=len(self.ids))
        self.words, word_of, self.word_counts = np.unique(words, return_inverse=True, return_counts=True)
        second = np.flatnonzero(~first)
        self.pairs, pair_of, self.pair_counts = np.unique(_pair(words[second - 1], words[second]), return_inverse=True, return_counts=True)
        # One entry for each distinct pair of a document, with what the document adds to its count.
        entry, at, self.own = np.unique(doc[second] * max(1, len(self.pairs)) + pair_of, return_index=True, return_counts=True)
        self.doc, self.pair = np.divmod(entry, max(1, len(self.pairs)))
        self.before, self.after = word_of[second[at] - 1], word_of[second[at]]
        starts = np.flatnonzero(first)
        self.first_doc, self.first_word = doc[starts], word_of[starts]

    def requests(self, shards: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """Shard, kind, hash differences and counts of each range of hashes."""
        for kind, hashes, counts in ((PAIRS, self.pairs, self.pair_counts), (WORDS, self.words, self.word_counts)):
            edges = np.searchsorted(_shard(hashes, shards), np.arange(shards + 1))
            for shard in np.flatnonzero(np.diff(edges)).tolist():
                part = slice(edges[shard], edges[shard + 1])
                yield shard, kind, _packed(np.diff(hashes[part], prepend=np.uint64(0))), _packed(counts[part])

    def scores(self, others: dict[tuple[int, int], tuple[bytes, bytes]], shards: int, total: int, alpha: float) -> np.ndarray:
        """Sum of logarithms of each document, from what other blocks add to the counts."""
        counts = []
        for kind, hashes, own in ((PAIRS, self.pairs, self.pair_counts), (WORDS, self.words, self.word_counts)):
            edges = np.searchsorted(_shard(hashes, shards), np.arange(shards + 1))
            everywhere = own.astype(np.int64)
            for shard in np.flatnonzero(np.diff(edges)).tolist():
                if (kind, shard) in others:
                    at, n = others[kind, shard]
                    everywhere[edges[shard] + np.cumsum(_unpacked(at)).astype(np.int64)] += _unpacked(n).astype(np.int64)
            counts.append(everywhere)
        pairs, words = counts
        elsewhere = pairs[self.pair] - self.own
        back = math.log(alpha) - math.log(total) if total else 0.0
        known = np.log(np.maximum(elsewhere, 1)) - np.log(words[self.before])
        each = self.own * np.where(elsewhere > 0, known, back + np.log(words[self.after]))
        out = np.bincount(self.doc, weights=each, minlength=len(self.ids))
        return out + np.bincount(self.first_doc, weights=back + np.log(words[self.first_word]), minlength=len(self.ids))


def _pair(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (v ^ (v >> np.uint64(29))) * _MIX + x
    return (h ^ (h >> np.uint64(32))) * _MIX


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of hashes, so that a shard's part of a sorted array is a slice."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _words(text: str | None) -> np.ndarray:
    words = text.encode("utf-8", "replace").lower().split() if text else []
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, log_score`` (natural logarithm, null without words) and ``mean_log_score``."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(parallelism(spark), -(-size // block_bytes))
    kind_of_id, id_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    block = F.pmod(F.xxhash64(F.lit("block"), F.col(id_col)), F.lit(shards)).cast("int")
    dealt = docs.select(block.alias("block"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at = [], None
        for batch in sliced(batches):
            at = batch.column(0)[0].as_py()
            rows += [(d, _words(t)) for d, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        if rows:
            for shard, kind, hashes, counts in Block(rows).requests(shards):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([at], pa.int32()), pa.array([kind], pa.int8()), pa.array([hashes]), pa.array([counts])], names=["shard", "block", "kind", "hashes", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {PAIRS: [], WORDS: []}
        shard = None
        for batch in batches:
            for shard, at, kind, hashes, counts in zip(*(c.to_pylist() for c in batch.columns)):  # noqa: B007
                got[kind].append((at, np.cumsum(_unpacked(hashes)), _unpacked(counts).astype(np.int64)))
        for kind, parts in got.items():
            if parts:
                _, inverse = np.unique(np.concatenate([h for _, h, _ in parts]), return_inverse=True)
                counts = np.concatenate([c for _, _, c in parts])
                table = np.zeros(int(inverse.max()) + 1, dtype=np.int64)
                np.add.at(table, inverse, counts)
                beyond = table[inverse] - counts
                start, words = 0, int(table.sum()) if kind == WORDS else 0
                for at, h, _ in parts:
                    mine = beyond[start : start + len(h)]
                    start += len(h)
                    places = np.flatnonzero(mine)
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([shard], pa.int32()), pa.array([kind], pa.int8()), pa.array([_packed(np.diff(places, prepend=0))]), pa.array([_packed(mine[places])]), pa.array([words], pa.int64())], names=["block", "shard", "kind", "places", "counts", "words"])
                    words = 0  # a shard's words are told once

    requests = dealt.repartitionById(shards, F.col("block")).mapInArrow(request, "shard int, block int, kind byte, hashes binary, counts binary")
    answers = written(requests.repartitionById(shards, F.col("shard")).mapInArrow(answer, "block int, shard int, kind byte, places binary, counts binary, words long"), "answers")
    total = answers.agg(F.sum("words").alias("n")).first().n or 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[object, np.ndarray]] = []
        others: dict[tuple[int, int], tuple[bytes, bytes]] = {}
        for batch in sliced(batches):
            _, docs_, texts, shard, kind, places, counts = (c.to_pylist() for c in batch.columns)
            for d, t, s, k, p, c in zip(docs_, texts, shard, kind, places, counts):
                if s is None:
                    rows.append((d, _words(t)))
                else:
                    others[k, s] = p, c
        if rows:
            found = Block(rows)
            logs = found.scores(others, shards, total, alpha)
            n = found.n_words
            known = n > 0
            ids = pa.array(found.ids, type=id_type)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(logs, pa.float64(), mask=~known), pa.array(logs / np.maximum(n, 1), pa.float64(), mask=~known)], names=["doc_id", "n_words", "log_score", "mean_log_score"])

    empty = lambda name, kind: F.lit(None).cast(kind).alias(name)
    texts = dealt.select("block", "doc_id", "text", empty("shard", "int"), empty("kind", "byte"), empty("places", "binary"), empty("counts", "binary"))
    replies = answers.select("block", empty("doc_id", kind_of_id), empty("text", "string"), "shard", "kind", "places", "counts")
    return texts.union(replies).repartitionById(shards, F.col("block")).mapInArrow(score, f"doc_id {kind_of_id}, n_words long, log_score double, mean_log_score double")
