"""Token ids as Simple-8b words in shard tables, and back.

Format.  Documents stand in ascending id order (nulls first), cut into shards by ranges of
the id, and each shard into segments of whole documents.  A segment is one self-contained
byte string: a header, the document ids and lengths, the word offset of each block of
``BLOCK_IDS`` ids, the escaped ids, and the words.  A word holds a selector in its top four
bits and 60, 30, 20, ... or 1 ids of equal width in the other sixty; selector 15 escapes an
id of more than 60 bits, whose value is in the list of escapes.  No word spans two blocks,
so blocks can be decoded alone, and a whole segment is decoded by array operations only.

Segments are rows of a Parquet table (``shard``, ``segment``, ``start``, ``n_ids``,
``payload``): Spark's commit protocol makes lost executors harmless and any Hadoop file
system will do.

Null texts are encoded like empty ones (the end id alone); repeated ids stay separate rows;
an empty table makes an empty table.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import parallelism, shared_dir, sliced, tokenizer_path

#: Ids in a word and bits of each, by selector 1 to 14; 15 is the escape.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
#: A power of two.
BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 18
HEADER = struct.Struct("<4sIQQQQ")
MAGIC = b"S8B1"
_COUNTS = np.array([0, *(n for n, _ in SELECTORS), 1], dtype=np.int64)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, word offset of each block, escaped ids, of an array of unsigned 64-bit ids."""
    n = len(ids)
    ids = ids.astype(np.uint64, copy=False)
    best = np.full(n, ESCAPE, dtype=np.uint8)
    at = np.arange(n, dtype=np.int32)
    # Places left in the block, which no word may pass, nor the end.
    left = BLOCK_IDS - (at & (BLOCK_IDS - 1))
    left[n - n % BLOCK_IDS :] -= BLOCK_IDS - n % BLOCK_IDS
    widest = int(ids.max()).bit_length() if n else 0
    # From few wide ids to many narrow ones: where a word can't hold the former it can't hold the latter.
    for k in range(len(SELECTORS), 0, -1):
        count, width = SELECTORS[k - 1]
        at = at[left[at] >= count]
        if width < widest:
            wide = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(ids >= np.uint64(1 << width), out=wide[1:])
            at = at[wide[at + count] == wide[at]]
        if not len(at):
            break
        best[at] = k
    step = _COUNTS[best].astype(np.uint8).tobytes()
    heads, i = [], 0
    add = heads.append
    while i < n:
        add(i)
        i += step[i]
    head = np.array(heads, dtype=np.int64)
    selector = best[head].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    for k, (count, width) in enumerate(SELECTORS, 1):
        mine = np.flatnonzero(selector == k)
        if len(mine):
            first, acc = head[mine], np.zeros(len(mine), dtype=np.uint64)
            for j in range(count):
                acc |= ids[first + j] << np.uint64(width * j)
            words[mine] |= acc
    out = np.flatnonzero(selector == ESCAPE)
    escapes = ids[head[out]]
    words[out] |= np.arange(len(out), dtype=np.uint64)
    offsets = np.searchsorted(head, np.arange(0, n, BLOCK_IDS))
    return words, offsets.astype(np.uint32), escapes


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of words that :func:`pack` made; any run of whole blocks will do."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selector]
    first = np.cumsum(counts) - counts
    ids = np.empty(int(counts.sum()), dtype=np.uint64)
    for k, (count, width) in enumerate(SELECTORS, 1):
        mine = np.flatnonzero(selector == k)
        if len(mine):
            mask, base, held = np.uint64((1 << width) - 1), first[mine], words[mine]
            for j in range(count):
                ids[base + j] = (held >> np.uint64(width * j)) & mask
    out = np.flatnonzero(selector == ESCAPE)
    if len(out):
        ids[first[out]] = escapes[(words[out] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return ids


def segment_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets, escapes = pack(ids)
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    parts = [
        np.array([x or 0 for x in doc_ids], dtype="<i8"),
        np.array(lengths, dtype="<u8"),
        escapes.astype("<u8"),
        words.astype("<u8"),
        offsets.astype("<u4"),
        known,
    ]
    return HEADER.pack(MAGIC, len(offsets), len(doc_ids), len(ids), len(words), len(escapes)) + b"".join(p.tobytes() for p in parts)


def read_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a segment."""
    magic, blocks, docs, total, n_words, n_escapes = HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b segment")
    at = HEADER.size
    parts = []
    for kind, n in (("<i8", docs), ("<u8", docs), ("<u8", n_escapes), ("<u8", n_words), ("<u4", blocks), ("u1", docs)):
        parts.append(np.frombuffer(payload, dtype=kind, count=n, offset=at))
        at += parts[-1].nbytes
    doc_ids, lengths, escapes, words, _, known = parts
    ids = unpack(words, escapes)
    if len(ids) != total:
        raise ValueError("a segment's words do not hold the ids its header counts")
    return [d if k else None for d, k in zip(doc_ids.tolist(), known.tolist())], lengths.astype(np.int64), ids


_PRESS, _UNPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _thin(ids: bytes) -> bytes:
    """Ids for the shuffle: byte planes of the narrowest width, compressed."""
    a = np.frombuffer(ids, dtype="<u4")
    wide = bool(len(a)) and int(a.max()) > 0xFFFF
    planes = np.ascontiguousarray(a.astype("<u4" if wide else "<u2").view(np.uint8).reshape(len(a), -1).T)
    return bytes([planes.shape[0] if len(a) else 2]) + _PRESS.compress(planes.tobytes())


def _wide(thin: bytes, n: int) -> np.ndarray:
    k = thin[0]
    planes = np.frombuffer(_UNPRESS.decompress(thin[1:]), dtype=np.uint8).reshape(k, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{k}").astype(np.uint64)


def write(docs: DataFrame, path: str | None = None, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text, append ``end_id``, write the shard table; its path is returned.

    Shards are ranges of the id at quantiles of the id column, so only ids are read to find
    them; the texts are encoded once, and what is shuffled is compressed ids.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary if "/" in vocabulary else tokenizer_path(vocabulary)
    path = path or f"{shared_dir(spark)}/textpipe-simple8b-{uuid.uuid4().hex}"
    shards = parallelism(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = np.unique(np.array(docs.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.1 / shards) if shards > 1 else [], dtype=np.int64))
    end = np.array([end_id], dtype="<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in sliced(batches):
            keys = batch.column(0).to_pylist()
            ids = [bpe.encode(t) + end for t in batch.column(1).to_pylist()]
            shard = [0 if k is None else int(np.searchsorted(bounds, k, side="left")) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(_thin, ids), pa.binary())], names=["shard", "doc_id", "n", "ids"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, int, bytes]] = []
        at: list[int] = [-1, 0, 0]  # shard, segments and ids written of it
        n_held = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([_wide(x, n) for _, n, x in held])
            payload = segment_bytes([d for d, _, _ in held], [n for _, n, _ in held], ids)
            row = pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([at[2]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], names=["shard", "segment", "start", "n_ids", "payload"])
            at[1:] = at[1] + 1, at[2] + len(ids)
            held.clear()
            return row

        for batch in batches:
            for shard, doc, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (shard != at[0] or n_held + n > SEGMENT_IDS):
                    yield flush()
                    n_held = 0
                if shard != at[0]:
                    at[:] = shard, 0, 0
                held.append((doc, n, ids))
                n_held += n
        if held:
            yield flush()

    dealt = docs.mapInArrow(encoded, "shard int, doc_id long, n long, ids binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n", "ids")
    dealt.mapInArrow(segments, "shard int, segment int, start long, n_ids long, payload binary").write.option("compression", "zstd").parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit), from the files."""
    table = spark.read.schema("shard int, segment int, start long, n_ids long, payload binary").parquet(path)
    # One row for each shard, and there are no more shards than partitions of the write: bounded, hence broadcast.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = table.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, start, payload in zip(*(c.to_pylist() for c in batch.columns)):
                docs, lengths, ids = read_segment(payload)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                each = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends - lengths + base + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(each, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return table.join(F.broadcast(bases), "shard").select("base", "start", "payload").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """Written, read back, and the checksum of each document's ids."""
    return read(docs.sparkSession, write(docs)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
