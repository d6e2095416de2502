"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item is cut into windows of 13 consecutive words (an item of fewer words is
one window).  A document contains a window only if it has all of the window's words, so a
prefix of one word is enough to find every candidate, and the rarest makes the fewest.

1. The words of the benchmark are counted in all documents, and told apart by rarity in
   powers of 4.  Each window goes under its rarest word, with that word's place in it.
2. Documents are looked through for such words.  The word's place in the window bounds
   where the window would have to start and end (positional and length bounds); what lies
   there is a candidate if its hash may be that of a window.  Maps of fixed size tell, so
   no task or driver holds the benchmark, however large it is.
3. Candidates are joined to the windows by hash and compared word by word (exact
   containment).  Hit windows are merged into spans for each text.

Results are by text, told by its hash, and go to every row that has it; so a text that a
third of all rows have is joined once.  Null texts and texts without words are never
contaminated; repeated rows get their own row each; ids may be null or shared; an empty
benchmark hits nothing.  An item with a null id hits like any other, and is not listed.
Equal item ids are one item.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bitmaps import BITS, bitmap, bitmaps, within
from .common import dropped, release, written
from .words import PLACES, Words, mixed, parsed, signed, text_hash

WINDOW = 13
#: Bits of each of the maps of words that occur more often than these.
RARITY, RARITY_BITS = tuple(4**k for k in range(1, 13)), 1 << 24
#: Bits of the maps of the benchmark's words, of rarest words and of windows.
INDEX_BITS = BITS
#: Word hashes that a task counts, and places that it looks at, at once.
BUFFER, PLACES_AT_ONCE = 1_000_000, 50_000
#: Bytes that make no words: ASCII but for digits and letters.
SEPARATES = np.array([b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])

_parsed = functools.partial(parsed, kind=functools.partial(Words, separates=SEPARATES))


def _keys(hashes: np.ndarray, start: np.ndarray, size: int, at: np.ndarray | int) -> np.ndarray:
    """A number for the window of ``size`` words at each ``start``, and the place of its rarest word."""
    out = np.full(len(start), size, dtype=np.uint64)
    for j in range(size):
        out += hashes[start + j] * PLACES[j + 1]
    return mixed(out * PLACES[2] + np.asarray(at, dtype=np.uint64))


def _spelt(w: Words, first: int, size: int) -> bytes:
    """The words of a window with one space between them, A-Z lower-cased."""
    return b" ".join(w.spell(i, 1) for i in range(first, first + size))


def _counts(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each word of the benchmark occurs, summed up in the task."""
        known = sent.value
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            word, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

        for _, w in _parsed(batches, 0):
            found = w.hash[within(known, w.hash)]
            if len(found):
                parts.append(np.unique(found, return_counts=True))
                size += len(parts[-1][0])
                if size >= BUFFER:
                    yield flush()
                    parts, size = [], 0
        if parts:
            yield flush()
        release()

    return run


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, w in _parsed(batches, 0):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(w.hash).view(np.int64))], names=["word"])


def _windows(sent, window: int):
    """``key, window, word, size, item``: each window of an item under its rarest word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = sent.value
        for batch, w in _parsed(batches, 1):
            rarity = np.zeros(len(w.hash), dtype=np.int8)
            for k, m in enumerate(maps, 1):
                rarity[within(m, w.hash)] = k
            for i, item in enumerate(batch.column(0).to_pylist()):
                first, n = int(w.begin[i]), int(w.begin[i + 1] - w.begin[i])
                if not n:
                    continue
                size = min(window, n)
                at = np.argmin(np.lib.stride_tricks.sliding_window_view(rarity[first : first + n], size), axis=1)
                start = first + np.arange(n - size + 1)
                columns = [pa.array(_keys(w.hash, start, size, at).view(np.int64)), pa.array([_spelt(w, s, size) for s in start.tolist()], pa.binary()), pa.array(w.hash[start + at].view(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(start), size, np.int32)), pa.array([item] * len(start), pa.string())], names=["key", "window", "word", "size", "item"])

    return run


def _probe(words, keys, sizes: list[int], kind: pa.DataType):
    names = ["doc_id", "text_hash", "n_words", "key", "window", "start", "stop"]

    def candidates(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """Text, start and key of what may be a window of each size."""
        rare = np.flatnonzero(within(words.value, w.hash))
        for part in range(0, len(rare), PLACES_AT_ONCE):
            found = rare[part : part + PLACES_AT_ONCE]
            text = np.searchsorted(w.begin, found, side="right") - 1
            for size in sizes:
                start = found[:, None] - np.arange(size)
                fits = (start >= w.begin[text][:, None]) & (start + size <= w.begin[text + 1][:, None])
                row, at = np.nonzero(fits)
                start = start[row, at]
                key = _keys(w.hash, start, size, at)
                hit = within(keys.value, key)
                if hit.any():
                    yield text[row[hit]], start[hit], key[hit], size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each row of documents (``key`` null), and one for each candidate in it (``doc_id`` null)."""
        for batch, w in _parsed(batches, 1):
            hashes = [text_hash(t) if t.is_valid else None for t in batch.column(1)]
            n = np.diff(w.begin)
            for text, start, key, size in candidates(w):
                begin = (start - w.begin[text]).astype(np.int32)
                window = [_spelt(w, s, size) for s in start.tolist()]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(text), kind), pa.array([hashes[t] for t in text.tolist()], pa.int64()), pa.array(n[text]), pa.array(key.view(np.int64)), pa.array(window, pa.binary()), pa.array(begin), pa.array(begin + np.int32(size))], names=names)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.int64()), pa.array(n), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int32())], names=names)
        release()

    return run


def _index(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``key, window, word, size, items`` of each different window of the benchmark, as a table."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    vocabulary = spark.sparkContext.broadcast(bitmap(items.select("text").mapInArrow(_vocabulary, "word long"), "word", INDEX_BITS))
    counts = written(docs.select("text").mapInArrow(_counts(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    vocabulary.destroy()
    # The last of the powers that a word's count reaches; words below all of them are in no map.
    classed = counts.withColumn("class", F.size(F.filter(F.array(*map(F.lit, RARITY)), lambda least: F.col("n") >= least)) - 1).where("class >= 0")
    maps = spark.sparkContext.broadcast(bitmaps(classed, "class", "word", len(RARITY), RARITY_BITS))
    rows = items.mapInArrow(_windows(maps, window), "key long, window binary, word long, size int, item string")
    index = written(rows.groupBy("key", "window", "word", "size").agg(F.collect_set("item").alias("items")), "windows")
    maps.destroy()
    dropped(counts)
    return index


def hits(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Of ``doc_id, text``: ``doc_id, text_hash, n_words`` of each row; and ``text_hash, n_words, n_hit, spans, items`` of each text that has a hit."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    index = _index(docs, benchmark, item_col, item_text_col, window)
    # No more than there are lengths of windows.
    sizes = sorted(index.agg(F.collect_set("size")).first()[0])
    both = index.select(F.inline(F.array(F.struct(F.lit(0).alias("which"), F.col("word").alias("value")), F.struct(F.lit(1).alias("which"), F.col("key").alias("value")))))
    words, keys = map(spark.sparkContext.broadcast, bitmaps(both, "which", "value", 2, INDEX_BITS))
    probe = _probe(words, keys, sizes, to_arrow_type(kind))
    probed = written(docs.select("doc_id", "text").mapInArrow(probe, f"doc_id {kind.simpleString()}, text_hash long, n_words long, key long, window binary, start int, stop int"), "probed")
    words.destroy()
    keys.destroy()
    found = probed.where("key IS NOT NULL").drop("doc_id").distinct().join(index.select("key", "window", "items"), ["key", "window"])
    found = written(found.select("text_hash", "n_words", "start", "stop", "items"), "hits")
    # Spans: a window that starts beyond all that came before it opens a new one.
    order = Window.partitionBy("text_hash").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select("text_hash", "n_words", "start", "stop", F.when(F.col("start") <= reach, 0).otherwise(1).alias("opens")).withColumn("span", F.sum("opens").over(order))
    spans = spans.groupBy("text_hash", "span").agg(F.first("n_words").alias("n_words"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = spans.groupBy("text_hash").agg(F.first("n_words").alias("n_words"), F.sum(F.col("stop").cast("long") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    items = found.select("text_hash", F.explode("items").alias("item")).groupBy("text_hash").agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    texts = spans.join(items, "text_hash", "left").withColumn("items", F.coalesce("items", none))
    return probed.where("key IS NULL").select("doc_id", "text_hash", "n_words"), written(texts, "texts")


def _contaminated(n_hit: str = "n_hit"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: ``doc_id, n_words, n_hit, n_items, items (array of strings), spans (array of [start, stop) in words), contaminated``.

    A document is contaminated if it has a hit and at least a twentieth of its words are hit.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, texts = hits(docs, benchmark, item_col, item_text_col, window)
    out = rows.join(texts.drop("n_words"), "text_hash", "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>")), "spans": F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>"))})
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", _contaminated().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    _, texts = hits(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")), benchmark, item_col, item_text_col, window)
    gone = written(texts.where(_contaminated()).select(F.col("text_hash").alias("__gone")), "contaminated")
    return docs.join(gone, F.xxhash64(F.col(text_col)) == F.col("__gone"), "left_anti")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
