"""SimHash near-duplicates: fingerprints, a binary trie self-join, components.

Fingerprints of 64 bits come from the XXH64 values (seed 42) of a document's 3-word
shingles.  Equal fingerprints are one node from then on, whatever their number of copies.

Two fingerprints that differ in at most ``k`` bits agree in one of ``k + 1`` blocks of
bits, so there is one trie for each block, which has that block on top.  Below equal top
blocks the trie is joined with itself: pairs of nodes go down together, the bits in which
their paths differ add up, and a pair is pruned when the budget is spent.  Subtrees are
dealt to tasks by the top block.  A subtree of more than ``max_subtree`` fingerprints is
dealt again by blocks of its remaining bits, with the same argument, until it is small
enough; 13 free bits hold 8192 distinct fingerprints at most, so that ends and memory is
bounded without any cap on candidates.

Within a task links are united, and only a path through each united group leaves it; the
components of all paths are those of all links.

Null or empty texts have fingerprint zero and are linked like any other; ties and repeated
rows are handled; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, sliced, written
from .components import components

BITS = 64
DISTANCE = 2
SHINGLE = 3
SEED = 42
MAX_SUBTREE = 8192


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text; zero without words."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    join = b" ".join
    sets = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(words) - SHINGLE + 1, 4096):
        part = words[at : at + 4096 + SHINGLE - 1]
        h = np.array([digest(join(x), SEED) for x in zip(part, part[1:], part[2:])], dtype="<u8")
        sets += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    n = len(words) - SHINGLE + 1
    return int(np.packbits((2 * sets > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (long: the 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def blocks_of(free: list[int], parts: int) -> list[list[int]]:
    """Bit positions cut into ``parts`` runs of nearly equal length."""
    return [list(map(int, x)) for x in np.array_split(np.array(free), parts)]


def gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint as one number."""
    out = np.zeros(len(fps), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def trie_join(fps: np.ndarray, roots: np.ndarray, budget: int = DISTANCE) -> np.ndarray:
    """Pairs (m x 2, by place) of distinct fingerprints that share a root and differ in at most ``budget`` bits.

    ``fps`` is sorted within each root; ``roots`` holds the first place of each and the total length.
    A trie node is a run of places, and a frontier of node pairs goes down one bit at a time.
    """
    lo, hi = roots[:-1], roots[1:]
    a = np.stack([lo, hi, lo, hi, np.zeros_like(lo)], axis=1).astype(np.int64)
    a = a[a[:, 1] - a[:, 0] > 1]
    done = []
    for bit in range(BITS - 1, -1, -1):
        if not len(a):
            break
        ones = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
        # Within a node all higher bits are equal, so the ones of this bit stand last.
        mid1 = a[:, 1] - (ones[a[:, 1]] - ones[a[:, 0]])
        mid2 = a[:, 3] - (ones[a[:, 3]] - ones[a[:, 2]])
        own = (a[:, 0] == a[:, 2]) & (a[:, 1] == a[:, 3])
        e = a[:, 4]
        zz = np.stack([a[:, 0], mid1, a[:, 2], mid2, e], axis=1)
        oo = np.stack([mid1, a[:, 1], mid2, a[:, 3], e], axis=1)
        zo = np.stack([a[:, 0], mid1, mid2, a[:, 3], e + 1], axis=1)
        oz = np.stack([mid1, a[:, 1], a[:, 2], mid2, e + 1], axis=1)[~own]
        a = np.concatenate([zz, oo, zo, oz])
        same = (a[:, 0] == a[:, 2]) & (a[:, 1] == a[:, 3])
        na, nb = a[:, 1] - a[:, 0], a[:, 3] - a[:, 2]
        a = a[(a[:, 4] <= budget) & (na > 0) & (nb > 0) & ~(same & (na < 2))]
        # Pairs of single fingerprints need no more steps: their remaining bits are counted at once.
        single = (a[:, 1] - a[:, 0] == 1) & (a[:, 3] - a[:, 2] == 1)
        if single.any():
            s, a = a[single], a[~single]
            x = fps[s[:, 0]] ^ fps[s[:, 2]]
            done.append(s[np.bitwise_count(x) <= budget][:, [0, 2]])
    if len(a):
        done.append(a[a[:, 4] <= budget][:, [0, 2]])
    return np.concatenate(done) if done else np.empty((0, 2), dtype=np.int64)


def paths(fps: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links along a path through each group that the pairs unite; no vertex gets more than two."""
    if not len(pairs):
        return fps[:0], fps[:0]
    ends, inverse = np.unique(pairs, return_inverse=True)
    inverse = inverse.reshape(-1, 2)
    root = np.arange(len(ends))
    while True:
        old = root.copy()
        low = np.minimum(root[inverse[:, 0]], root[inverse[:, 1]])
        np.minimum.at(root, inverse[:, 0], low)
        np.minimum.at(root, inverse[:, 1], low)
        np.minimum.at(root, old[inverse[:, 0]], low)
        np.minimum.at(root, old[inverse[:, 1]], low)
        root = root[root]
        if (root == old).all():
            break
    order = np.lexsort((ends, root))
    same = root[order][1:] == root[order][:-1]
    at = ends[order]
    return fps[at[:-1][same]], fps[at[1:][same]]


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the subtrees of a partition sorted by ``subtree, fp``; whole subtrees are held, some thousand fingerprints at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flush(last: bool) -> tuple[pa.RecordBatch | None, list[tuple[np.ndarray, np.ndarray]]]:
        keys = np.concatenate([k for k, _ in held])
        fps = np.concatenate([f for _, f in held])
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        stop = len(keys) if last else int(starts[-1])
        rest = [] if last else [(keys[stop:], fps[stop:])]
        roots = np.concatenate([starts[starts < stop], [stop]])
        if len(roots) < 2:
            return None, rest
        mine = fps[:stop].astype(np.int64).view(np.uint64)
        # Sorted as signed numbers by Spark; the trie wants unsigned order within each subtree.
        order = np.lexsort((mine, keys[:stop]))
        mine = mine[order]
        x, y = paths(mine, trie_join(mine, roots))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"]), rest

    for batch in batches:
        keys, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        held.append((keys, fps))
        n += len(keys)
        if n >= 2 * MAX_SUBTREE:
            out, held = flush(False)
            n = sum(len(k) for k, _ in held)
            if out is not None and out.num_rows:
                yield out
    if held:
        out, _ = flush(True)
        if out is not None and out.num_rows:
            yield out


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``path, free, fp`` under the top blocks of the bits that are still free: as many rows as there are blocks."""
    for batch in batches:
        path, free = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        fps = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        for mask in np.unique(free):
            mine = np.flatnonzero(free == mask)
            bits = [b for b in range(BITS) if int(mask) >> b & 1]
            for block in blocks_of(bits, DISTANCE + 1):
                fixed = np.uint64(int(mask) & ~sum(1 << b for b in block))
                value = gather(fps[mine], block)
                # The path names all fixed bits: which they are, and their values.
                key = [xxhash.xxh64_intdigest(b"%d %d %d" % (p, fixed, v)) for p, v in zip(path[mine].tolist(), value.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(key, dtype=np.uint64).view(np.int64)), pa.array(np.full(len(mine), fixed, dtype=np.uint64).view(np.int64)), pa.array(fps[mine].view(np.int64))], names=["path", "free", "fp"])


def links(nodes: DataFrame, max_subtree: int = MAX_SUBTREE) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp``; their components are those of all pairs within the distance."""
    spark = nodes.sparkSession
    rows = nodes.select(F.lit(0).cast("long").alias("path"), F.lit(-1).cast("long").alias("free"), "fp")
    out = None
    while True:
        rows = written(rows.mapInArrow(_dealt, "path long, free long, fp long"), "subtrees")
        sizes = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        sizes = written(sizes, "sizes")
        ready = rows.join(sizes.where(F.col("n") <= max_subtree), "path").select("path", "fp")
        here = ready.repartition(parallelism(spark), "path").sortWithinPartitions("path", "fp").mapInArrow(_subtrees, "a long, b long")
        out = here if out is None else out.union(here)
        if not sizes.where(F.col("n") > max_subtree).limit(1).count():
            return out
        rows = rows.join(sizes.where(F.col("n") > max_subtree), "path").select("path", "free", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``: the smallest doc_id that links lead to, the document's own included."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes))
    # Of each component the smallest id; fingerprints without links keep their own.
    grouped = nodes.join(roots, nodes["fp"] == roots["v"]).select("fp", "root", "first")
    least = grouped.groupBy("root").agg(F.min("first").alias("least"))
    linked = grouped.join(least, "root").select("fp", "least")
    # Written, so that the last join stands right above two exchanges and a fingerprint that very many have can be split.
    named = written(nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def classes(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
