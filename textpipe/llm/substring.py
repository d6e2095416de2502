"""Substring deduplication: MinHash banding over short paragraphs, exact Jaccard, components.

Texts are cut into paragraphs by their content alone (:mod:`.paragraphs`), so that a passage
is cut alike wherever it stands, whether its sentences or lines are short, long or absent.

Each paragraph has ``BANDS`` bands of one MinHash over its 5-word shingles: at a similarity
of 0.8 at least one agrees with probability 1 - 0.2^4 = 0.998.  First pass: bands with the
content's hash are counted in each task and shuffled by band; bands under which two
contents meet, and contents found twice, are candidates.  Second pass: occurrences of
candidates are fetched, with the shingles of those that meet another; bitmaps of fixed size
tell most others before they are shuffled.  Third pass: the words beside the ends of runs
are fetched.

Contents that meet under a band are verified by the exact Jaccard similarity of their
shingles (0.8 or more).  No task verifies more than ``max_group`` contents at once (twice as
many where two blocks meet), and no link is lost:

1. A band with more contents is dealt again by the rarest shingles of each (a prefix that
   any two similar ones must share); one with too many shingles of its own can't have a
   partner and is left out.
2. Where one shingle still has too many, one content is the pivot.  All that are similar to
   it are one class; only the others are compared with them and one another, in blocks.

Components of verified links are classes of paragraphs; the first occurrence of a class (by
document id, null first) stays, with whatever its document repeats of itself.  Copies in
other documents make runs with the ones right beside them.  A run goes on over its ends,
word by word, as far as the words beside it are those beside the paragraph that stays; it
is cut out if all that has at least ``MIN_RUN`` words, so that stock phrases in otherwise
clean documents stay.

Null and empty texts, and texts of fewer than eight words, have no paragraphs.  Rows with
equal id and text count as one document; a null id is an id like any other.  An empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bitmaps import BITS, bitmap, bitmaps, within
from .common import dropped, parallelism, release, sliced, written
from .components import components
from .paragraphs import Parsed
from .words import mixed, parsed, signed, text_hash

SIMILARITY = 0.8
BANDS = 4
MIN_RUN = 20
MAX_GROUP = 500
#: Words beyond the next paragraph on each side that a run may go on over: as many as a cut depends on.
BEYOND = 10
#: How far apart a text's paragraphs stand in a map of bits.
STEP = 7919
#: Paragraphs that a task of the first pass sums up before it sends them on; contents whose shingles a task of the second remembers to have sent.
BUFFER, SENT = 400_000, 1_000_000
#: Shingles of large groups are told apart as those of more than 1, 8, 64 ... contents, in maps of this many bits.
CLASSES, CLASS_BITMAP = (1, 8, 64, 512), 1 << 25
_SALTS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def bands(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One MinHash for each band (rows) of each paragraph (columns); the last two bits are the band's number."""
    out = np.empty((BANDS, len(starts)), dtype=np.uint64)
    for k in range(BANDS):
        out[k] = np.minimum.reduceat(mixed(shingles ^ _SALTS[k]), starts) & ~np.uint64(3) | np.uint64(k)
    return out


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, content, n`` of each distinct band and content, summed up in the task."""
    keys: list[np.ndarray] = []
    contents: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        content, first, n = np.unique(np.concatenate(contents), return_index=True, return_counts=True)
        key = np.concatenate(keys, axis=1)[:, first]
        return pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.tile(content.view(np.int64), BANDS)), pa.array(np.tile(n, BANDS).astype(np.int32))], names=["key", "content", "n"])

    for _, p in parsed(batches, 0, Parsed):
        if len(p.first):
            keys.append(bands(*p.shingles()))
            contents.append(p.content)
            size += len(p.first)
            if size >= BUFFER:
                yield flush()
                keys, contents, size = [], [], 0
    if size:
        yield flush()
    release()


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and content: contents that meet others under a key, and (key null) contents found twice."""
    names = ["key", "content"]
    kept: list[np.ndarray] | None = None

    def out(key: np.ndarray, content: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])])
        at = np.flatnonzero(first)
        total = np.add.reduceat(n, at)
        key, content = key[at], content[at]
        twice = content[(total > 1) & (key & 3 == 0)]
        if len(twice):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(twice), pa.int64()), pa.array(twice)], names=names)
        same = key[1:] == key[:-1]
        meets = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if meets.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[meets]), pa.array(content[meets])], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        got = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if kept is not None:
            got = [np.concatenate([a, b]) for a, b in zip(kept, got)]
        last = int(np.searchsorted(got[0], got[0][-1], side="left"))
        if last:
            yield from out(*[x[:last] for x in got])
        kept = [x[last:] for x in got]
        if len(kept[0]) > BUFFER and kept[1][0] != kept[1][-1]:
            # One band with very many contents: they all meet, so they may go, but for the last.
            yield from out(*kept)
            kept = [x[-1:] for x in kept]
    if kept is not None and len(kept[0]):
        yield from out(*kept)


def _occurrences(kind: pa.DataType, candidates, meeting):
    names = ["content", "doc_id", "row", "paragraph", "start", "end", "n_words", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Paragraphs that may be candidates; the distinct shingles, in order, of those that may meet others, once for a content."""
        known, near = candidates.value, meeting.value
        seen: set[int] = set()
        for batch, p in parsed(batches, 1, Parsed):
            at = np.flatnonzero(within(known, p.content))
            if not len(at):
                continue
            texts = p.text[at]
            span = np.empty((2, len(at)), dtype=np.int64)
            rows = np.empty(len(at), dtype=np.int64)
            edges = [0, *(np.flatnonzero(np.diff(texts)) + 1).tolist(), len(at)]
            for a, b in zip(edges, edges[1:]):
                text = int(texts[a])
                places, low = p.characters(text), p.offsets[text]
                span[0, a:b] = places[p.start[p.first[at[a:b]]] - low]
                span[1, a:b] = places[p.end[p.first[at[a:b]] + p.count[at[a:b]] - 1] - low]
                rows[a:b] = text_hash(batch.column(1)[text])
            s, starts = p.shingles()
            ends = np.append(starts[1:], len(s))
            content = p.content[at]
            body: list[bytes | None] = [None] * len(at)
            for i in np.flatnonzero(within(near, content)).tolist():
                c = int(content[i])
                if c not in seen:
                    seen.add(c)
                    body[i] = np.unique(s[starts[at[i]] : ends[at[i]]]).tobytes()
            if len(seen) > SENT:
                seen.clear()
            opening = np.searchsorted(p.text, texts)
            yield pa.RecordBatch.from_arrays([pa.array(content.view(np.int64)), batch.column(0).take(pa.array(texts)), pa.array(rows), pa.array((at - opening).astype(np.int32)), *(pa.array(x.astype(np.int32)) for x in span), pa.array(p.count[at].astype(np.int32)), pa.array(body, pa.binary())], names=names)
        release()

    return run


def _sides(sent):
    """``row, paragraph, left, right`` of the paragraphs that may be asked for: the words before, from the last, and after."""
    names = ["row", "paragraph", "left", "right"]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch, p in parsed(batches, 0, Parsed):
            rows: dict[tuple[int, int], tuple] = {}
            opening = np.searchsorted(p.text, np.arange(len(p.offsets)))
            for text in np.unique(p.text).tolist():
                a, b = int(opening[text]), int(opening[text + 1])
                row = text_hash(batch.column(0)[text])
                if not within(bits, np.array([row % BITS], dtype=np.uint64))[0]:
                    continue
                wanted = np.flatnonzero(within(bits, np.uint64(row % BITS) + np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(STEP)))
                if not len(wanted):
                    continue
                places, low = p.characters(text), p.offsets[text]
                begin, stop = int(p.begin[text]), int(p.begin[text + 1])
                short = (p.hash[begin:stop] >> np.uint64(32)).astype(np.uint32)
                first, last = places[p.start[begin:stop] - low].astype(np.uint32), places[p.end[begin:stop] - low].astype(np.uint32)
                for k in wanted.tolist():
                    f = int(p.first[a + k]) - begin
                    t = f + int(p.count[a + k])
                    far = max(0, f - (int(p.count[a + k - 1]) if k else 0) - BEYOND)
                    left = np.stack([short[far:f][::-1], first[far:f][::-1]])
                    far = t + (int(p.count[a + k + 1]) if a + k + 1 < b else 0) + BEYOND
                    rows[row, k] = row, k, left.tobytes(), np.stack([short[t:far], last[t:far]]).tobytes()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows.values()), types)], names=names)
        release()

    return run


def _agree(a: bytes, b: bytes) -> tuple[int, int]:
    """How many words two sides begin with alike, and the place in ``a`` that the last of them reaches to."""
    x, y = (np.frombuffer(side, dtype=np.uint32).reshape(2, -1) for side in (a, b))
    n = min(x.shape[1], y.shape[1])
    differ = np.flatnonzero(x[0, :n] != y[0, :n])
    n = int(differ[0]) if len(differ) else n
    return n, int(x[1, n - 1]) if n else -1


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last four columns (own and kept words to the left and right) become how many agree, and how far those reach."""
    for batch in batches:
        rows = [(*_agree(a, c), *_agree(b, d)) for a, b, c, d in zip(*(x.to_pylist() for x in batch.columns[-4:]))]
        more = zip(*rows) if rows else [[] for _ in range(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *(pa.array(c, pa.int32()) for c in more)], names=[*batch.schema.names[:-4], "n_left", "from", "n_right", "to"])


def _extensions(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """For ``row, paragraph`` and the place of the one that stays: how many words beside both agree, and how far they reach."""
    kept = edges.select(F.col("kept_row").alias("row"), F.col("kept_paragraph").alias("paragraph"))
    at = F.pmod("row", F.lit(BITS))
    places = edges.select("row", "paragraph").union(kept).select(F.explode(F.array(at, F.pmod(at + (F.col("paragraph").cast("long") + 1) * STEP, F.lit(BITS)))).alias("place"))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(places, "place"))
    # Equal texts have equal sides: one row for all of them.
    sides = docs.select("text").mapInArrow(_sides(sent), "row long, paragraph int, left binary, right binary")
    sides = written(sides.groupBy("row", "paragraph").agg(F.first("left").alias("left"), F.first("right").alias("right")), "sides")
    sent.destroy()
    others = sides.toDF("kept_row", "kept_paragraph", "kept_left", "kept_right")
    both = edges.join(sides, ["row", "paragraph"]).join(others, ["kept_row", "kept_paragraph"])
    both = both.select("row", "paragraph", "kept_row", "kept_paragraph", "left", "right", "kept_left", "kept_right")
    found = written(both.mapInArrow(_agreeing, "row long, paragraph int, kept_row long, kept_paragraph int, n_left int, from int, n_right int, to int"), "extensions")
    dropped(sides)
    return found


def similar(a: frozenset, b: frozenset) -> bool:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if len(small) < SIMILARITY * len(large):
        return False
    both = len(small & large)
    return both >= SIMILARITY * (len(a) + len(b) - both)


def prefix(n: int) -> int:
    """Of ``n`` tokens in any common order, how many first ones share one with every similar set."""
    return n - math.ceil(SIMILARITY * n - 1e-9) + 1


class _Classes:
    """Roots of what has been united so far."""

    def __init__(self, members):
        self.root = {c: c for c in members}

    def find(self, c: int) -> int:
        root = self.root
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c


def linked(sets: dict[int, frozenset]) -> list[tuple[int, int]]:
    """Links whose components are those of all similar pairs: what is united already is not compared again."""
    classes, links = _Classes(sets), []
    find = classes.find
    order = sorted(sets, key=lambda c: (len(sets[c]), c))

    def unite(c: int, other: int) -> bool:
        if similar(sets[other], sets[c]):
            classes.root[find(c)] = find(other)
            links.append((c, other))
            return True
        return False

    if len(sets) <= 16:
        done: list[int] = []
        for c in order:
            for other in reversed(done):
                if len(sets[other]) < SIMILARITY * len(sets[c]):
                    break
                if find(other) != find(c):
                    unite(c, other)
            done.append(c)
        return links
    counts = Counter(t for s in sets.values() for t in s)
    # By token: those that have it in their prefix, by root.
    index: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
    for c in order:
        n = len(sets[c])
        shared = sorted((t for t in sets[c] if counts[t] > 1), key=lambda t: (counts[t], t))
        own = n - len(shared)
        for i, t in enumerate(shared[: max(0, prefix(n) - own)], own):
            at = index.setdefault(t, {})
            for root in list(at):
                if find(root) != root:
                    at.setdefault(find(root), []).extend(at.pop(root))
            for root, others in at.items():
                if root != find(c):
                    for other, m, j in others:
                        # What is left behind the token on both sides must do for the overlap.
                        if (1 + SIMILARITY) * min(n - i, m - j) >= SIMILARITY * (n + m) - 1e-9 and m >= SIMILARITY * n and unite(c, other):
                            break
            at.setdefault(find(c), []).append((c, n, i))
    return links


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group; rows are sorted by ``key``."""
    held: dict[int, bytes] = {}
    now: int | None = None
    out: list[tuple[int, int]] = []

    def close() -> None:
        if len(held) > 1:
            out.extend(linked({c: frozenset(memoryview(body).cast("Q").tolist()) for c, body in held.items()}))

    def sent() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["a", "b"])
        out.clear()
        return rows

    for batch in batches:
        for key, content, body in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                close()
                held, now = {}, key
                if len(out) > 10_000:
                    yield sent()
            held[content] = body
    close()
    yield sent()
    release()


def _tokens(body: bytes, key: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a member of a large group, and a number of each in that group."""
    s = np.frombuffer(body, dtype=np.uint64)
    return s, mixed(s ^ np.uint64(key % (1 << 64)))


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, n``: how many members have each shingle of a group, summed up in the task."""
    parts: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    for batch in batches:
        for key, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            parts.append(_tokens(body, key)[1])
            size += len(parts[-1])
        if size >= BUFFER:
            yield flush()
            parts, size = [], 0
    if parts:
        yield flush()


def _rarest(sent):
    """Members of large groups under each shingle of their prefix, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = sent.value
        for batch in batches:
            rows: list[tuple[int, int, bytes]] = []
            for key, content, body in zip(*(c.to_pylist() for c in batch.columns)):
                _, token = _tokens(body, key)
                rarity = np.zeros(len(token), dtype=np.int8)
                for k, m in enumerate(maps, 1):
                    rarity[within(m, token)] = k
                order = np.lexsort((token, rarity))[: prefix(len(token))]
                # A shingle that no other member has shares nothing.
                rows += [(signed(int(token[i])), content, body) for i in order.tolist() if rarity[i]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["key", "content", "shingles"])

    return run


def _by_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, content, shingles, pivot, near``: whether a member is similar to its group's pivot."""
    names = ["key", "content", "shingles", "pivot", "near"]
    for batch in batches:
        near = [similar(frozenset(memoryview(a).cast("Q").tolist()), frozenset(memoryview(b).cast("Q").tolist())) for a, b in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(near, pa.bool_())], names=names)


def _grouped(rows: DataFrame, max_group: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows of groups of ``max_group`` members at most, and those of larger ones."""
    # Aggregates are written before they are joined: a join right above two exchanges is one whose hot keys Spark can split.
    large = written(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > max_group).select("key"), f"large-{label}")
    return rows.join(large, "key", "left_anti"), rows.join(large, "key", "left_semi")


def _links(near: DataFrame, bodies: DataFrame, max_group: int) -> DataFrame:
    """Verified links between contents that meet under a key."""
    spark = near.sparkSession
    rows = written(near.join(bodies, "content").select("key", "content", "shingles"), "members")
    few, many = _grouped(rows, max_group, "bands")
    parts = [few]
    links = []
    many = written(many, "many")
    if many.limit(1).count():
        counts = many.mapInArrow(_token_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
        counts = written(counts, "tokens")
        classed = counts.withColumn("class", F.size(F.filter(F.array(*map(F.lit, CLASSES)), lambda least: F.col("n") > least)) - 1)
        maps = bitmaps(classed, "class", "token", len(CLASSES), CLASS_BITMAP)
        sent = spark.sparkContext.broadcast(maps)
        dealt = written(many.mapInArrow(_rarest(sent), "key long, content long, shingles binary"), "dealt")
        sent.destroy()
        dropped(counts)
        few, many = _grouped(dealt, max_group, "shingles")
        parts.append(few)
        pivots = written(many.groupBy("key").agg(F.min(F.struct("content", "shingles")).alias("pivot")).select("key", F.col("pivot.content").alias("pivot"), F.col("pivot.shingles").alias("of")), "pivots")
        if pivots.limit(1).count():
            told = many.join(pivots, "key").select("key", "content", "shingles", "pivot", "of")
            told = written(told.mapInArrow(_by_pivot, "key long, content long, shingles binary, pivot long, near boolean"), "by-pivot")
            links.append(told.where("near AND content <> pivot").select(F.col("content").alias("a"), F.col("pivot").alias("b")))
            # Blocks of others meet one another and the blocks of those near the pivot.
            part = lambda kind: F.ceil(F.count(F.when(kind, True)) / max_group).cast("int")
            blocks = written(told.groupBy("key").agg(part(~F.col("near")).alias("others"), part(F.col("near")).alias("close")).where("others > 0"), "blocks")
            told = told.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "content"), F.when(F.col("near"), F.col("close")).otherwise(F.col("others"))).cast("int"))
            to = lambda n: F.sequence(F.lit(0), n - 1)
            among = F.transform(to(F.col("others")), lambda k: F.xxhash64("key", F.least("own", k), F.greatest("own", k), F.lit("others")))
            beside = F.transform(to(F.col("close")), lambda k: F.xxhash64("key", "own", k, F.lit("close")))
            back = F.transform(to(F.col("others")), lambda k: F.xxhash64("key", k, F.col("own"), F.lit("close")))
            keys = F.when(F.col("near"), back).otherwise(F.concat(among, beside))
            parts.append(told.select(F.explode(keys).alias("key"), "content", "shingles"))
    for part in parts:
        links.append(part.repartition(parallelism(spark), "key").sortWithinPartitions("key").mapInArrow(_verified, "a long, b long"))
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, max_group: int = MAX_GROUP) -> DataFrame:
    """One row for each paragraph whose class has another: ``doc_id, row, paragraph, start, end, n_words, class_id, class_size, keeper_id, keeper, removed``.

    ``start`` and ``end`` are character places in the text; at the ends of a removed run they take in the words beside it that go too.
    ``keeper_id`` is the document whose paragraph stays, ``keeper`` tells that paragraph itself if a copy of it is removed; ``row`` is Spark's xxhash64 of the text.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("text").mapInArrow(_band_rows, "key long, content long, n int")
    meet = written(rows.repartition(parallelism(spark), "key").sortWithinPartitions("key", "content").mapInArrow(_meetings, "key long, content long"), "meetings")
    near = meet.where("key IS NOT NULL")
    candidates = written(meet.select("content").distinct(), "candidates")
    known, meeting = (spark.sparkContext.broadcast(bitmap(x, "content")) for x in (candidates, near))
    seen = docs.mapInArrow(_occurrences(to_arrow_type(docs.schema["doc_id"].dataType), known, meeting), f"content long, doc_id {kind}, row long, paragraph int, start int, end int, n_words int, shingles binary")
    found = written(seen.join(candidates, "content", "left_semi"), "occurrences")
    known.destroy()
    meeting.destroy()
    bodies = written(found.where("shingles IS NOT NULL").groupBy("content").agg(F.first("shingles").alias("shingles")), "bodies")
    roots = components(_links(near, bodies, max_group))
    here = found.drop("shingles").distinct().join(roots, found["content"] == roots["v"], "left").withColumn("class_id", F.coalesce("root", "content")).drop("v", "root", "content")
    here = written(here, "classes")
    dropped(meet, candidates, found, bodies, roots)
    first = F.min(F.struct("doc_id", "row", "paragraph")).alias("keeper")
    keepers = written(here.groupBy("class_id").agg(first, F.count("*").alias("class_size")).where("class_size > 1"), "keepers")
    # What a document repeats of itself stays: a copy is one of another document's paragraph.
    same = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("row") == F.col("keeper.row"))
    here = here.join(keepers, "class_id").withColumn("copy", ~same)
    # Runs of neighbouring copies within a document; its own paragraphs are all that a window holds.
    order = Window.partitionBy("doc_id", "row", "copy").orderBy("paragraph")
    runs = here.withColumn("run", F.col("paragraph") - F.row_number().over(order))
    run = Window.partitionBy("doc_id", "row", "copy", "run")
    runs = runs.withColumn("first", F.col("paragraph") == F.min("paragraph").over(run)).withColumn("last", F.col("paragraph") == F.max("paragraph").over(run))
    runs = written(runs.select("*", F.col("keeper.doc_id").alias("keeper_id"), F.col("keeper.row").alias("kept_row"), F.col("keeper.paragraph").alias("kept_paragraph")).drop("keeper"), "runs")
    places = ["row", "paragraph", "kept_row", "kept_paragraph"]
    edges = written(runs.where("copy AND (first OR last)").select(places).distinct(), "edges")
    runs = runs.join(_extensions(docs, edges), places, "left")
    whole = F.col("n_words") + F.when(F.col("first"), F.coalesce("n_left", F.lit(0))).otherwise(0) + F.when(F.col("last"), F.coalesce("n_right", F.lit(0))).otherwise(0)
    runs = runs.withColumn("removed", F.col("copy") & (F.sum(whole).over(run) >= min_run))
    start = F.when(F.col("removed") & F.col("first") & (F.col("n_left") > 0), F.col("from")).otherwise(F.col("start"))
    end = F.when(F.col("removed") & F.col("last") & (F.col("n_right") > 0), F.col("to")).otherwise(F.col("end"))
    return runs.select("doc_id", "row", "paragraph", start.alias("start"), end.alias("end"), "n_words", "class_id", "class_size", "keeper_id", "kept_row", "kept_paragraph", "removed")


def repeats(found: DataFrame) -> DataFrame:
    """Of :func:`duplicates`, the paragraphs that go, and those whose copies go (``removed`` is false)."""
    found = written(found, "found")
    kept = written(found.where("removed").select(F.col("keeper_id").alias("k"), F.col("kept_row").alias("r"), F.col("kept_paragraph").alias("p")).distinct(), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("row") == F.col("r")) & (F.col("paragraph") == F.col("p"))
    return found.where("removed").union(found.where("NOT removed").join(kept, same, "left_semi"))


def cut(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed paragraphs cut out of their texts; other columns and rows stay as they are."""
    schema = docs.schema
    at = docs.columns.index(text_col)
    gone = found.where("removed").groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__gone"))
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__row")), "left").drop("__id", "__row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            for i, gone in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if gone:
                    texts[i] = without(texts[i], [(x["start"], x["end"]) for x in gone])
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : -1]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the given spans; lines that are left empty go as well."""
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at:start])
        at = max(at, end)
    parts.append(text[at:])
    out = parts[0]
    for part in parts[1:]:
        # What stood on both sides of a cut is kept apart by one separator.
        left, right = out.rstrip(" \t"), part.lstrip(" \t")
        out = left + (right.lstrip("\n") if not left or left.endswith("\n") else right if right.startswith("\n") or not right else " " + right)
    return out.rstrip("\n") if spans else out
