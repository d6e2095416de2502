"""Paragraphs and substring deduplication against brute force and planted passages."""

import collections
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from textpipe.llm import paragraphs, substring, words
from textpipe.llm.words import text_hash

DATA = os.environ.get("TEXTPIPE_DATA", "/root/testdata/sf0.001")


def plain(text):
    """First word and words of each paragraph of a text, and its words."""
    p = paragraphs.Parsed(pa.array([text or ""]))
    return [(int(f), tuple(p.spell(int(f), int(p.count[k])).split())) for k, f in enumerate(p.first)], (text or "").encode().lower().split()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def expected_rows(rows):
    """Rows by document of equal id and text: class, keeper and removal of each paragraph that has another."""
    docs = sorted({(d is not None, d or 0, text_hash(pa.scalar(t)), t) for d, t in rows if t})
    places = collections.defaultdict(list)
    spoken = {}
    for known, d, row, text in docs:
        found, spoken[known, d, row] = plain(text)
        for k, (first, w) in enumerate(found):
            places[w].append((known, d, row, k, first))
    root = {c: c for c in places}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    sets = {c: frozenset(c[i : i + 5] for i in range(len(c) - 4)) for c in places}
    holders = collections.defaultdict(list)
    for c, s in sets.items():
        for t in s:
            holders[t].append(c)
    for c, s in sets.items():
        for o in {o for t in s for o in holders[t]}:
            if o < c and similar(s, sets[o]):
                root[find(c)] = find(o)
    classes = collections.defaultdict(list)
    for c, at in places.items():
        classes[find(c)] += [(*x, len(c)) for x in at]
    copies, out = {}, {}
    for at in classes.values():
        if len(at) > 1:
            keeper = min(at)
            for x in at:
                copies[x[:4]] = (x, keeper, x[:3] != keeper[:3])
    for key, (x, keeper, copy) in copies.items():
        removed = False
        if copy:
            mine = lambda k: (x[0], x[1], x[2], k) in copies and copies[x[0], x[1], x[2], k][2]
            low = high = x[3]
            while mine(low - 1):
                low -= 1
            while mine(high + 1):
                high += 1
            run = [copies[x[0], x[1], x[2], k] for k in range(low, high + 1)]
            n = sum(r[0][5] for r in run)
            own = spoken[x[:3]]
            (first, kept, _), (last, kept_last, _) = run[0], run[-1]
            other, i, j = spoken[kept[:3]], first[4] - 1, kept[4] - 1
            while i >= 0 and j >= 0 and own[i] == other[j]:
                n, i, j = n + 1, i - 1, j - 1
            other, i, j = spoken[kept_last[:3]], last[4] + last[5], kept_last[4] + kept_last[5]
            while i < len(own) and j < len(other) and own[i] == other[j]:
                n, i, j = n + 1, i + 1, j + 1
            removed = n >= substring.MIN_RUN
        out[(x[1] if x[0] else None, x[2], x[3])] = (keeper[1] if keeper[0] else None, removed)
    return out


def corpus(rng, n=60):
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    sentence = lambda: (" ".join(word() for _ in range(rng.randrange(3, 22))) + rng.choice([".", "!", "\n", ""])).capitalize()
    shared = [" ".join(sentence() for _ in range(rng.randrange(1, 8))) for _ in range(12)]
    texts = []
    for _ in range(n):
        parts = [sentence() for _ in range(rng.randrange(0, 12))]
        for passage in rng.sample(shared, rng.randrange(0, 3)):
            parts.insert(rng.randrange(0, len(parts) + 1), passage)
        texts.append(" ".join(parts))
    return texts + texts[:5] + [t + " end" for t in texts[5:10]]


def test_rows_against_brute_force(spark):
    rng = random.Random(2)
    texts = corpus(rng)
    # Null and shared ids, null and empty texts, repeated rows.
    ids = [rng.choice([None, i, i, i, i // 7]) for i in range(len(texts))]
    rows = [*zip(ids, texts), *list(zip(ids, texts))[:7], (None, None), (3, ""), (4, " \n "), (5, "few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = expected_rows(rows)
    for most in (500, 2):
        got = {(r.doc_id, r.row, r.paragraph): (r.keeper_id, r.removed) for r in substring.duplicates(df, max_group=most).collect()}
        assert len(expected) > 100 and sum(v[1] for v in expected.values()) > 50
        assert got == expected


def test_documents_against_brute_force(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    expected = expected_rows([tuple(r) for r in df.collect()])
    got = {(r.doc_id, r.row, r.paragraph): (r.keeper_id, r.removed) for r in substring.duplicates(df).collect()}
    # Banding finds a link of similarity 0.8 with probability 0.998.
    assert sum(got.get(k) != v for k, v in expected.items()) <= 0.01 * len(expected) and not set(got) - set(expected)


def test_links_of_groups():
    """The links of a group have the components of all similar pairs, by either way."""
    rng = random.Random(3)
    for _ in range(60):
        sets = {}
        while len(sets) < rng.choice([5, 40, 120]):
            base = list(range(rng.choice([0, 0, 100]), 0 + rng.choice([120, 130])))[: rng.randrange(8, 30)]
            for _ in range(rng.randrange(0, 5)):
                base[rng.randrange(len(base))] = rng.randrange(1000, 1040)
            sets[len(sets)] = frozenset(base)
        root = {c: c for c in sets}

        def find(root, c):
            while root[c] != c:
                c = root[c]
            return c

        for a in sets:
            for b in sets:
                if a < b and similar(sets[a], sets[b]):
                    root[find(root, a)] = find(root, b)
        mine = {c: c for c in sets}
        for a, b in substring.linked(sets):
            assert similar(sets[a], sets[b])
            mine[find(mine, a)] = find(mine, b)
        groups = lambda r: {frozenset(c for c in sets if find(r, c) == k) for k in {find(r, c) for c in sets}}
        assert groups(root) == groups(mine)


@pytest.mark.parametrize("most", [500, 8, 3])
def test_large_groups_are_dealt_again(spark, most):
    words = [f"w{i}" for i in range(14)]
    # All similar to one another; and near copies that are not similar, but share their words.
    texts = [" ".join(words[:-1] + [f"end{i}"]) for i in range(40)]
    other = [f"v{i}" for i in range(16)]
    texts += [" ".join(other[:k] + [f"mid{i}"] + other[k:]) for i in range(40) for k in [3 + i % 9]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = expected_rows(list(enumerate(texts)))
    got = {(r.doc_id, r.row, r.paragraph): (r.keeper_id, r.removed) for r in substring.duplicates(df, min_run=12, max_group=most).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()} and len(got) >= 40


def test_many_near_copies_of_one_sentence(spark):
    """20,000 copies, each with a word of its own somewhere: a group that no task may hold, and few links."""
    words = [f"word{i}" for i in range(15)]
    rows = [(i, " ".join(words[: i % 15] + [f"own{i}"] + words[i % 15 + 1 :])) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = substring.duplicates(df, min_run=10)
    # Only copies that differ in their first, or in their last word are similar; those of either kind are one class.
    got = found.groupBy("class_id").count().collect()
    assert sum(r["count"] for r in got) >= 2 * 1333 and max(r["count"] for r in got) >= 1333


@pytest.mark.parametrize("kind", ["plain", "lines", "short lines", "sentences"])
def test_recall_of_embedded_passages(spark, kind):
    """Of passages of 51 words within other texts, with or without any punctuation, nine in ten go."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9)))

    def body(n):
        out = [word() for _ in range(n)]
        if kind == "plain":
            return " ".join(out)
        if kind == "sentences":
            return " ".join(w + ("." if rng.random() < 0.1 else "") for w in out)
        step = 7 if kind == "lines" else 3
        return "\n".join(" ".join(out[i : i + step]) for i in range(0, n, step))

    passages, texts = [], []
    for _ in range(100):
        passages.append(body(51))
        texts += [f"{body(rng.randrange(5, 90))} {passages[-1]} {body(rng.randrange(5, 90))}" for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = {r.doc_id: r.text for r in substring.cut(df, substring.duplicates(df)).collect()}
    assert all(cut[2 * i] == texts[2 * i] for i in range(100))
    assert sum(p not in cut[2 * i + 1] for i, p in enumerate(passages)) >= 90
    for i, passage in enumerate(passages):
        before, after = texts[2 * i + 1].split(passage)
        if passage not in cut[2 * i + 1]:
            # A paragraph that is similar, not equal, takes a word of the host along or leaves one of the passage.
            assert abs(len(cut[2 * i + 1].split()) - len((before + after).split())) <= 5


def test_planted_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    sentence = lambda: (" ".join(word() for _ in range(rng.randrange(6, 16))) + ".").capitalize()
    passage = " ".join(sentence() for _ in range(9))
    texts = []
    for i in range(60):
        host = [sentence() for _ in range(12)]
        if i % 3 == 0:
            at = rng.randrange(1, 11)
            host[at] = host[at].replace(" ", f" {passage} ", 1)
        texts.append(" ".join(host))
    df = spark.createDataFrame([(i or None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = substring.repeats(substring.duplicates(df))
    assert {r.doc_id for r in found.collect()} == {i or None for i in range(60) if i % 3 == 0}
    assert {r.doc_id for r in found.where("NOT removed").collect()} == {None} == {r.keeper_id for r in found.collect()}
    cut = {r.doc_id: r.text for r in substring.cut(df, found).collect()}
    assert len(cut) == 60
    assert [i for i in range(60) if passage in cut[i or None]] == [0]
    assert all(cut[i or None] == texts[i] for i in range(60) if i % 3 or i == 0)
    assert all(cut[i].split() == texts[i].replace(passage, "").split() for i in range(3, 60, 3))


def test_runs_count_words_over_their_edges(spark):
    """One whole sentence of 9 words within a stretch of 28 that both documents have: removed with its edges."""
    a = "Alone here stand some words of the first one: north south east west up down left right now. Nine words make this very sentence in the middle. Then comes more of what both have got and after that only mine"
    b = "Others tell of a journey and of rain, north south east west up down left right now. Nine words make this very sentence in the middle. Then comes more of what both have got while here it ends"
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    cut = {r.doc_id: r.text for r in substring.cut(df, substring.duplicates(df)).collect()}
    assert cut == {1: a, 2: "Others tell of a journey and of rain, while here it ends"}


def test_other_columns_and_empty_tables(spark):
    text = "ein Satz, der zweimal vorkommt, mit genügend vielen Wörtern, damit er als Lauf zählt und im zweiten Text wegfällt, so weit er reicht."
    df = spark.createDataFrame([(1, text, "a", 2), (2, text + "\nRest", "b", 3)], "doc_id long, text string, row string, content long")
    cut = substring.cut(df, substring.duplicates(df))
    assert cut.columns == df.columns and sorted(tuple(r) for r in cut.collect()) == [(1, text, "a", 2), (2, "Rest", "b", 3)]
    assert substring.repeats(substring.duplicates(df.limit(0))).collect() == [] == substring.cut(df.limit(0), substring.duplicates(df)).collect()


def test_paragraphs_leave_no_words_out():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bc", "def", "Ä"]) + rng.choice([" ", "\n", ". ", "\n\n", "! ", "\x0b"]) for _ in range(rng.randrange(8, 300)))
        found, words = plain(text)
        assert [w for _, p in found for w in p] == words and min(len(p) for _, p in found) > paragraphs.NEAR
    found, _ = plain("same line\n" * 1000)
    assert len(found) >= 30 and len({p for _, p in found}) <= 3


def test_batches_do_not_matter():
    """A text's paragraphs are the same in any company, and however long it is; words are told by their letters."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["Uno", "dos.", "tres", "über", "VIER\n", "x" * 50], k=rng.choice([0, 1, 9, 300]))) for _ in range(50)]
    texts += ["y" * (words.BYTES + 9) + " z", " ".join(f"n{i}" for i in range(40_000)), " " * (2 * words.BYTES) + "a b c"]
    whole = paragraphs.Parsed(pa.array(texts))
    for i, text in enumerate(texts):
        alone = paragraphs.Parsed(pa.array([text]))
        mine = whole.text == i
        assert whole.content[mine].tolist() == alone.content.tolist()
        assert (whole.hash[whole.begin[i] : whole.begin[i + 1]] == alone.hash).all()
        assert [alone.data[a:b].tobytes() for a, b in zip(alone.start, alone.end)] == text.encode().split()
        assert len(set(alone.hash.tolist())) == len(set(text.encode().lower().split()))
    parts = list(words.parsed(iter([pa.RecordBatch.from_arrays([pa.array([*texts, None])], names=["t"])]), 0, paragraphs.Parsed, size=1000))
    assert np.concatenate([p.content for _, p in parts]).tolist() == whole.content.tolist()


def test_without():
    assert substring.without("a b c", [(2, 3)]) == "a c"
    assert substring.without("a\nb\nc", [(2, 3)]) == "a\nc"
    assert substring.without("ab", [(0, 2)]) == ""
