"""The operators of ``textpipe.llm`` against brute force, the libraries they match, and planted cases."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from textpipe.llm import backoff, bpe, decontaminate, kn_shards, langid, perplexity, quality_rules, queries, simhash, simple8b, substring, urls
from textpipe.llm.common import tokenizer_path
from textpipe.llm.components import components
from textpipe.llm.kn import Sorted

DATA = os.environ.get("TEXTPIPE_DATA", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None,
    "",
    " \n\t ",
    "a",
    "two words",
    "Ein Wort, zwei Wörter! ÄÖÜ ß",
    "x<|endoftext|>y <|startoftext|>",
    "ΑΣ İstanbul ﬁ ½² 日本語 テスト ٣٤ don't I'LL é",
    "a  \n\n b\t\r\n c   \x1c d\x1f ​",
    "🦀🦀 qx zj 12345 $$$ ***",
    "same line\nsame line\nother\n\nsame line",
    "the cat sat on the cat sat on the cat sat on",
    "123 456 !!!",
]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta", "eps", "zeta.", "eta", "theta!", "iota", "kappa\n", "lambda", "mu", "nu,", "xi"]
    long = " ".join(rng.choices(words, k=30_000))
    base = [" ".join(rng.choices(words, k=60)) for _ in range(30)]
    rows = [*ODD, long, *base, *base[:10], *[b + " end" for b in base[:5]], "x" * 50_000]
    # Extra columns, one with a name that operators use themselves, repeated rows, and a null id.
    table = [(i, t, "en" if i % 2 else "de", "s", i) for i, t in enumerate(rows)] + [(3, rows[3], "de", "s", 1), (None, "null id", None, None, None)]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, fp string, n_words long").repartition(3).cache()


@pytest.fixture(scope="module")
def documents(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{DATA}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- 1, 8: tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_the_library(name):
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(tokenizer_path(name)), bpe.ForcedBoundaryBPE(tokenizer_path(name))
    rng = random.Random(1)
    pool = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x250), 0x301, 0x3A3, 0x5D0, 0x4E00, 0x1F980, 9, 10, 13, 0x85, 0x2003)]
    texts = [t for t in ODD if t is not None] + ["".join(rng.choices(pool, k=rng.randrange(1, 60))) for _ in range(1500)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        packed = mine.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids, text
        assert mine.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_certain_cuts():
    """No token of the vocabulary lies across a cut, and there are cuts."""
    codec = bpe.ForcedBoundaryBPE(tokenizer_path("word_bpe_49k.json"))
    word = "qzxjqvkqx"
    assert len(codec._cut(word)) > 1 and "".join(codec._cut(word)) == word
    for token in random.Random(2).sample(codec.tokens, 2000):
        body = token.removesuffix("</w>")
        if token not in codec.special and body:
            assert codec._cut(body) == [body]


def test_op1(odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    expected = []
    for doc, text in pairs(odd):
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(odd).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert bpe.digests(odd.limit(0)).collect() == []
    # One pass, and the two operators one after the other, are the same; other tables than ids are carried along.
    rows = lambda df: sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), r.decoded) for r in df.collect())
    assert rows(bpe.round_trip(odd)) == rows(bpe.decode(bpe.encode(odd)))
    assert bpe.decode(bpe.encode(odd.limit(0))).collect() == []


def test_simple8b_words():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 59, 60, 61, 4095, 4096, 4097, 10_000):
        for high in (1, 2, 7, 255, 50_257, 2**31, 2**40, 2**63):
            ids = rng.integers(0, high, n, dtype=np.uint64)
            ids[rng.random(n) < 0.3] = 0
            words, offsets, escapes = simple8b.pack(ids)
            assert (simple8b.unpack(words, escapes) == ids).all()
            for b, start in enumerate(offsets):
                stop = offsets[b + 1] if b + 1 < len(offsets) else len(words)
                assert (simple8b.unpack(words[start:stop], escapes) == ids[b * simple8b.BLOCK_IDS : (b + 1) * simple8b.BLOCK_IDS]).all()
    payload = simple8b.segment_bytes([None, -5, 7], [2, 0, 1], np.array([1, 2**62, 3], dtype=np.uint64))
    docs, lengths, ids = simple8b.read_segment(payload)
    assert docs == [None, -5, 7] and lengths.tolist() == [2, 0, 1] and ids.tolist() == [1, 2**62, 3]
    with pytest.raises(ValueError):
        simple8b.read_segment(b"XXXX" + payload[4:])


def test_op8(odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    encoded = sorted(((doc is not None, doc or 0, library.encode(text or "", add_special_tokens=False).ids + [2]) for doc, text in pairs(odd)), key=lambda x: (x[0], x[1], len(x[2])))
    start, expected = 0, []
    for known, doc, ids in encoded:
        expected.append((doc if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in simple8b.round_trip(odd).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert simple8b.round_trip(odd.limit(0)).collect() == []


# ---------------------------------------------------------------- 2, 3, 6: SQL


@pytest.mark.parametrize("name", queries.ORACLES)
def test_against_sql(spark, documents, odd, name, tmp_path):
    """The smallest tables, and a table of odd texts."""
    odd.where("doc_id IS NOT NULL").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "alpha"), (2, None), (3, ""), (4, ODD[5]), (5, "beta gamma"), (11, " ".join(odd.where("doc_id = 20").first().text.split()[5:30]))], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    for at, glob in ((DATA, ""), (str(tmp_path), "/*.parquet")):
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet{glob}'")
        got = queries.QUERIES[name](spark, at).toPandas()
        expected = con.execute(queries.ORACLES[name]).df()
        if at != DATA and name == "op3_quality_rules":
            # Upper case beyond ASCII and odd letters are classed by each engine's own Unicode version.
            got, expected = got.drop(columns=["kept", "failed"]), expected.drop(columns=["kept", "failed"])
        rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
        assert rows(got) == rows(expected), at


def test_op2_blocks_follow_the_input(odd):
    """More blocks than shuffle partitions, for texts beyond the bound: the same scores."""
    few, many = backoff.scores(odd), backoff.scores(odd, block_bytes=1 << 14)
    assert many.rdd.getNumPartitions() > few.rdd.getNumPartitions()
    rounded = lambda df: sorted((str(r.doc_id), r.n_words, None if r.log_score is None else round(r.log_score, 6)) for r in df.collect())
    assert rounded(many) == rounded(few)


def test_empty_and_null(spark, odd):
    none = odd.limit(0)
    benchmark = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (backoff.scores(none), quality_rules.verdicts(none), simhash.classes(none), decontaminate.digest(none, benchmark), substring.duplicates(none), perplexity.classified(none, labels), langid.predictions(none), urls.verdicts(spark.createDataFrame([], "page_id long, url string"))):
        assert df.collect() == []
    assert {r.contaminated for r in decontaminate.digest(odd, benchmark).collect()} == {False}
    assert {(r.n_words > 0) == r.kept for r in perplexity.classified(odd, labels).collect()} == {True}
    unlabelled = odd.withColumn("lang", odd["doc_id"].cast("string").substr(9, 1).try_cast("int").cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.predictions(unlabelled).collect()} == {("und", 0.0)}


def plain_contamination(text, items):
    """Words, hit words and hit items of a text."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words = split(text)
    places = collections.defaultdict(list)
    for size in range(1, 14):
        for i in range(len(words) - size + 1):
            places[tuple(words[i : i + size])].append(i)
    hit, found = set(), set()
    for item, other in items:
        other = split(other)
        size = min(13, len(other))
        for i in range(len(other) - size + 1) if size else ():
            for at in places.get(tuple(other[i : i + size]), ()):
                hit.update(range(at, at + size))
                found.add(item)
    return len(words), len(hit), sorted(str(i) for i in found if i is not None)


@pytest.mark.parametrize("bits", [1 << 24, 1 << 15])
def test_decontamination(odd, spark, monkeypatch, bits):
    """Null, short, empty, equal and repeated items; null and shared ids of documents; maps that tell nearly nothing."""
    monkeypatch.setattr(decontaminate, "RARITY_BITS", bits)
    monkeypatch.setattr(decontaminate, "INDEX_BITS", bits)
    text = odd.where("doc_id = 20").first().text.split()
    items = [(i, " ".join(text[i : i + 20])) for i in range(0, 40, 7)] + [(99, "Alpha"), (98, "theta alpha"), (98, "mu nu"), (None, "kappa kappa"), (97, ""), (96, None), (95, " ".join(text[3:30])), (95, " ".join(text[3:30])), (94, "no such words")]
    rows = pairs(odd) + [(None, text and " ".join(text)), (7, "ALPHA-alpha ist über"), (7, "ALPHA-alpha ist über")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r["items"], sum(b - a for a, b in r.spans), r.contaminated) for r in decontaminate.contamination(docs, benchmark).collect())
    expected = []
    for doc, text in rows:
        n, hit, found = plain_contamination(text, items)
        expected.append((str(doc), n, hit, len(found), found, hit, bool(hit) and 20 * hit >= n))
    assert got == sorted(expected) and any(r[2] for r in got)
    extra = docs.selectExpr("doc_id", "text", "1 AS n_words", "'x' AS key", "2 AS text_hash")
    kept = decontaminate.clean(extra, benchmark)
    assert kept.columns == extra.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(e[0] for e in expected if not e[-1])


def test_ledger(spark, documents):
    book = quality_rules.ledger(documents).cache()
    kept = {r.doc_id: r for r in quality_rules.apply_policies(book).collect()}
    for row in quality_rules.ablation(book).collect():
        bit = 1 << quality_rules.BIT[row.rule]
        rest = quality_rules.CURRENT.mask & ~bit
        assert row.n_failed == sum(1 for r in kept.values() if r.failed & bit)
        assert row.n_kept_without == sum(1 for r in kept.values() if not r.failed & rest)
        assert row.n_failed_alone == row.n_kept_without - sum(1 for r in kept.values() if not r.failed & quality_rules.CURRENT.mask)


# ---------------------------------------------------------------- 4: SimHash


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fps = {}
    for doc, fp in rows:
        fps.setdefault(fp, []).append(doc)
    keys, seen, out = list(fps), set(), {}
    for k in keys:
        if k not in seen:
            group, todo = [], [k]
            seen.add(k)
            while todo:
                x = todo.pop()
                group.append(x)
                near = [y for y in keys if y not in seen and (x ^ y).bit_count() <= 2]
                seen.update(near)
                todo += near
            least = min(d for x in group for d in fps[x] if d is not None) if any(d is not None for x in group for d in fps[x]) else None
            out.update({(d, x): least for x in group for d in fps[x]})
    return out


def test_op4(odd, documents):
    for df in (odd, documents):
        rows = [(doc, plain_fingerprint(text)) for doc, text in pairs(df)]
        expected = plain_components(rows)
        got = {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in simhash.classes(df).collect()}
        assert got == expected


@pytest.mark.parametrize("most", [8192, 16])
def test_trie_join_of_dense_fingerprints(spark, most):
    """Clusters around few centres, one of them very large; with a small bound its subtrees are dealt again and again."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = set(centres)
    for c in centres[:1] * 500 + centres * 10:
        for _ in range(rng.randrange(1, 6)):
            c ^= 1 << rng.randrange(64)
        fps.add(c)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(3)
    roots = {r.v % (1 << 64): r.root % (1 << 64) for r in components(simhash.links(nodes, most)).collect()}
    expected = plain_components([(x, x) for x in fps])
    for x in fps:
        for y in fps:
            if x < y and (expected[(x, x)] == expected[(y, y)]) != (roots.get(x, x) == roots.get(y, y)):
                raise AssertionError((x, y))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(200)]
    rows = [*chain, *star, (5000, 5000), (None, 7), *[(b, a) for a, b in chain[:50]]]
    found = {r.v: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1201)}}


# ---------------------------------------------------------------- 5: URLs


def test_op5(spark):
    rules = sorted(urls.RULES, key=lambda r: -len(r[0]))
    given = ["https://a.example.com/en/7?x", "http://EXAMPLE.com/en/1", "https://xcom/en/", "https://com/en/", "http://b.example.net/de/8", "http://example.net/de/1#y", "http://x.org/es/q", "http://x.org/ES/q", "nope", "", None, "http://", "ftp://H/p?q://z", "http://q.org/fr/1", "http://q.net?de/"]
    given += [f"http://s{i % 7}.example.{t}/{l}/{i}" for i in range(60) for t in ("com", "net", "org") for l in ("en", "de", "es", "fr")]
    got = {r.page_id: r for r in urls.verdicts(spark.createDataFrame(list(enumerate(given)), "page_id long, url string")).collect()}
    assert len(got) == len(given)
    for i, url in enumerate(given):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.lower()
        fits = [(r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, fits[0][0] if fits else None), url
        assert r.verdict == fits[0][1] if fits else r.verdict in ("allow", "block")
    one = urls.verdicts(spark.createDataFrame([(1, "http://a.org/es/"), (2, "http://b.c/"), (2, "http://b.c/")], "page_id long, url string")).collect()
    assert sorted((r.page_id, r.verdict) for r in one) == [(1, "block"), (2, "block"), (2, "block")]


def test_op5_held_out_accuracy(spark):
    """Trees that never saw a url, nor its label in a suffix's statistics, agree with the rule on it."""
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    rng = random.Random(3)
    given = [(r.page_id, r.url) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    given += [(10_000 + i, f"http://{rng.choice(['a', 'www', 'x.y'])}.{rng.choice(['one', 'two', 'example'])}.{t}/{l}/{rng.randrange(99)}?p={i}") for i in range(900) for t, l in [rng.choice([("com", "en"), ("net", "de"), ("org", "es")])]]
    pages = spark.createDataFrame([*given, (None, None), (1, "http://com/en/")], "page_id long, url string")
    extra = pages.selectExpr("*", "'x' AS host", "1 AS label", "2 AS suffix", "3 AS ruling")
    assert sorted(map(str, urls.verdicts(extra).collect())) == sorted(map(str, urls.verdicts(pages).collect()))
    known = urls.ruled(urls.parsed(pages)).where("ruling IS NOT NULL")
    trees = urls.learned(known.where("page_id % 5 <> 0"))
    rows = trees.scored(known.where("page_id % 5 = 0")).select("ruling", "p").collect()
    assert len(rows) > 100 and sum((r.p > 0.5) == (r.ruling == "block") for r in rows) >= 0.9 * len(rows)


# ---------------------------------------------------------------- 9, 10: models


def test_sorted_hash_arrays():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    at = Sorted(h)
    found = at.find(h)
    assert (at.keys[found] == h * np.uint64(0x9E3779B97F4A7C15)).all() and (at.find(h + np.uint64(1)) == -1).sum() > 4900
    assert len(Sorted(h[:0]).find(h)) == len(h)


def test_kneser_ney_is_a_distribution(spark):
    """Probabilities over all units sum up to one after any context, and match the textbook formula for pairs."""
    rows = spark.createDataFrame([("m", "abracadabra"), ("m", "banana"), ("k", "xyzzy")], "model string, text string")
    from textpipe.llm.kn import Model, count

    model = Model(*count(rows, langid.units, 3, ["k", "m"]), 2, 3, modified=True)
    alphabet = sorted(set("abracadabrabananaxyzzy"))
    for context in ("", "a", "ab", "zz", "qq"):
        for k in range(2):
            total = sum(np.exp(model.score(langid.units(context + c))[k] - model.score(langid.units(context))[k]) for c in [*alphabet, "?"])
            assert abs(total - 1) < 1e-3
    texts = ["banana", "", "xyz" * 100, "abra"]
    many = model.score_many([langid.units(t) for t in texts])
    assert np.allclose(many, [model.score(langid.units(t)) for t in texts], atol=1e-3)


def test_op10_accuracy(documents):
    rows = langid.predictions(documents).collect()
    langs = {r.doc_id: (r.lang, r.text) for r in documents.collect()}
    tested = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and len(tested) > 20
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id][0] for r in tested) >= 0.98 * len(tested)
    assert all(0 <= r.score <= 1 for r in rows)


def test_op10_odd_texts(odd):
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.predictions(odd).collect()}
    texts = dict(pairs(odd))
    for doc, lang, score in got:
        assert (lang == "und") == (not any(map(str.isalpha, texts[doc] or ""))) and 0 <= score <= 1


def test_op9_separates_trusted_from_junk(spark):
    """Needs some hundred trusted documents."""
    data = DATA.replace("sf0.001", "sf0.01")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    documents, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = {r.doc_id: r for r in perplexity.classified(documents, labels).collect()}
    marks = {r.doc_id: r for r in labels.collect()}
    good = [got[d].kept for d, m in marks.items() if m.quality == 1 and not m.toxic]
    bad = [got[d].kept for d, m in marks.items() if m.quality == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.4 * len(bad)


def test_rare_languages_reject_foreign_texts(spark):
    """A language of ten documents is no door for texts of others, and keeps its own."""
    rng = random.Random(6)

    def speaker(letters):
        words = ["".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(60)]
        return lambda: " ".join(rng.choices(words, k=120))

    common, rare, single, foreign = speaker("abcdefgh"), speaker("ijklmnop"), speaker("qrstuvwx"), speaker("абвгдежз")
    rows = [(i, common(), "aa") for i in range(100)] + [(200 + i, rare(), "bb") for i in range(10)] + [(300, single(), "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages = langid.train(docs)
    assert np.isfinite(languages.limits).all()
    assert not any(languages.predict([rare() for _ in range(5)])[3]) and all(languages.predict([foreign() for _ in range(5)])[3])
    trusted = perplexity.train(docs, spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int"))
    assert np.isfinite(trusted.limits).all()
    assert all(trusted.judge(["bb"] * 5, [rare() for _ in range(5)])[3]) and not any(trusted.judge(["bb"] * 5, [foreign() for _ in range(5)])[3])


class PlainKneserNey:
    """Interpolated Kneser-Ney of one model by the textbook, with tuples and dictionaries."""

    def __init__(self, texts, order, modified, units):
        self.order = order
        counts = {order: collections.Counter()}
        for t in texts:
            t = [None] * (order - 1) + t
            counts[order].update(tuple(t[i : i + order]) for i in range(len(t) - order + 1))
        for k in range(order - 1, 0, -1):
            counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
        self.counts, self.units = counts, units
        self.discount, self.total, self.lost = {}, {}, {}
        for k, c in counts.items():
            n = [sum(v == i for v in c.values()) for i in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
            d = [0, y, y, y]
            if modified:
                d = [0] + [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] and n[i] else y for i in (1, 2, 3)]
                d = [0] + [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d[1:], 1)]
            self.discount[k] = d
            self.total[k], self.lost[k] = collections.Counter(), collections.Counter()
            for g, v in c.items():
                self.total[k][g[:-1]] += v
                self.lost[k][g[:-1]] += d[min(v, 3)]

    def p(self, gram):
        if not gram:
            return 1 / (self.units + 1)
        k, below = len(gram), self.p(gram[1:])
        total = self.total[k][gram[:-1]]
        if not total:
            return below
        c = self.counts[k][gram]
        return (c - self.discount[k][min(c, 3)]) / total + self.lost[k][gram[:-1]] / total * below

    def entropy(self, text):
        text = [None] * (self.order - 1) + text
        return -sum(np.log(self.p(tuple(text[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(text)))


@pytest.mark.parametrize("modified", [False, True])
def test_models_against_a_plain_one(spark, modified):
    """Every text's log probability in every model is that of the textbook's formula."""
    from textpipe.llm import kn

    rng = random.Random(4)
    names = ["a", "b"]
    rows = [(rng.choice(names), " ".join(rng.choices(["to", "be", "or", "not", "that", "is"], weights=[9, 7, 5, 3, 2, 1], k=rng.randrange(0, 40)))) for _ in range(80)]
    df = spark.createDataFrame(rows, "model string, text string")
    order = 3
    model = kn.Model(*kn.count(df, perplexity.units, order, names), len(names), order, modified=modified)
    units = len({w for _, t in rows for w in t.split()})
    plain = [PlainKneserNey([t.split() for m, t in rows if m == name], order, modified, units) for name in names]
    texts = [t for _, t in rows[:20]] + ["to be or new", "new words only", "is is is"]
    got = model.score_many([perplexity.units(t) for t in texts])
    for text, row in zip(texts, got):
        assert np.allclose(row, [-p.entropy(text.split()) for p in plain], rtol=1e-4, atol=1e-3), text


def test_samples_are_bounded(spark):
    """A hot id, repeated rows and very long texts do not get past the bounds of a sample."""
    rows = [(7, f"wort nummer {i} steht hier", "de") for i in range(3000)] + [(8, "immer dieselbe Zeile", "de")] * 3000 + [(9, "lang " * 100_000, "de"), (None, "ohne Nummer", "de")]
    df = spark.createDataFrame(rows, "id long, text string, model string")
    from pyspark.sql import functions as F

    from textpipe.llm import kn

    got = kn.sample(df.withColumn("h", F.xxhash64("text")), "model", ["id", "h"], 100)
    assert got.count() <= 160
    known = langid.train(df.withColumnRenamed("id", "doc_id").withColumnRenamed("model", "lang"), max_bytes=1000)
    assert known.names == ["de"]


def test_op9_rounds_exchange_every_gram_once(spark):
    """Rounds share out the shards, none sends what another one sent; repeated rows, shared and null ids, and texts without words keep their rows."""
    rows = [(1, "to be or not to be", "en"), (1, "to be or not to be", "en"), (1, "to see or not to see", "en"), (None, "to be or", None), (None, "to be or", None), (2, "", "en"), (3, None, None), (4, "sein oder nicht sein", "de"), (5, "neu to sein be", "xx")] * 2
    texts = [perplexity.units(t) for _, t, _ in rows if t]
    turns = kn_shards._turns(7, 3)
    assert [s for turn in turns for s in turn] == list(range(7))
    whole, parts = (sorted(x for turn in given for x in kn_shards._grams(texts, np.arange(len(texts)), 7, turn)) for given in ([range(7)], turns))
    assert whole == parts and len({s for s, *_ in whole}) > 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learnt = docs.where("lang IN ('de', 'en')").selectExpr("lang AS model", "text")
    results = []
    for learning, rounds in ((1, 1), (2, 3)):
        counts = kn_shards.learn(learnt, perplexity.units, ["de", "en"], 7, learning)
        found = kn_shards.entropies(docs, perplexity.units, ["de", "en"], counts, rounds).collect()
        results.append(sorted((str(r.doc_id), str(r.lang), r.n_words, str(r.model), round(r.h or 0.0, 6)) for r in found))
    assert len(results[0]) == len(rows) and results[0] == results[1]


def test_op9_numbers_tell_words_apart():
    """One number for each word, in any company and of any length: equal words and no others have equal ones."""
    rng = random.Random(7)
    texts = ["", None, " ", "a\x0bb\x1cc", "a", "a\x00", "a\x00\x00", "Ünï ÄB", *("a" * n for n in (8, 9, 16, 17, 64, 65, 1000))]
    texts += ["".join(rng.choices("abAB \n\x00é", k=rng.randrange(200))) for _ in range(1000)] + ["".join(rng.choices("ab", k=rng.randrange(1, 150))) for _ in range(1000)]
    words, numbers = [(t or "").encode().lower().split() for t in texts], perplexity.units.many(texts)
    assert [len(x) for x in words] == [len(x) for x in numbers]
    assert all((perplexity.units(t) == x).all() for t, x in zip(texts, numbers))
    words, numbers = [w for x in words for w in x], np.concatenate(numbers).tolist()
    assert len(set(words)) == len(set(numbers)) == len(set(zip(words, numbers)))


@pytest.mark.parametrize("again", [False, True])
def test_op9_rows_do_not_grow_with_rounds(spark, monkeypatch, again):
    """However many rounds, a document reaches the sums once; where each round reads in another order, results are the same."""
    rows = [(i // 2 or None, " ".join(f"w{(i // 2) * k % 11}" for k in range(i % 9)), ("en", "de", None)[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)

    def mixed_up(batches):
        for batch in batches:
            yield batch.take(pa.array(random.SystemRandom().sample(range(batch.num_rows), batch.num_rows), pa.int64()))

    read = docs.mapInArrow(mixed_up, docs.schema) if again else docs
    counts = kn_shards.learn(docs.where("lang IS NOT NULL").selectExpr("lang AS model", "text"), perplexity.units, ["de", "en"], 7)
    grouped, kept = [], type(docs).groupBy
    monkeypatch.setattr(type(docs), "groupBy", lambda self, *cols: (grouped.append((cols, self)), kept(self, *cols))[1])
    found, taken = [], []
    for rounds in (1, 4):
        got = kn_shards.entropies(read, perplexity.units, ["de", "en"], counts, rounds)
        taken.append(next(df for cols, df in grouped if "model" in cols))
        grouped.clear()
        found.append(sorted((str(r.doc_id), str(r.lang), r.n_words, str(r.model), round(r.h or 0.0, 5)) for r in got.collect()))
    assert found[0] == found[1] and len(found[0]) == len(rows)
    slots = sum(2 if lang is None and text else 1 for _, text, lang in rows)
    assert taken[0].count() == slots
    assert again or taken[1].count() == slots


def test_op9_learns_from_all_trusted_documents(spark):
    """Every count of hundreds of documents, one of them very long: the textbook's entropies and the limits of all held-back ones."""
    rng = random.Random(12)
    letters = "abcdefghijklm"
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 4))) for _ in range(80)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 40))), "aa" if i % 7 else "bb") for i in range(900)]
    rows.append((900, " ".join(rng.choices([*words, "seltenes"], k=80_000)), "aa"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    back = {r.doc_id for r in docs.where(F.pmod(F.xxhash64(F.lit("held back"), "doc_id"), F.lit(5)) == 0).collect()}
    trusted = perplexity.train(docs, labels)
    units = len({w for i, t, _ in rows if i not in back for w in t.split()})
    plain = {k: PlainKneserNey([t.split() for i, t, lang in rows if lang == k and i not in back], 3, True, units) for k in ("aa", "bb")}
    entropy = lambda k, t: plain[k].entropy(t.split()) / len(t.split())
    got = {r.doc_id: r for r in perplexity.judge(docs, trusted).collect()}
    assert len(got) == len(rows)
    for i, text, lang in rows[::25]:
        assert (got[i].perplexity is None) == (not text)
        assert not text or abs(np.log(got[i].perplexity) - entropy(lang, text)) < 1e-4
    for k, name in enumerate(trusted.names):
        held = [(entropy(lang, t), len(t.split())) for i, t, lang in rows if i in back and lang == name and t]
        h, n = np.array(held).T
        centre = np.median(h)
        assert abs(trusted.centres[k] - centre) < 1e-4
        assert abs(trusted.limits[k] - np.quantile((h - centre) * np.sqrt(n / (n + perplexity.HALF)), perplexity.QUANTILE) - perplexity.MARGIN) < 1e-4
    # In rounds nothing changes.
    found, several = (sorted((r.doc_id, r.n_words, r.h and round(r.h, 6)) for r in kn_shards.entropies(docs, perplexity.units, trusted.names, trusted.counts, k).collect()) for k in (1, 3))
    assert found == several and len(found) == len(rows)
    # Without a model of its own a text gets the best one's; unknown words, and none.
    texts = ["zz yy xx", "", rows[7][1], "seltenes wort"]
    for text, p in zip(texts, trusted.judge([None, "aa", "cc", "aa"], texts)[1]):
        assert (p is None) == (not text)
    free = trusted.judge([None], [rows[7][1]])[1][0]
    assert abs(np.log(free) - min(entropy(k, rows[7][1]) for k in plain)) < 1e-4
