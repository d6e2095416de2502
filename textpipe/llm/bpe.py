"""BPE encoding and decoding with forced boundaries.

A merge only ever makes a token of the vocabulary.  Two bytes that are neighbours in no
token can therefore never end up in one token, and the cut between them is certain: the
fragments on either side are encoded independently and their ids are concatenated.  The
table of allowed neighbours (256 x 256 flags) comes from the vocabulary alone.  Fragments
repeat far more often than words, so their ids are kept in bounded caches.

Texts: null counts as the empty text; an empty text has no ids; texts of any length are
handled whole, one document at a time.  Repeated rows each get their own row.  Only the
id and text columns are read.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, release, sliced, tokenizer_path

#: Code points below this one have had fixed categories and case pairs (which stay below it, but
#: for a combining dot) for decades, hence Python's own tables hold; a text with any other goes
#: through the library's normaliser and splitter.
PLAIN_LIMIT = 0x180

#: Words whose ids are kept, by splitter.
CACHE_ENTRIES = {"words": 120_000, "bytes": 250_000}


def _class(test) -> str:
    return "".join(f"\\u{c:04x}" for c in range(PLAIN_LIMIT) if test(chr(c)))


_LETTER = _class(lambda c: unicodedata.category(c)[0] == "L")
_NUMBER = _class(lambda c: unicodedata.category(c)[0] == "N")
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
_OTHER_THAN_PLAIN = re.compile(f"[^\\x00-\\u{PLAIN_LIMIT - 1:04x}]")
_CONTRACTION = "'s|'t|'re|'ve|'m|'ll|'d"
#: What the two vocabularies' splitters match, for plain texts.
SPLITTERS = {
    "words": re.compile(f"{_CONTRACTION}|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+"),
    "bytes": re.compile(f"{_CONTRACTION}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"),
}


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in keep else next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens of a vocabulary file by id, and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.spec = spec
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: int(t["id"]) for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.decodes_bytes = bool(spec["decoder"])
        if self.decodes_bytes:
            value = {c: b for b, c in enumerate(byte_alphabet())}
            self.token_bytes = [t.encode() if t in self.special or not all(c in value for c in t) else bytes(value[c] for c in t) for t in self.tokens]

    def decode(self, ids: bytes) -> str:
        """The text that the library's ``decode(ids, skip_special_tokens=False)`` returns."""
        found = np.frombuffer(ids, dtype="<u4").tolist()
        if self.decodes_bytes:
            return b"".join(map(self.token_bytes.__getitem__, found)).decode("utf-8", "replace")
        return " ".join(map(self.tokens.__getitem__, found))


class ForcedBoundaryBPE(Vocabulary):
    """Encoder and decoder for one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path
        spec, model = self.spec, self.spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        kind = "words" if self.suffix else "bytes"
        self.split = SPLITTERS[kind]
        self.piece = None if self.suffix else _by_rank(model["vocab"], merges)
        self.lower = bool(spec["normalizer"])
        self.alphabet = byte_alphabet()
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.inside = self._neighbours(model["vocab"])
        del self.spec, spec, model, merges
        self.words = _Cache(self._plain_word, CACHE_ENTRIES[kind])
        self.mapped = _Cache(self._word, 20_000)
        self.fragments = {True: _Cache(lambda x: self._fragment(self.last, x), 20_000), False: _Cache(lambda x: self._fragment(self.inner, x), 20_000)}

    @functools.cached_property
    def library(self):
        """The library's own tokenizer, for texts beyond the plain ones."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _model(self, suffix: str | None):
        from tokenizers.models import BPE

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        return BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **({"end_of_word_suffix": suffix} if suffix else {}))

    @functools.cached_property
    def inner(self):
        """Merges of fragments that do not end a word."""
        return self._model(None)

    @functools.cached_property
    def last(self):
        """Merges of fragments that do."""
        return self._model(self.suffix) if self.suffix else self.inner

    def _neighbours(self, vocab: dict[str, int]) -> dict[str, set[str]]:
        """For each character of the byte alphabet those that follow it inside some token: anywhere else the cut is certain."""
        inside: dict[str, set[str]] = {c: set() for c in self.alphabet}
        for token in vocab:
            body = token.removesuffix(self.suffix) if self.suffix else token
            for a, b in zip(body, body[1:]):
                if a in inside:
                    inside[a].add(b)
        return inside

    def _cut(self, word: str) -> list[str]:
        inside, parts, start = self.inside, [], 0
        for i in range(1, len(word)):
            if word[i] not in inside[word[i - 1]]:
                parts.append(word[start:i])
                start = i
        parts.append(word[start:])
        return parts

    @staticmethod
    def _fragment(model, part: str) -> bytes:
        return array("I", [t.id for t in model.tokenize(part)]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one word in the byte alphabet."""
        parts = self._cut(word)
        if len(parts) == 1:
            return self._fragment(self.last, word)
        inner = self.fragments[False]
        return b"".join([inner[p] for p in parts[:-1]]) + self.fragments[True][parts[-1]]

    def _plain_word(self, word: str) -> bytes:
        if self.piece is not None:
            return array("I", self.piece(word.encode())).tobytes()
        return self._word("".join([self.alphabet[b] for b in word.encode()]))

    def forget(self) -> None:
        """Drops the words that were kept; they are encoded again when they come."""
        for cache in (self.words, self.mapped, *self.fragments.values()):
            cache.clear()

    def _encode_part(self, text: str) -> bytes:
        if _OTHER_THAN_PLAIN.search(text) is None:
            return b"".join(map(self.words.__getitem__, self.split.findall(text.lower() if self.lower else text)))
        if self.lower:
            text = self.library.normalizer.normalize_str(text)
        return b"".join([self.mapped[w] for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)])

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special_at is None or not self.special_at.search(text):
            return self._encode_part(text)
        return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if p in self.special else self._encode_part(p) for p in self.special_at.split(text) if p)


def _by_rank(vocab: dict[str, int], merges: list[tuple[str, str]]):
    """A faster encoder of single words, for vocabularies without word ends whose ids are in the order of the merges."""
    made = [vocab[a + b] for a, b in merges]
    if made != sorted(set(made)):
        return None
    import tiktoken

    value = {c: b for b, c in enumerate(byte_alphabet())}
    ranks = {bytes(value[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class _Cache(dict):
    """A dict that fills itself and starts anew when it is full; long keys are not kept."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        out = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = out
        return out


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as native 32-bit integers, which must be little-endian")

_LOADED: dict[tuple[type, str], Vocabulary] = {}


def codec(path: str, kind: type = ForcedBoundaryBPE):
    """One codec for each worker process and file; a worker that only decodes loads no more than the tokens."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
        vars(_LOADED[kind, path]).pop("spec", None)
        release()
    return _LOADED[kind, path]


def encode(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` (long) and ``ids`` (binary: little-endian unsigned 32-bit ids) of each row.

    ``vocabulary`` is a file name among the public vocabularies or a path that the executors can open.
    """
    path = vocabulary if "/" in vocabulary else tokenizer_path(vocabulary)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in sliced(batches):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "n_tokens", "ids"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str = "word_bpe_49k.json", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text; a null list of ids decodes to the empty text."""
    path = vocabulary if "/" in vocabulary else tokenizer_path(vocabulary)
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, Vocabulary)
        for batch in sliced(batches):
            texts = [bpe.decode(x or b"") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())]))


def round_trip(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass: ``id_col``, ``n_tokens``, ``ids`` and ``decoded`` of each row.

    One worker process does both with one vocabulary; chained, each would need its own.
    """
    path = vocabulary if "/" in vocabulary else tokenizer_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], names=[id_col, "n_tokens", "ids", "decoded"])
        # The worker stays for later stages, which need its memory more than a later task of this one needs its words.
        bpe.forget()
        release()

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Encode, decode, and the digests of both."""
    both = round_trip(docs, vocabulary)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
