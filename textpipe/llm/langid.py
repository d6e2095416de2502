"""Language identification by character Kneser-Ney models.

One interpolated Kneser-Ney model of 4-character grams for each language that the training
rows name, all in common sorted hash arrays (:mod:`.kn`).  A text gets the language whose
model gives the lowest cross-entropy per character.  The models learn from at most about
``max_docs`` labelled documents of each language, of ``max_bytes`` at most, chosen by a hash
of id and text (repeated rows once); a fifth of the sample is held back, and a text is rejected if its cross-entropy is above all that the
held-back documents of the language make likely.  A language with fewer than five of these
is calibrated by scores of its documents under models of its others, and where these are
fewer than five as well, with the spread of the other languages; a language of a single
document gets the median limit of the others.  Only where no language has two documents
is there nothing to calibrate by, and nothing is rejected for its score.

Null texts and texts without a letter are ``und`` with score 0 and are rejected.  Of languages that fit a text equally well the first by name is predicted.  Without
any labelled row nothing is learned and every text is ``und``.  Repeated rows get equal
answers; ids and sources are never looked at for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, written
from .kn import FEW, MAX_BYTES, Model, count, left_out, sample

ORDER = 4
MAX_DOCS = 300
UNKNOWN = "und"
#: Characters' worth of evidence that the score takes into account.
EVIDENCE = 100
#: A text is rejected beyond this many standard deviations, or this multiple, of the held-back documents' mean.
REJECT_SD, REJECT_RATIO = 8.0, 1.5


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def units(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, plus one."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64) + np.uint64(1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Languages:
    """The learned models, their languages, and each one's limit of cross-entropy."""

    def __init__(self, names: list[str], model: Model, limits: np.ndarray):
        self.names, self.model, self.limits = names, model, limits

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None], list[bool]]:
        """Language, score, cross-entropy per character and rejection of each text."""
        coded = [units(t) if has_letter(t) else units(None) for t in texts]
        if not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)
        sums = self.model.score_many(coded)
        lang, score, entropy, reject = [], [], [], []
        for x, s in zip(coded, sums):
            if not len(x):
                lang.append(UNKNOWN), score.append(0.0), entropy.append(None), reject.append(True)
                continue
            h = -s / len(x)
            best = int(np.argmin(h))
            p = np.exp(-(h - h[best]) * min(len(x), EVIDENCE))
            lang.append(self.names[best]), score.append(float(1.0 / p.sum())), entropy.append(float(h[best])), reject.append(bool(h[best] > self.limits[best]))
        return lang, score, entropy, reject


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Languages:
    """Models from the labelled rows given; rows with a null text or language are left out."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("model")).where("text IS NOT NULL AND model IS NOT NULL")
    rows = sample(rows.where(F.octet_length("text") <= max_bytes).withColumn("h", F.xxhash64("text")), "model", ["id", "h"], max_docs)
    rows = written(rows.withColumn("back", F.pmod(F.xxhash64(F.lit("held back"), "id"), F.lit(5)) == 0), "labelled")
    names = sorted(r[0] for r in rows.select("model").distinct().toLocalIterator())
    model = Model(*count(rows.where("NOT back"), units, order, names), len(names), order, modified=False)
    means = [r for r in _entropies(rows.where("back"), model, names)]
    each = [[h for k, h in means if k == i] for i in range(len(names))]
    rare = [i for i in range(len(names)) if len(each[i]) < FEW]
    for i in rare:
        each[i] = []
    for learnt, scored in left_out(rows, [names[i] for i in rare], "id"):
        for i, h in _entropies(scored, Model(*count(learnt, units, order, names), len(names), order, modified=False), names):
            each[i].append(h)
    return Languages(names, model, _limits(each))


def _limits(each: list[list[float]]) -> np.ndarray:
    """The limit of each language from its documents' cross-entropies, those of few from the spread of the others."""
    limits, ratios = np.full(len(each), np.inf), []
    for i, mine in enumerate(map(np.array, each)):
        if len(mine) >= FEW:
            limits[i] = max(mine.mean() + REJECT_SD * mine.std(), REJECT_RATIO * mine.mean(), 1.05 * mine.max())
            ratios.append(limits[i] / mine.mean())
    ratio = float(np.median(ratios)) if ratios else REJECT_RATIO
    for i, mine in enumerate(map(np.array, each)):
        if 0 < len(mine) < FEW:
            limits[i] = max(ratio * mine.mean(), 1.05 * mine.max())
    known = limits[np.isfinite(limits)]
    if len(known):
        limits[~np.isfinite(limits)] = np.median(known)
    return limits


def _entropies(rows: DataFrame, model: Model, names: list[str]) -> list[tuple[int, float]]:
    """Model and cross-entropy of each held-back document: a few numbers of a bounded sample."""
    sent, place = rows.sparkSession.sparkContext.broadcast(model), {k: i for i, k in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            which = [place[m] for m in batch.column(0).to_pylist()]
            coded = [units(t) if has_letter(t) else units(None) for t in batch.column(1).to_pylist()]
            sums = sent.value.score_many(coded)
            kept = [(k, -s[k] / len(x)) for k, x, s in zip(which, coded, sums) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int32()), pa.array([h for _, h in kept], pa.float64())], names=["model", "h"])

    return [(r.model, r.h) for r in rows.select("model", "text").mapInArrow(run, "model int, h double").toLocalIterator()]


def identify(docs: DataFrame, languages: Languages, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with ``lang_pred``, ``score`` (0 to 1), ``entropy`` (nats per character) and ``rejected``."""
    kept = docs.select(*keep).schema
    sent = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lang, score, entropy, reject = sent.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(reject, pa.bool_())], names=[*kept.names, "lang_pred", "score", "entropy", "rejected"])

    schema = T.StructType([*kept.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def predictions(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all."""
    docs = docs.select("doc_id", "text", "lang")
    languages = train(docs.where(~held_out()))
    return identify(docs, languages).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")
