"""The registered queries of this package, one ``opN_`` for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, bpe, decontaminate, langid, perplexity, quality_rules, simhash, simple8b, substring, urls
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op2_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff.scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(substring.duplicates(table(spark, sf_dir, "documents"))).drop("row", "kept_row", "kept_paragraph")


def op8_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(table(spark, sf_dir, "documents"))


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_stupid_backoff, op3_quality_rules, op4_simhash, op5_url_filter, op6_decontamination, op7_substring_dedup, op8_simple8b, op9_perplexity, op10_language_id)}

_WORDS = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op2_stupid_backoff": rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM t),
x AS (SELECT doc_id, i, w[i] AS cur, CASE WHEN i > 1 THEN w[i - 1] END AS prev FROM p),
one AS (SELECT cur AS v, count(*) AS c FROM x GROUP BY 1),
own AS (SELECT doc_id, prev, cur, count(*) AS n FROM x WHERE prev IS NOT NULL GROUP BY 1, 2, 3),
two AS (SELECT prev, cur, sum(n) AS c FROM own GROUP BY 1, 2),
total AS (SELECT sum(c) AS n FROM one),
part AS (SELECT own.doc_id, CASE WHEN two.c > own.n THEN own.n * (ln((two.c - own.n)::DOUBLE) - ln(a.c::DOUBLE)) ELSE own.n * (ln(0.4) + ln(b.c::DOUBLE) - ln(total.n::DOUBLE)) END AS s
  FROM own JOIN two ON own.prev = two.prev AND own.cur = two.cur JOIN one a ON a.v = own.prev JOIN one b ON b.v = own.cur, total
  UNION ALL SELECT doc_id, ln(0.4) + ln(c::DOUBLE) - ln(total.n::DOUBLE) FROM x JOIN one ON one.v = x.cur, total WHERE i = 1),
s AS (SELECT doc_id, sum(s) AS s FROM part GROUP BY 1),
n AS (SELECT doc_id, sum(len(w))::BIGINT AS n_words FROM t GROUP BY 1)
SELECT n.doc_id, n_words, round(s, 3) AS log_score, round(s / n_words, 6) AS mean_log_score FROM n LEFT JOIN s ON n.doc_id IS NOT DISTINCT FROM s.doc_id""",
    "op3_quality_rules": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_WORDS}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM d, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(text, '[^\p{{L}}]+', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper, len(list_distinct(w))::BIGINT AS n_distinct
  FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 AS b0, 100 * n_repeat_words > 50 * n_words AS b1, 10 * n_dup_lines > 3 * n_lines AS b2, 10 * n_symbols > n_words AS b3, word_chars > 12 * n_words OR word_chars < 2 * n_words AS b4, 2 * n_letters < word_chars AS b5, 2 * n_upper > n_letters AND n_words >= 1 AS b6, 4 * n_distinct < n_words AND n_words < 2000 AS b7 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b0 OR b1 AS base_failed, NOT (b0 OR b1 OR b2 OR b3 OR b5 OR b6) AS kept,
  (b0::BIGINT + 2 * b1::BIGINT + 4 * b2::BIGINT + 8 * b3::BIGINT + 16 * b4::BIGINT + 32 * b5::BIGINT + 64 * b6::BIGINT + 128 * b7::BIGINT) AS failed FROM b""",
    "op6_decontamination": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, k)),
h AS (SELECT r, item_id, p, iw.k FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
n AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM h) GROUP BY r),
a AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(a.n, 0)::BIGINT AS n_items, sha256(coalesce(a.s, '')) AS items_sha256, coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN a USING (r)""",
}
