"""Quality rules as a bitmask ledger; DataFrame functions only.

Every rule is evaluated once per document.  The ledger keeps the measurements and a long
with one failure bit for each rule, and everything later is bit arithmetic on it: a policy
is a mask of rules under a version, a document passes a policy if none of its bits is
failed, and ablations (what would be kept without one rule, what only one rule removes) are
sums over ``failed & mask``.  Adding a policy version reads the ledger, never the texts.

Null or empty texts have no words and fail ``few_words``.  A text's words, lines and
windows stay within its row, so repeated rows, ties and hot sources need no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

SYMBOLS = "#*$%&|<>"
_GAPS = r"[\x20\x09-\x0D]+"

#: Name of each rule by bit, and its condition of failure over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("symbols", "10 * n_symbols > n_words"),
    ("word_length", "word_chars > 12 * n_words OR word_chars < 2 * n_words"),
    ("no_letters", "2 * n_letters < word_chars"),
    ("shouting", "2 * n_upper > n_letters AND n_words >= 1"),
    ("one_word_repeated", "4 * n_distinct_words < n_words AND n_words < 2000"),
)
BIT = {name: k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = (BASE, Policy("v1", ("few_words", "repeated_windows", "repeated_lines", "symbols", "no_letters", "shouting")), Policy("v2", tuple(name for name, _ in RULES)))
CURRENT = POLICIES[1]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the measurements, all long."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Steps are separate projections: an array used more than once is a column, computed once for each row.
    words = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("w", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = words.select(
        "doc_id",
        "text",
        "w",
        lines.alias("lines"),
        F.sort_array(F.transform(F.expr("IF(size(w) < 3, CAST(array() AS array<int>), sequence(0, size(w) - 3))"), lambda i: F.struct(F.concat_ws(" ", F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2]).alias("g"), i.alias("p")))).alias("s"),
    )
    # Equal windows are neighbours once sorted; the places of those found twice or more, in order.
    step = step.select(
        "doc_id",
        "text",
        "w",
        "lines",
        F.sort_array(F.expr("transform(filter(s, (x, i) -> (i > 0 AND x.g = s[i - 1].g) OR (i < size(s) - 1 AND x.g = s[i + 1].g)), x -> x.p)")).alias("d"),
    )
    letters = F.regexp_replace("text", r"[^\p{L}]+", "")
    return step.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", _GAPS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # A window covers three words, or as many as there are before the next one starts.
        F.expr("aggregate(transform(d, (p, i) -> IF(i = size(d) - 1, 3, least(3, d[i + 1] - p))), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.length(letters).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failed`` (long: bit k is set if rule k fails), one row for each document."""
    bits = " | ".join(f"IF({test}, {1 << k}L, 0L)" for k, (_, test) in enumerate(RULES))
    return measured(docs, id_col, text_col).withColumn("failed", F.expr(bits))


def passes(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) == 0


def apply_policies(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The ledger with a boolean ``kept_<version>`` for each policy."""
    return book.withColumns({f"kept_{p.version}": passes(p) for p in policies})


def ablation(book: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it removes, and that are kept without it.

    One pass of bitwise aggregation: failure patterns are counted first (at most 2^rules rows), rules are looked up in them after.
    """
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit")) for r in policy.rules]))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    fails, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(alone | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def verdicts(docs: DataFrame) -> DataFrame:
    book = apply_policies(ledger(docs))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE)).alias("base_failed"), F.col(f"kept_{CURRENT.version}").alias("kept"), "failed")
