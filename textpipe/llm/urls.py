"""URL filter: longest rule, else gradient-boosted trees; DataFrame functions only.

A rule is ``host/path``: it fits its host and all subdomains, if the url's path starts with
the rule's; the longest that fits decides.  Urls that no rule fits get the verdict of
boosted trees over lexical features: length, depth, share of digits, entropy of the
characters, numbers of parameters, hyphens and host labels, and statistics of the host's
suffix.  The trees learn from urls that a rule decides, at most about ``MAX_TRAIN`` of them
(a documented bound, chosen by a hash of id and url).  The suffix statistics come from that
sample too, hence are no more rows than it has and are broadcast; a row learns from those
of the other folds alone, so that its own label is no part of its features.

Null urls and urls without ``://`` have an empty host and path and fit no rule; they are
scored like others.  With no labelled urls, or urls of one verdict only, there is nothing to
learn: the verdict is that one, or ``allow``.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The contract's rules, longest first is how they are tried.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
MAX_TRAIN = 20_000
TREES, DEPTH, SEED = 12, 4, 7
PRIOR, FOLDS = 10.0, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("f_length", "f_host_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_labels", "f_suffix_rate", "f_suffix_n")


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``url`` (null as empty), ``host`` and ``path``."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    out = pages.select(F.col(id_col).alias("page_id"), url.alias("url")).withColumn("rest", rest)
    out = out.withColumn("raw_host", F.regexp_extract("rest", r"\A[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(rest, length(raw_host) + 1)"), r"\A[^?#]*", 0)
    return out.select("page_id", "url", F.translate("raw_host", UPPER, LOWER).alias("host"), path.alias("path"))


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)


def ruled(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """With ``rule`` and ``ruling``, both null where no rule fits."""
    rule, ruling = None, None
    for text, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        rule = F.when(_fits(text), text) if rule is None else rule.when(_fits(text), text)
        ruling = F.when(_fits(text), verdict) if ruling is None else ruling.when(_fits(text), verdict)
    return urls.withColumn("rule", F.lit(None).cast("string") if rule is None else rule).withColumn("ruling", F.lit(None).cast("string") if ruling is None else ruling)


def features(urls: DataFrame) -> DataFrame:
    """The lexical features but for those of the suffix, and ``suffix``: the last two labels of the host."""
    n = F.length("url").cast("double")
    counts = F.transform(F.array_distinct(F.split("url", "")), lambda c: F.length("url") - F.length(F.replace(F.col("url"), c, F.lit(""))))
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, k: a - F.when(k > 0, k / n * F.log2(k / n)).otherwise(0.0))
    count = lambda c: (F.length("url") - F.length(F.translate("url", c, ""))).cast("double")
    return urls.withColumns(
        {
            "f_length": n,
            "f_host_length": F.length("host").cast("double"),
            "f_depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "f_digits": F.when(n > 0, count("0123456789") / n).otherwise(0.0),
            "f_entropy": F.when(n > 0, entropy).otherwise(0.0),
            "f_params": count("=&"),
            "f_hyphens": count("-_"),
            "f_labels": F.size(F.split("host", r"\.")).cast("double"),
            "suffix": F.substring_index("host", ".", -2),
        }
    )


class Trees:
    """Boosted trees, the statistics of suffixes that they need, and the mean of the labels."""

    def __init__(self, model, suffixes: DataFrame, mean: float):
        self.model, self.suffixes, self.mean = model, suffixes, mean

    def scored(self, urls: DataFrame) -> DataFrame:
        """``urls`` with ``p``, the probability that a url is to be blocked."""
        stats = self.suffixes.select("suffix", _rate(F.col("s"), F.col("n"), self.mean).alias("f_suffix_rate"), F.log1p("n").alias("f_suffix_n"))
        rows = features(urls).join(F.broadcast(stats), "suffix", "left").fillna({"f_suffix_rate": self.mean, "f_suffix_n": 0.0})
        return self.model.transform(_vector(rows)).withColumn("p", vector_to_array("probability")[1])


def _rate(s: Column, n: Column, mean: float) -> Column:
    return (s + PRIOR * mean) / (n + PRIOR)


def _vector(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def learned(urls: DataFrame, max_train: int = MAX_TRAIN) -> Trees | str:
    """Trees from the urls that a rule decides (:func:`ruled`); where all have one verdict, that one (``allow`` without any)."""
    counts = {r.ruling: r.n for r in urls.where("ruling IS NOT NULL").groupBy("ruling").agg(F.count("*").alias("n")).toLocalIterator()}
    if len(counts) < 2:
        return next(iter(counts), "allow")
    share = min(1.0, max_train / sum(counts.values()))
    draw = F.pmod(F.xxhash64(F.lit("train"), "page_id", "url"), F.lit(1 << 30)) / float(1 << 30)
    rows = features(urls.where("ruling IS NOT NULL").where(draw < share)).withColumn("label", (F.col("ruling") == "block").cast("double"))
    # Equal urls are in one fold.
    train = written(rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS))).select("label", "suffix", "fold", *FEATURES[:-2]), "url-train")
    both = train.agg(F.min("label").alias("low"), F.max("label").alias("high"), F.avg("label").alias("mean")).first()
    if both.low is None or both.low == both.high:
        return max(counts, key=counts.get)
    mean = float(both.mean)
    folds = written(train.groupBy("suffix", "fold").agg(F.sum("label").alias("own_s"), F.count("*").cast("double").alias("own_n")), "url-folds")
    suffixes = written(folds.groupBy("suffix").agg(F.sum("own_s").alias("s"), F.sum("own_n").alias("n")), "url-suffixes")
    rows = train.join(F.broadcast(folds), ["suffix", "fold"]).join(F.broadcast(suffixes), "suffix")
    others_s, others_n = F.col("s") - F.col("own_s"), F.col("n") - F.col("own_n")
    rows = rows.withColumn("f_suffix_rate", _rate(others_s, others_n, mean)).withColumn("f_suffix_n", F.log1p(others_n))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    return Trees(trees.fit(_vector(rows)), suffixes, mean)


def verdicts(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", max_train: int = MAX_TRAIN) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and ``p_block`` (null where a rule decides or nothing was learned)."""
    urls = ruled(parsed(pages, id_col, url_col), rules)
    final = ["page_id", "host", "path", "rule"]
    trees = learned(urls, max_train)
    if isinstance(trees, str):
        return urls.select(*final, F.coalesce("ruling", F.lit(trees)).alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    scored = trees.scored(urls)
    return scored.select(*final, F.coalesce("ruling", F.when(F.col("p") > 0.5, "block").otherwise("allow")).alias("verdict"), F.when(F.col("ruling").isNull(), F.col("p")).alias("p_block"))
