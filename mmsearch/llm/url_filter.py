"""URL filters: rules first, gradient-boosted trees on lexical features for the rest. JVM operations only.

Suffix statistics are out-of-fold: a url's suffix is rated by the labelled urls of other domains (last two labels of
the host), each domain counting once, drawn to the mean of all domains. So neither a url's own label nor a rule that
decides a whole domain comes back as a feature, when training and when judging alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import lookup_join, materialize

#: Weight of the mean of all domains in a suffix's rate, in domains.
PRIOR_WEIGHT = 2.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIX, DOMAIN = r"([^.]*)$", r"([^.]*\.?[^.]*)$"
FEATURES = ["url_len", "host_len", "path_len", "depth", "labels", "digit_ratio", "entropy", "n_params", "query_len", "hyphens", "escapes", "host_digits", "suffix_rate", "suffix_seen"]


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host and a path prefix, like ``example.net/en/``; it fits the host and its subdomains."""

    pattern: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        own, slash, rest = self.pattern.partition("/")
        return ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def best_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """Pattern of the longest fitting rule, else null. A rule list is a parameter: some hundreds at most."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        found = F.when(r.fits(host, path), F.lit(r.pattern)).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits a character, over the 95 printable ASCII characters and one class for all others; 0 for empty text."""
    plain = F.regexp_replace(text, r"[^\x20-\x7e]", "\x7f")
    n = F.length(plain)
    bits = lambda c: (n - F.length(F.replace(plain, c, F.lit(""))).cast("double")) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(plain, "")), F.lit(0.0), lambda a, c: a - F.when(bits(c) > 0, bits(c) * F.log2(bits(c))).otherwise(F.lit(0.0)))).otherwise(F.lit(0.0))


def features(urls: DataFrame) -> DataFrame:
    """urls (column url and any others) with the lexical features, __suffix, the last label of the host, and __domain, the last two."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda text, chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")
    n = F.length(url)
    cols = {
        "url_len": n, "host_len": F.length(host), "path_len": F.length(path), "depth": count(path, "/"), "labels": F.when(host == "", 0).otherwise(count(host, ".") + 1),
        "digit_ratio": F.when(n > 0, count(url, "0123456789") / n).otherwise(F.lit(0.0)), "entropy": entropy(url), "n_params": F.when(query == "", 0).otherwise(count(query, "&") + 1), "query_len": F.length(query),
        "hyphens": count(host, "-"), "escapes": count(url, "%"), "host_digits": count(host, "0123456789"),
    }
    return urls.withColumns({f"__{k}": v.cast("double") for k, v in cols.items()} | {"__suffix": F.regexp_extract(host, SUFFIX, 1), "__domain": F.regexp_extract(host, DOMAIN, 1)})


@dataclass
class SuffixStatistics:
    """Per suffix the sum of its domains' mean labels and their number; per domain its mean label; the mean over domains."""

    suffixes: DataFrame
    domains: DataFrame
    prior: float

    def add(self, table: DataFrame) -> DataFrame:
        """table (see ``features``) with __suffix_rate and __suffix_seen, both without the row's own domain."""
        out = lookup_join(lookup_join(table, self.suffixes, "__suffix", "left"), self.domains, "__domain", "left")
        others = F.coalesce("__seen", F.lit(0.0)) - F.col("__mean").isNotNull().cast("double")
        bad = F.coalesce("__bad", F.lit(0.0)) - F.coalesce("__mean", F.lit(0.0))
        rate = F.when(others > 0, (bad + F.lit(PRIOR_WEIGHT * self.prior)) / (others + F.lit(PRIOR_WEIGHT))).otherwise(F.lit(self.prior))
        return out.withColumns({"__suffix_rate": rate, "__suffix_seen": F.log1p(others)})


def suffix_statistics(labelled: DataFrame) -> SuffixStatistics:
    """Statistics of (url, label) over all labelled rows; rows are summed per domain before any suffix sees them."""
    host, _ = host_and_path(F.coalesce(F.col("url").cast("string"), F.lit("")))
    means = labelled.groupBy(F.regexp_extract(host, DOMAIN, 1).alias("__domain")).agg(F.avg(F.col("label").cast("double")).alias("__mean"))
    domains = materialize(means, "domains")
    tally = domains.groupBy(F.regexp_extract("__domain", SUFFIX, 1).alias("__suffix")).agg(F.sum("__mean").alias("__bad"), F.count("*").cast("double").alias("__seen"))
    prior = domains.agg(F.avg("__mean")).first()[0]
    return SuffixStatistics(materialize(tally, "suffixes"), domains, 0.5 if prior is None else prior)


@dataclass
class UrlModel:
    """Suffix statistics and boosted trees; ``constant`` is the score where the labels had one class or none."""

    statistics: SuffixStatistics | None
    trees: PipelineModel | None
    constant: float = 0.0

    def score(self, urls: DataFrame) -> DataFrame:
        """urls with __score, the probability of a bad url."""
        if self.trees is None:
            return urls.withColumn("__score", F.lit(self.constant))
        from pyspark.ml.functions import vector_to_array

        made = self.trees.transform(self.statistics.add(features(urls)))
        return made.withColumn("__score", vector_to_array("__probability")[1]).select(*urls.columns, "__score")


def train(labelled: DataFrame, sample: int = 20_000, trees: int = 10, depth: int = 4, seed: int = 7) -> UrlModel:
    """Fit on (url, label), label 1 for bad. Suffix statistics see every labelled row; the trees see the ``sample``
    rows of the smallest url hash, one task's worth of numbers whatever the input. Rows of null label are ignored."""
    labelled = labelled.filter("label is not null").select("url", F.col("label").cast("double").alias("label"))
    seen = labelled.agg(F.min("label"), F.max("label")).first()
    if seen[0] is None or seen[0] == seen[1]:
        return UrlModel(None, None, seen[0] or 0.0)
    statistics = suffix_statistics(labelled)
    few = labelled.orderBy(F.xxhash64("url"), "url", "label").limit(sample)
    table = materialize(statistics.add(features(few)).select("label", *(f"__{k}" for k in FEATURES)).coalesce(2), "training")
    join = VectorAssembler(inputCols=[f"__{k}" for k in FEATURES], outputCol="__features")
    fit = GBTClassifier(featuresCol="__features", labelCol="label", predictionCol="__prediction", maxIter=trees, maxDepth=depth, maxBins=32, seed=seed).setProbabilityCol("__probability").setRawPredictionCol("__raw")
    return UrlModel(statistics, PipelineModel([join, fit.fit(join.transform(table))]))


def held_out_accuracy(labelled: DataFrame, hosts: float = 0.3, seed: int = 7, **training) -> DataFrame:
    """(n, right, bad, blocked) over the urls of a ``hosts`` share of all hosts, drawn by hash, judged by a model that
    was trained on the urls of the other hosts alone. Rows of null label or url are ignored. Without rows to judge: zeros."""
    labelled = labelled.filter("label is not null and url is not null").select("url", F.col("label").cast("double").alias("label"))
    host, _ = host_and_path(F.col("url"))
    held = F.pmod(F.xxhash64(host, F.lit(seed)), F.lit(1000)) < F.lit(int(1000 * hosts))
    scored = train(labelled.filter(~held), **training).score(labelled.filter(held)).withColumn("__block", F.col("__score") > 0.5)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return scored.agg(F.count("*").alias("n"), count(F.col("__block") == (F.col("label") > 0.5)).alias("right"), count(F.col("label") > 0.5).alias("bad"), count(F.col("__block")).alias("blocked"))


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel | None = None, threshold: float = 0.5, **training) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row of pages (columns page_id, url; others are ignored).

    The longest fitting rule decides; other urls are blocked when the model's score is over ``threshold``.
    Without a model, one is trained from the urls that a rule decides. Null url, and urls without ``://``:
    empty host and path, no rule, judged by the model like any text. Repeated rows and null ids each get
    their row. Empty table: empty result.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    pages = pages.withColumn("host", host).withColumn("path", path)
    pages = pages.withColumn("rule", best_rule(rules, F.col("host"), F.col("path")))
    blocks = [r.pattern for r in rules if r.verdict == "block"]
    if model is None:
        model = train(pages.filter("rule is not null").select("url", F.col("rule").isin(blocks).cast("double").alias("label")), **training)
    scored = model.score(pages)
    bad = F.when(F.col("rule").isNull(), F.col("__score") > threshold).otherwise(F.col("rule").isin(blocks))
    return scored.select("page_id", "host", "path", "rule", F.when(bad, "block").otherwise("allow").alias("verdict"), F.col("__score").alias("score"))
