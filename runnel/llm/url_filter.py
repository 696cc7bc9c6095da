"""URL filters: prefix rules, and gradient-boosted trees on lexical features for URLs that no rule fits.

URLs that a rule judges are the labelled ones; Spark's GBTClassifier learns from a bounded sample of them. Features are
Spark columns; block rates of suffixes are counted over all labelled URLs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import kept


@dataclass(frozen=True)
class Rule:
    """host and all its subdomains, paths that start with path; the rule's text is host + path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


@dataclass(frozen=True)
class Settings:
    """sample: about so many labelled URLs are fitted on, drawn by a hash of the URL. broadcast_suffixes: up to so many
    suffixes (about 5 MB) are sent to all executors. smoothing: labelled URLs that a suffix counts for besides its own."""

    sample: int = 8000
    trees: int = 12
    depth: int = 4
    smoothing: float = 20.0
    broadcast_suffixes: int = 100_000


def host_of(url: Column) -> Column:
    """What is between the first :// and the next of / ? # or the end, with A-Z as a-z; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; of rules of one length the first."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        hit = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _count(text: Column, chars: str) -> Column:
    """How many characters of text are among chars."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


_LETTERS, _DIGITS, _SIGNS = "abcdefghijklmnopqrstuvwxyz", "0123456789", "-._~:/?#[]@!$&'()*+,;=%"


def entropy(text: Column) -> Column:
    """Bits a character of the ASCII letters, digits and URL signs of text."""
    n = F.greatest(F.length(text).cast("double"), F.lit(1.0))
    parts = [(-p * F.log2(F.greatest(p, F.lit(1e-9)))) for p in (_count(text, c) / n for c in _LETTERS + _DIGITS + _SIGNS)]
    return reduce(lambda a, b: a + b, parts)


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def lexical(pages: DataFrame) -> DataFrame:
    """pages (url, host, path) with the lexical features added; all doubles."""
    url, host, path = F.lower(F.coalesce("url", F.lit(""))), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.greatest(F.length(url).cast("double"), F.lit(1.0))
    return pages.withColumns(
        {
            "f_length": F.length(url).cast("double"),
            "f_host_length": F.length(host).cast("double"),
            "f_path_length": F.length(path).cast("double"),
            "f_depth": _count(F.regexp_replace(path, "/+$", ""), "/"),
            "f_labels": F.when(host == "", 0.0).otherwise(_count(host, ".") + 1),
            "f_digits": _count(url, _DIGITS) / n,
            "f_host_digits": _count(host, _DIGITS),
            "f_hyphens": _count(host, "-"),
            "f_entropy": entropy(url),
            "f_host_entropy": entropy(host),
            "f_parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
            "f_fragment": url.contains("#").cast("double"),
            "f_https": url.startswith("https:").cast("double"),
            "f_extension": F.regexp_extract(path, r"\.([a-z0-9]{1,5})$", 1).cast("string").isin("", "htm", "html", "php", "asp", "aspx").cast("double"),
        }
    )


FEATURES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_hyphens", "f_entropy", "f_host_entropy", "f_parameters", "f_fragment", "f_https", "f_extension", "f_suffix"]


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, settings: Settings = Settings(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: (page_id, host, path, rule, verdict).

    verdict is that of the longest rule that fits; else the trees'. Null URLs and URLs without :// have an empty host and
    path, fit no rule and are judged by the trees like others. Where no URL has a label, or all have the same, that label
    (or allow) goes to all. Repeated rows get the same verdict. Other columns of pages are not looked at.
    """
    s = settings
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    split = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    split = split.withColumn("fit", fit).withColumn("suffix", suffix_of(F.col("host")))
    label = (F.col("fit.verdict") == "block").cast("double")
    rates = kept(split.where("fit is not null").groupBy("suffix").agg(F.sum(label).alias("bad"), F.count("*").cast("double").alias("n")))
    bad, n, suffixes = rates.agg(F.sum("bad"), F.sum("n"), F.count("*")).first()
    if not n or bad in (0, n):
        rest = F.lit("block" if n and bad == n else "allow")
        return split.select("page_id", "host", "path", "fit.rule", F.coalesce("fit.verdict", rest).alias("verdict"))
    prior = bad / n
    rate = rates.select("suffix", ((F.col("bad") + s.smoothing * prior) / (F.col("n") + s.smoothing)).alias("f_suffix"))
    narrow = suffixes <= s.broadcast_suffixes

    def featured(df: DataFrame) -> DataFrame:
        both = lexical(df).join(F.broadcast(rate) if narrow else rate, "suffix", "left")
        both = both.withColumn("f_suffix", F.coalesce("f_suffix", F.lit(prior)))
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(both)

    # drawn by page and address: an address that fills much of the table is drawn by its share, and a repeated page once
    drawn = (F.xxhash64("page_id", "url", F.lit(5)).bitwiseAND(F.lit((1 << 32) - 1)) / float(1 << 32)) < min(1.0, s.sample / n)
    sample = split.where("fit is not null").where(drawn).dropDuplicates(["page_id", "url"])
    sample = kept(featured(sample).select("features", label.alias("label"))).coalesce(4)
    if sample.select("label").distinct().count() < 2:
        rest = F.lit("block" if prior > 0.5 else "allow")
        return split.select("page_id", "host", "path", "fit.rule", F.coalesce("fit.verdict", rest).alias("verdict"))
    trees = GBTClassifier(maxIter=s.trees, maxDepth=s.depth, seed=1, maxBins=32, predictionCol="blocked", cacheNodeIds=False).fit(sample)
    ruled = split.where("fit is not null").select("page_id", "host", "path", "fit.rule", "fit.verdict")
    guessed = trees.transform(featured(split.where("fit is null")))
    return ruled.unionByName(guessed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("blocked") == 1, "block").otherwise("allow").alias("verdict")))
