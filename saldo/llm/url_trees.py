"""URL verdicts from rules and gradient-boosted trees on lexical features.

A rule is a host and a beginning of the path; it fits the host and all its subdomains, and the longest rule that
fits decides. All other URLs are judged by boosted trees on what can be read off the URL: lengths, depth, ratio of
digits, entropy of characters, parameters, and how often labelled URLs with the same host suffix or file suffix
are bad. The trees are fitted on at most ``SAMPLE_URLS`` labelled URLs, drawn by a hash of the URL.

Cases: a null URL and one without ``://`` have an empty host and path, fit no rule and are judged like any other;
repeated URLs are judged alike and taught once; labels that are null teach nothing; without labels of both
kinds the judge follows the only kind there is, or allows where there is none; an empty table gives an empty result;
extra columns are not read and stay, but those called host, path, rule, verdict or bad_probability are replaced by the
results, and none may begin with ``__``; URLs of any length are read whole.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.sources.scratch import stored

SAMPLE_URLS = 20_000
TREES, DEPTH, SEED = 20, 4, 7
#: Probability of a bad URL from which it is blocked.
BLOCK_FROM = 0.5
#: Share of the labelled URLs that a suffix needs for a rate of its own, so at most the inverse of it are kept.
LEAST_SHARE = 0.01


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case and the path."""
    rest = F.coalesce(F.regexp_extract(url, "(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """value(rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def _suffixes(url: str) -> tuple[str, str]:
    """The last label of the host and the ending of the last path section."""
    rest = url.partition("://")[2]
    bare = rest.partition("#")[0].partition("?")[0]
    host, _, path = bare.partition("/")
    last = path.rpartition("/")[2]
    return host.rpartition(".")[2].lower(), last.rpartition(".")[2].lower() if "." in last else ""


def features(url: str | None, rates: tuple[dict[str, float], dict[str, float], float]) -> list[float]:
    url = url or ""
    rest = url.partition("://")[2]
    bare, _, query = rest.partition("#")[0].partition("?")
    host, _, path = bare.partition("/")
    raw = np.frombuffer(url.encode(), np.uint8)
    share = np.bincount(raw)[np.unique(raw)] / len(raw) if len(raw) else np.ones(1)
    top, ending = _suffixes(url)
    return [
        float(len(url)),
        float(len(host)),
        float(len(path)),
        float(path.count("/") + bool(path)),
        float(host.count(".")),
        sum(map(str.isdigit, url)) / max(1, len(url)),
        sum(map(str.isdigit, host)) / max(1, len(host)),
        float(url.count("-") + url.count("_") + url.count("%")),
        float(-(share * np.log2(share)).sum()),
        float(len([p for p in query.split("&") if p])),
        float("#" in rest),
        float(url.startswith("https")),
        rates[0].get(top, rates[2]),
        rates[1].get(ending, rates[2]),
    ]


def feature_column(url: Column, rates) -> Column:
    @F.arrow_udf("array<double>")
    def udf(urls: pa.Array) -> pa.Array:
        return pa.array([features(value.as_py(), rates) for value in urls], pa.list_(pa.float64()))

    return array_to_vector(udf(url))


def suffix_rates(urls: list[str], bad: list[float]) -> tuple[dict[str, float], dict[str, float], float]:
    """Smoothed rates of bad URLs by host suffix and by file suffix, and overall."""
    overall = float(np.mean(bad)) if bad else 0.0
    out: list[dict[str, float]] = []
    for part in (0, 1):
        sums: dict[str, list[float]] = {}
        for url, y in zip(urls, bad, strict=True):
            held = sums.setdefault(_suffixes(url)[part], [0.0, 0.0])
            held[0] += 1
            held[1] += y
        out.append({k: (s + 10 * overall) / (n + 10) for k, (n, s) in sums.items() if n >= max(1, LEAST_SHARE * len(urls))})
    return out[0], out[1], overall


def bad_probability(urls: DataFrame, labelled: DataFrame, sample_urls: int = SAMPLE_URLS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """The rows of urls with the probability that trees give ``url`` of being bad, from labelled (url, bad 0 or 1)."""
    rows = labelled.where("url IS NOT NULL AND bad IS NOT NULL").groupBy("url").agg(F.max("bad").cast("double").alias("bad"))
    known = stored(rows, "labelled-urls")
    edge = min(1 << 30, (sample_urls << 30) // max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < edge)
    drawn = sample.orderBy("url").toArrow()
    bad = drawn.column("bad").to_pylist()
    if len(set(bad)) < 2:
        return urls.withColumn("bad_probability", F.lit(bad[0] if bad else 0.0))
    rates = suffix_rates(drawn.column("url").to_pylist(), bad)
    taught = stored(sample.coalesce(4).select("bad", feature_column(F.col("url"), rates).alias("features")), "url-features")
    model = GBTClassifier(featuresCol="features", labelCol="bad", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=SEED).fit(taught)
    model = model.setProbabilityCol("__probability").setRawPredictionCol("__raw").setPredictionCol("__prediction").setFeaturesCol("__features")
    judged = model.transform(urls.withColumn("__features", feature_column(F.col("url"), rates)))
    return judged.withColumn("bad_probability", vector_to_array("__probability")[1]).drop("__probability", "__raw", "__prediction", "__features")


def judge(urls: DataFrame, labelled: DataFrame, rules: list[Rule], block_from: float = BLOCK_FROM) -> DataFrame:
    """The rows (with a ``url``) and their host, path, rule, verdict and bad_probability."""
    host, path = host_and_path(F.col("url"))
    split = bad_probability(urls, labelled).withColumn("host", host).withColumn("path", path)
    host, path = F.col("host"), F.col("path")
    learnt = F.when(F.col("bad_probability") >= block_from, "block").otherwise("allow")
    return split.withColumn("rule", matched_rule(host, path, rules, lambda r: r.name)).withColumn(
        "verdict", F.coalesce(matched_rule(host, path, rules, lambda r: r.verdict), learnt)
    )
