"""Document quality by hierarchical empirical Bayes.

A logistic classifier of text features gives the evidence of a document. Sites add to it at two levels: a host's
rate of good documents is a posterior around the global rate, and that of a path below the host is a posterior
around its host's. How strongly a level shrinks follows from the spread of rates between its sites against
the spread within them, so a site with few documents stays near the level above. A document's quality is its
evidence, moved by how far its path's rate lies from the global one. Rates are sums by group, so a
source that holds a third of the documents is reduced within each task.

The classifier is fitted on at most ``SAMPLE_DOCS`` labelled texts, each once however often it repeats, drawn by a hash in
proportion to their classes, of which each has one at least; rates use all documents. A document's own evidence is part
of the rate of its site, as of every level.

Cases: a null or empty text has features of zero; a null source is a site of its own, as is a null path; labels
that are null teach nothing and repeated ones are averaged; rows that are repeated are scored alike and stay or go together; without labels
of both kinds the evidence is even and every document stays; an empty table gives an empty result; extra columns
are not read. Whole texts are read, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.llm.rows import text_mark, whole_rows
from saldo.sources.scratch import discard, stored

SAMPLE_DOCS = 20_000
#: Quality from which a document stays.
LEAST_QUALITY = 0.4
#: Pseudo-documents of a level whose sites do not differ, and of one whose sites differ entirely.
MOST_SHRINKAGE, LEAST_SHRINKAGE = 1e6, 1.0
RIDGE = 1.0

FEATURES = ("size", "word_length", "distinct", "repeated", "upper", "digit", "mark", "symbol", "lines", "foreign")
#: Classes of bytes: 0 lower case, 1 upper case, 2 digit, 3 white space, 4 punctuation, 5 symbol, 6 beyond ASCII.
_CLASSES = np.full(256, 5, np.int64)
for _bytes, _class in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t\n\v\f\r", 3), (b".,;:'\"?!-()", 4), (range(128, 256), 6)):
    _CLASSES[list(_bytes)] = _class


def features(text: str | None) -> list[float]:
    """The figures named in FEATURES."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    counts = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=7)
    solid = max(1, len(raw) - int(counts[3]))
    return [
        float(np.log1p(len(words))),
        solid / len(words),
        len(set(words)) / len(words),
        sum(map(eq, words, words[1:])) / len(words),
        *(float(counts[k]) / solid for k in (1, 2, 4, 5)),
        raw.count(b"\n") / len(words),
        float(counts[6]) / solid,
    ]


def feature_column(text: Column) -> Column:
    """The features as an array."""

    @F.arrow_udf("array<double>")
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array([features(value.as_py()) for value in texts], pa.list_(pa.float64()))

    return udf(text)


def fit_evidence(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Intercept and weights of a logistic regression with a small ridge, in the units of the features."""
    width = len(FEATURES)
    if not len(labels) or labels.min() == labels.max():
        return np.zeros(width + 1)
    mean, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    x = np.hstack([np.ones((len(rows), 1)), (rows - mean) / spread])
    w = np.zeros(width + 1)
    ridge = RIDGE * np.diag([0.0] + [1.0] * width)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(width + 1), x.T @ (labels - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    weights = w[1:] / spread
    return np.concatenate([[w[0] - weights @ mean], weights])


def site_columns(source: Column) -> list[Column]:
    """Host and first path section of a source that may be a URL or a plain name."""
    bare = F.regexp_replace(source, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return [F.lower(F.regexp_extract(bare, "^([^/?#]*)", 1)).alias("host"), F.regexp_extract(bare, "^[^/?#]*(/[^/?#]*)?", 1).alias("path")]


def shrinkage(groups: DataFrame, centre: Column) -> float:
    """Pseudo-documents by which sites (n, good, squares) are drawn to the centre of the level above."""
    rate = F.col("good") / F.col("n")
    row = groups.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.count(F.lit(1)).alias("sites"),
        F.sum(F.col("n") * (rate - centre) ** 2).alias("between"),
        F.sum(F.col("squares") - F.col("n") * rate * rate).alias("within"),
        F.avg(centre * (1 - centre)).alias("even"),
    ).first()
    if not row["n"] or row["sites"] < 2 or row["n"] <= row["sites"]:
        return MOST_SHRINKAGE
    noise = max(row["within"], 0.0) / (row["n"] - row["sites"])
    spread = (row["between"] - (row["sites"] - 1) * noise) / max(1.0, row["n"] - row["nn"] / row["n"])
    if spread <= 0:
        return MOST_SHRINKAGE
    return float(min(max(row["even"] / spread - 1, LEAST_SHRINKAGE), MOST_SHRINKAGE))


def _logit(p: Column) -> Column:
    safe = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(safe / (1 - safe))


@dataclass(frozen=True)
class Judge:
    """Weights of the evidence, rates by site, and the global rate."""

    weights: list[float]
    rates: DataFrame
    whole: float

    def evidence(self) -> Column:
        out = F.lit(self.weights[0])
        for k, weight in enumerate(self.weights[1:]):
            out = out + F.col("features")[k] * weight
        return out

    def quality(self, rows: DataFrame) -> DataFrame:
        """Rows (host, path, evidence, ...) with ``site_rate`` and ``quality``."""
        # Spark broadcasts the rates where their size allows and splits hot sites where it does not.
        placed = rows.join(self.rates, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
        total = F.col("evidence") + _logit(F.col("site_rate")) - _logit(F.lit(self.whole))
        quality = 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(700.0)), F.lit(-700.0))))
        return placed.withColumn("quality", quality).drop("site_host", "site_path")


def drawn_texts(taught: DataFrame, sample_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most so many of the labelled texts (mark, features, label), the classes kept."""
    texts = stored(taught.groupBy("mark").agg(F.any_value("features").alias("features"), F.avg("label").alias("label")), "taught")
    good = F.col("label") >= 0.5
    sizes = {r["good"]: r["count"] for r in texts.groupBy(good.alias("good")).count().collect()}
    parts = []
    for kind, size in sizes.items():
        share = max(1, sample_docs * size // sum(sizes.values()))
        parts.append(texts.where(good == F.lit(kind)).orderBy(F.xxhash64("mark"), "mark").limit(share))
    if not parts:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    drawn = reduce(DataFrame.unionByName, parts).orderBy("mark").select("features", "label").toArrow()
    return np.array(drawn.column("features").to_pylist(), float).reshape(-1, len(FEATURES)), np.array(drawn.column("label").to_pylist(), float)


def fit(read: DataFrame, labels: DataFrame, label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Judge:
    """The judge of documents that were read as (doc_id, mark, host, path, features), from labels (doc_id, label_col)."""
    truth = labels.where(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.avg(label_col).alias("label"))
    taught = read.select("doc_id", "mark", "features").join(truth, "doc_id").select("mark", "features", "label")
    weights = fit_evidence(*drawn_texts(taught, sample_docs)).tolist()
    good = 1 / (1 + F.exp(-F.col("evidence")))
    seen = read.select("host", "path", Judge(weights, read, 0.5).evidence().alias("evidence"))
    paths = stored(
        seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("good"), F.sum(good * good).alias("squares")), "paths"
    )
    hosts = stored(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "good", "squares")]), "hosts")
    whole = hosts.agg(F.sum("good") / F.sum("n")).first()[0] or 0.5
    strength = shrinkage(hosts, F.lit(whole))
    above = stored(hosts.select("host", ((strength * whole + F.col("good")) / (strength + F.col("n"))).alias("host_rate")), "host-rates")
    below = stored(paths.join(above, paths["host"].eqNullSafe(above["host"]), "inner").drop(above["host"]), "path-sums")
    strength = shrinkage(below, F.col("host_rate"))
    rates = stored(
        below.select(
            F.col("host").alias("site_host"),
            F.col("path").alias("site_path"),
            ((strength * F.col("host_rate") + F.col("good")) / (strength + F.col("n"))).alias("site_rate"),
        ),
        "path-rates",
    )
    discard(read.sparkSession, paths, hosts, above, below)
    return Judge(weights, rates, whole)


def read_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, mark, host, path, features) of every document, stored."""
    text = F.col(text_col)
    named = docs.select(
        F.col(id_col).alias("doc_id"), text_mark(text).alias("mark"), *site_columns(F.col(source_col)), feature_column(text).alias("features")
    )
    return stored(named, "features")


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    label_col: str = "quality",
    sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """doc_id, host, path, evidence, site_rate, quality and mark for every document."""
    read = read_documents(docs, id_col, text_col, source_col)
    judge = fit(read, labels.withColumnRenamed(id_col, "doc_id"), label_col, sample_docs)
    found = judge.quality(read.select("doc_id", "mark", "host", "path", judge.evidence().alias("evidence")))
    return found.select("doc_id", "host", "path", "evidence", "site_rate", "quality", "mark")


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = LEAST_QUALITY) -> DataFrame:
    """The documents of at least that quality; the columns stay as they are.

    Every row is judged by itself and carried whole, so rows that repeat stay or go together.
    """
    read = read_documents(docs)
    judge = fit(read, labels)
    discard(docs.sparkSession, read)
    rows = docs.select(whole_rows(docs).alias("doc"), *site_columns(F.col("source")), feature_column(F.col("text")).alias("features"))
    judged = judge.quality(rows.select("doc", "host", "path", judge.evidence().alias("evidence")))
    return judged.where(F.col("quality") >= least).select("doc.*")
