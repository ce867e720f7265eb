"""Language identification by prediction with partial matching.

Each language has a tree of byte contexts of up to three bytes. A context that was seen predicts the next
byte by its counts and keeps an escape probability, by the number of different bytes that followed; escaped mass goes
to the shorter context, without the bytes the longer one has predicted, and in the end to all bytes alike. The
statistics are frozen after training, so the code length of every byte in every context is fixed: all
contexts of a language set share one table of nodes, and a text is scored by gathering from it, exactly and whole.
Letters decide: texts are lower-cased, and whatever is no letter counts as a space.

The trees are fitted on at most ``SAMPLE_DOCS`` texts and, beyond the first of them, ``SAMPLE_BYTES`` bytes of each language: the
texts with the smallest hashes, each once however often it repeats.

Cases: a null text, an empty one and one without letters are ``und`` with score 0; ties go to the first
language by name; repeated rows are scored alike and a text of any length is scored whole; without training
texts every text is ``und``; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.llm.rows import whole_rows

UNKNOWN = "und"
ORDER = 3
#: Training texts of a language and their bytes, at most.
SAMPLE_DOCS = 1500
SAMPLE_BYTES = 64 << 20
SPARE = 2
#: Occurrences that make a context a node.
LEAST_SEEN = 3
#: Bytes that are scored at a time.
CHUNK = 1 << 20

_LETTER_RUN = re.compile(r"[^\W\d_]+")
_SPACED = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    return any(any(map(str.isalpha, run.group())) for run in _LETTER_RUN.finditer(text))


def plain_bytes(text: str) -> bytes:
    """Lower case, everything but letters (and all bytes beyond ASCII) as single spaces."""
    return b" ".join(text.lower().encode().translate(_SPACED).split())


@dataclass
class Model:
    languages: list[str]
    #: The symbol of each byte; 0 stands for all bytes that training never met.
    symbols: np.ndarray
    #: The node of the longest known context, by its three symbols.
    nodes: np.ndarray
    #: Bits of each symbol at each node, by language.
    bits: np.ndarray

    @property
    def width(self) -> int:
        return self.bits.shape[2]

    def lengths(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths in bits (texts, languages), and the number of bytes of each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        total = np.zeros((len(texts), len(self.languages)))
        lead = b" " * ORDER
        raw = self.symbols[np.frombuffer(b"".join(lead + t for t in texts), np.uint8)]
        starts = np.cumsum(sizes + ORDER) - (sizes + ORDER)
        width = self.width
        # Each chunk sees the three symbols before it, so long texts give the same sums.
        for at in range(ORDER, len(raw), CHUNK):
            part = raw[at - ORDER : at + CHUNK].astype(np.int64)
            context = (part[:-3] * width + part[1:-2]) * width + part[2:-1]
            place = self.nodes[context].astype(np.int64) * width + part[3:]
            owner = np.searchsorted(starts, np.arange(at, at + len(place)), side="right") - 1
            # The leading spaces of a text are context only.
            real = np.arange(at, at + len(place)) - starts[owner] >= ORDER
            cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            for k in range(len(self.languages)):
                cost = np.where(real, self.bits[k].reshape(-1)[place], 0)
                total[owner[cuts], k] += np.add.reduceat(cost, cuts, dtype=np.float64)
        return total, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, its share of the likelihood, and bits a byte under it."""
        names, scores, rates = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if self.languages and t and has_letter(t)]
        if known:
            bits, sizes = self.lengths([plain_bytes(texts[i]) for i in known])
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(known)), best]
            share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            for i, k, s, b, n in zip(known, best, share, least, sizes, strict=True):
                names[i], scores[i], rates[i] = self.languages[k], float(s), float(b / max(1, n))
        return names, scores, rates


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, count) of all runs of four bytes in a batch; a gram is a whole number."""
    for batch in batches:
        held: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = np.frombuffer(b" " * ORDER + plain_bytes(text.as_py()), np.uint8).astype(np.int64)
            if len(raw) > ORDER:
                grams, counts = np.unique(((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]), return_counts=True)
                held.setdefault(lang, Counter()).update(dict(zip(grams.tolist(), counts.tolist(), strict=True)))
        for lang, counter in held.items():
            yield pa.record_batch(
                [pa.array([lang] * len(counter)), pa.array(list(counter), pa.int64()), pa.array(list(counter.values()), pa.int64())],
                names=["lang", "gram", "count"],
            )


def drawn_texts(train: DataFrame, lang_col: str, text_col: str, sample_docs: int, sample_bytes: int) -> DataFrame:
    """(lang, text) of the drawn texts, each once.

    Texts are drawn by narrow rows of language, hash and size. Hashes are spread evenly, so of a language with many texts only
    a range of them is ordered that holds about ``SPARE`` times as many as are wanted.
    """
    rows = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    named = rows.withColumn("hash", F.xxhash64("text"))
    near = F.lit(False)
    # One row a language.
    for row in named.groupBy("lang").agg(F.approx_count_distinct("hash").alias("texts")).collect():
        upto = min((1 << 63) - 1, (SPARE * sample_docs << 64) // max(1, row["texts"]) - (1 << 63))
        near = near | ((F.col("lang") == row["lang"]) & (F.col("hash") <= upto))
    in_order = Window.partitionBy("lang").orderBy("hash")
    sizes = named.where(near).groupBy("lang", "hash").agg(F.max(F.octet_length("text")).alias("bytes"))
    least = sizes.withColumn("n", F.row_number().over(in_order)).where(F.col("n") <= sample_docs)
    upto = least.withColumn("upto", F.sum("bytes").over(in_order)).where((F.col("upto") <= sample_bytes) | (F.col("n") == 1))
    # One row a language.
    edges = {r["lang"]: r["edge"] for r in upto.groupBy("lang").agg(F.max("hash").alias("edge")).collect()}
    drawn = F.lit(False)
    for lang, edge in edges.items():
        drawn = drawn | ((F.col("lang") == lang) & (F.col("hash") <= edge))
    return named.where(drawn).groupBy("lang", "hash").agg(F.any_value("text").alias("text")).select("lang", "text")


def fit(
    train: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES
) -> Model:
    """Trees for every language of the training rows; rows without text or language teach nothing."""
    texts = drawn_texts(train, lang_col, text_col, sample_docs, sample_bytes)
    found = texts.mapInArrow(_grams, "lang string, gram bigint, count bigint").groupBy("lang", "gram").agg(F.sum("count").alias("count")).toArrow()
    names = found.column("lang").to_pylist()
    return build(names, found.column("gram").to_numpy(), found.column("count").to_numpy(), sorted(set(names)))


def build(names: list[str], grams: np.ndarray, counts: np.ndarray, languages: list[str], least_seen: int = LEAST_SEEN) -> Model:
    """Frozen statistics from the counts of runs of four bytes."""
    seen = np.zeros(256, bool)
    for shift in (0, 8, 16, 24):
        seen[(grams >> shift) & 255] = True
    seen[32] = True
    symbols = np.where(seen, np.cumsum(seen), 0).astype(np.int64)
    width = int(seen.sum()) + 1
    lang = np.array([languages.index(n) for n in names], np.int64)
    parts = [symbols[(grams >> shift) & 255] for shift in (24, 16, 8, 0)]
    nodes = np.zeros(width**3, np.int32)
    rows: list[np.ndarray] = []

    def tables(order: int) -> tuple[np.ndarray, np.ndarray]:
        """The contexts of an order that were seen often enough, and counts (languages, contexts, symbols)."""
        code = np.zeros(len(lang), np.int64)
        for part in parts[3 - order : 3]:
            code = code * width + part
        known, place = np.unique(code, return_inverse=True)
        often = np.zeros(len(known), np.int64)
        np.add.at(often, place, counts)
        good = often >= least_seen if order else np.ones(len(known), bool)
        number = np.where(good, np.cumsum(good) - 1, -1)
        chosen = number[place] >= 0
        out = np.zeros((len(languages), int(good.sum()), width))
        np.add.at(out, (lang[chosen], number[place][chosen], parts[3][chosen]), counts[chosen])
        return known[good], out

    def below(count: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probabilities at contexts with these counts, given those at their shorter contexts."""
        total, kinds = count.sum(-1, keepdims=True), (count > 0).sum(-1, keepdims=True)
        rest = np.where(count > 0, 0, shorter)
        left = rest.sum(-1, keepdims=True)
        escape = np.where(left > 0, kinds, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            mixed = count / (total + escape) + escape / (total + escape) * np.where(left > 0, rest / left, 0)
        return np.where(total > 0, mixed, shorter)

    uniform = np.full((len(languages), 1, width), 1 / width)
    base = below(tables(0)[1], uniform) if len(grams) else uniform
    rows.append(base)
    shorter_of = {(): 0}
    first = 1
    for order in range(1, ORDER + 1):
        if not len(grams):
            break
        contexts, count = tables(order)
        digits = [tuple(int(c) // width**k % width for k in range(order - 1, -1, -1)) for c in contexts]
        everything = np.concatenate(rows, axis=1)
        rows.append(below(count, everything[:, [shorter_of[d[1:]] for d in digits]]))
        cube = nodes.reshape(width, width, width)
        for k, d in enumerate(digits):
            shorter_of[d] = first + k
            cube[(..., *d)] = first + k
        first += len(digits)
    bits = -np.log2(np.concatenate(rows, axis=1)).astype(np.float32)
    return Model(languages, symbols, nodes, bits)


def predict_column(spark, model: Model, text: Column) -> Column:
    """A struct of lang_pred, score and bits a byte; the model is a bounded table, sent once to each executor."""
    sent = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64())])

    @F.arrow_udf("struct<lang_pred: string, score: double, bits: double>")
    def udf(texts: pa.Array) -> pa.Array:
        names, scores, rates = [], [], []
        for at in range(0, len(texts), 200):
            found = sent.value.predict(texts.slice(at, 200).to_pylist())
            names += found[0]
            scores += found[1]
            rates += found[2]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], fields=list(kind))

    # Without this mark the plan may call it once for each field.
    return udf.asNondeterministic()(text)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    found = docs.select(F.col(id_col).alias("doc_id"), predict_column(docs.sparkSession, model, F.col(text_col)).alias("found"))
    return found.select("doc_id", "found.lang_pred", "found.score")


def keep_languages(docs: DataFrame) -> DataFrame:
    """The documents in a language of the table; the columns stay as they are.

    Rejected are texts without letters and texts that their best language codes no better than bytes drawn alike.
    """
    model = fit(docs)
    found = docs.select(whole_rows(docs).alias("doc"), predict_column(docs.sparkSession, model, F.col("text")).alias("found"))
    known = (F.col("found.lang_pred") != UNKNOWN) & (F.col("found.bits") < float(np.log2(model.width)))
    return found.where(known).select("doc.*")
