"""Importance resampling towards a target set, by bit-sliced aggregation.

Features are hashed into ``BUCKETS`` buckets. A bucket's gain is the floored, scaled log ratio of its share among
the target's features to its share among the documents' features. A document's bucket counts become bit planes: plane i
holds, for every bucket, bit i of its count. The gains become planes as well, in two's complement, so that the last plane
stands for a negative power of two. The sum of gains over a document's features is then the sum over pairs of
planes of the number of bits that both have, times the power of two of the pair: whole numbers only, no rounding.

CRCs are linear, so a feature of several words takes its CRC from those of its words, a whole batch at once.

Two scans of the texts: one for the bucket totals, which each task sums up before it sends ``BUCKETS`` numbers, and one
for the weights. Only bucket totals reach the driver. Rows are ranked by one sort by range of narrow rows; a place is the
number within its part of the sort plus the rows of the parts before it, one figure a part.

Cases: a null text has no words, as an empty one; its weight is 0. A document is a row: rows that repeat count and are
drawn each by itself. Null ids are hashed as the empty text and yield to any other id in ties. An empty table gives an
empty result, an empty target gains that say so. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.sources.scratch import stored

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Words and documents that a task turns into numbers at once.
CHUNK_WORDS, CHUNK_DOCS = 200_000, 64
#: Texts up to this many bytes have a shift table of their own.
NEAR = 64
#: Bytes of words stay, A to Z become small, all others part words.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_SPACE = np.uint32(zlib.crc32(b" "))
_PLANE_WORDS = -(-BUCKETS // 64)


def words(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters without case and characters beyond ASCII."""
    return text.translate(_WORD_BYTES).split() if text else []


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by what it makes of each byte at each of the four places."""
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


@lru_cache(1)
def _near_shifts() -> np.ndarray:
    """What becomes of a CRC when n zero bytes follow, for n below ``NEAR``, by n, place and byte."""
    place = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> 1) ^ np.where(step & 1, np.uint32(0xEDB88320), np.uint32(0))
    shifts = [place]
    for _ in range(NEAR):
        shifts.append(step[shifts[-1] & 255] ^ (shifts[-1] >> 8))
    return np.array(shifts)


@lru_cache(64)
def _far_shift(power: int) -> np.ndarray:
    """The same for ``NEAR`` times two to the power of zero bytes."""
    if power == 0:
        return _near_shifts()[NEAR]
    half = _far_shift(power - 1)
    return _apply(half, half)


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC of texts that follow each other, from theirs and the length of the right one."""
    out = left
    far, power = length // NEAR, 0
    if far.any():
        out = out.copy()
        while (far >> power).any():
            rows = np.flatnonzero((far >> power) & 1)
            out[rows] = _apply(_far_shift(power), out[rows])
            power += 1
    flat, at = _near_shifts().reshape(-1), (length % NEAR) * 1024
    shifted = flat[at + (out & 255)] ^ flat[at + 256 + ((out >> 8) & 255)]
    shifted ^= flat[at + 512 + ((out >> 16) & 255)] ^ flat[at + 768 + (out >> 24)]
    return shifted ^ right


def feature_buckets(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The document and the bucket of every run of one to ``LONGEST`` words."""
    counts = [len(d) for d in docs]
    total = sum(counts)
    every = [w for d in docs for w in d]
    crc = np.fromiter(map(zlib.crc32, every), np.uint32, total)
    length = np.fromiter(map(len, every), np.int64, total)
    doc = np.repeat(np.arange(len(docs)), counts)
    owners, buckets, run = [doc], [crc % BUCKETS], crc
    for order in range(1, LONGEST):
        if total <= order:
            break
        spaced = _apply(_near_shifts()[1], run[: total - order]) ^ _SPACE
        run = joined_crc(spaced, crc[order:], length[order:])
        whole = doc[order:] == doc[: total - order]
        owners.append(doc[order:][whole])
        buckets.append(run[whole] % BUCKETS)
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def _chunks(texts: Iterator[bytes | None]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        held.append(words(text))
        size += len(held[-1])
        if size >= CHUNK_WORDS or len(held) >= CHUNK_DOCS:
            yield held
            held, size = [], 0
    if held:
        yield held


_TOTALS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def _sum_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for docs in _chunks(x.as_py() for x in batch.column(0)):
            totals += np.bincount(feature_buckets(docs)[1], minlength=BUCKETS)
    used = np.flatnonzero(totals)
    yield pa.record_batch([pa.array(used, pa.int32()), pa.array(totals[used])], schema=_TOTALS)


def bucket_totals(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of all rows by bucket; each task sends its sums."""
    parts = df.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(_sum_buckets, "bucket int, n bigint")
    out = np.zeros(BUCKETS, np.int64)
    # One row a bucket.
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The scaled log ratio of smoothed shares, rounded down."""
    all_docs, all_target = float(documents.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratios = ((float(t) + 1) * all_docs / ((float(s) + 1) * all_target) for s, t in zip(documents, target, strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def planes(numbers: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of rows of ``BUCKETS`` numbers: by plane, row and word of 64 buckets."""
    out = np.zeros((bits, len(numbers), _PLANE_WORDS * 8), np.uint8)
    for i in range(bits):
        out[i, :, : -(-BUCKETS // 8)] = np.packbits(((numbers >> i) & 1).astype(np.uint8), axis=1, bitorder="little")
    return out.view(np.uint64)


def gain_planes(gains: np.ndarray) -> np.ndarray:
    """Planes of signed numbers in two's complement; the last one counts negative."""
    bits = max(int(gains.max(initial=0)).bit_length(), int(-gains.min(initial=0)).bit_length()) + 1
    return planes(gains[None, :], bits)[:, 0, :]


def weights(counts: np.ndarray, signed: np.ndarray) -> np.ndarray:
    """Sum of gains over the features of each row of bucket counts, by common bits of pairs of planes."""
    out = np.zeros(len(counts), np.int64)
    for i, plane in enumerate(planes(counts, int(counts.max(initial=0)).bit_length())):
        for j, gain in enumerate(signed):
            common = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) << (i + j)
            out += -common if j == len(signed) - 1 else common
    return out


_WEIGHED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def _weigh(signed: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, features, sums = [], [], []
            for docs in _chunks(x.as_py() for x in batch.column(1)):
                owner, bucket = feature_buckets(docs)
                counts = np.bincount(owner * BUCKETS + bucket, minlength=len(docs) * BUCKETS).reshape(len(docs), BUCKETS)
                sizes += map(len, docs)
                features.append(np.bincount(owner, minlength=len(docs)))
                sums.append(weights(counts, signed))
            if sizes:
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.concatenate(features)), pa.array(np.concatenate(sums))]
                yield pa.record_batch(columns, schema=_WEIGHED)

    return run


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row: the weight with Gumbel noise named by the id."""
    gains = bucket_gains(bucket_totals(docs, text_col), bucket_totals(target, text_col))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    weighed = rows.mapInArrow(_weigh(gain_planes(gains)), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; undrawn rows have no rank.

    Drawn are, of the rows with enough words, the given part with the highest scores, ties to the smaller id.
    """
    spark = docs.sparkSession
    scored = stored(score(docs, target, id_col, text_col, seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    long_enough = F.col("n_words") >= least_words
    # The row number comes last, so that rows which are equal in all else may lie in several parts.
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight", "row"]
    placed = stored(scored.where(long_enough).orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    # The upper bits of a place number the part, the lower 33 bits the row in it.
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()
    before, total = [], 0
    for row in counts:
        before.append((row["part"], total))
        total += row["count"]
    ahead = spark.createDataFrame(before, "part bigint, ahead bigint")
    place = F.col("ahead") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    rank = F.when(place <= total * percent // 100, place)
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.withColumn("part", part).join(F.broadcast(ahead), "part").select(*columns, rank.alias("rank"))
    others = scored.where(~long_enough).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.unionByName(others)
