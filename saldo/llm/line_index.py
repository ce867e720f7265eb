"""Lines that many documents share, dropped by probing a sharded minimal perfect hash.

A line's key is the line without white space at its ends and without ASCII case; a key is named by 128 bits of hash. Each
task counts the documents of its keys before it sends them, so a line of every document costs a row a task. The keys
that enough documents hold are dealt into shards, and each shard gets a minimal perfect hash: on a level every key
picks a bit, bits picked once are kept, and the other keys go on to the next level. The rank of a key's bit is its
slot in two compact arrays, one of 64-bit fingerprints and one of counts. Documents then probe those arrays where they
lie: no line is joined or moved. Lines that are no key of the index end at an empty bit or at a foreign fingerprint.

Keys of few documents stay out of the index, as no line can be dropped for them. The shards are sent to the tasks only
up to ``ROUND_BYTES``; a larger index is probed in rounds of so many bytes, between which the documents are written.

Cases: a null or empty text is one empty line; a document is a row, so rows that repeat count each and have the same
result; null ids stay; an empty table gives an empty result; columns other than the id and the text are not read. Two keys
are taken for one only if they agree in 128 bits of hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.sources.scratch import discard, stored

WHITE = b" \t\n\v\f\r"
LEAST_DOCS = 10
LEAST_CHARS = 1
#: Keys a shard holds, about.
SHARD_KEYS = 16_384
#: Bytes of shards that tasks hold at once.
ROUND_BYTES = 128 << 20
#: Distinct keys that a task holds before it sends their counts.
HELD_KEYS = 200_000
#: Bits for each key of a level.
SPARE = 2
MOST_COUNT = (1 << 16) - 1
_GOLDEN = 0x9E3779B97F4A7C15


def line_keys(text: bytes, least_chars: int) -> list[bytes | None]:
    """The key of each line; None where it is too short to count."""
    keys = [line.strip(WHITE) for line in text.lower().split(b"\n")]
    if least_chars <= 1:
        return [k if len(k) >= least_chars else None for k in keys]
    return [k if len(k.decode("utf-8", "replace")) >= least_chars else None for k in keys]


def _halves(digests: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


_COUNTED = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())])


def _count_keys(least_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sent(held: Counter) -> pa.RecordBatch:
        h1, h2 = _halves(held)
        return pa.record_batch([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(list(held.values()), pa.int64())], schema=_COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                keys = set(line_keys(text.as_py() or b"", least_chars)) - {None}
                held.update(map(xxhash.xxh3_128_digest, keys))
                if len(held) >= HELD_KEYS:
                    yield sent(held)
                    held.clear()
        yield sent(held)

    return run


def _picked(h1: np.ndarray, h2: np.ndarray, level: int, bits: np.ndarray | int) -> np.ndarray:
    """The bit that each key picks on a level of so many bits."""
    x = h1 + np.uint64((level + 1) * _GOLDEN & (1 << 64) - 1)
    for other in (h2, np.uint64(0)):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = ((x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)) ^ other
    x ^= x >> np.uint64(31)
    return x % np.maximum(np.asarray(bits), 1).astype(np.uint64)


_SHARD = pa.schema([("shard", pa.int64()), ("bits", pa.list_(pa.int64())), ("words", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary())])
_SHARD_SQL = "shard bigint, bits array<bigint>, words binary, prints binary, counts binary"


def build_shard(h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Bits of each level, their words, and fingerprints and counts by slot, for distinct keys."""
    bits, words, order = [], [], []
    rest = np.arange(len(h1))
    while len(rest):
        size = -(-max(64, SPARE * len(rest)) // 64) * 64
        at = _picked(h1[rest], h2[rest], len(bits), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        kept = alone[at]
        bits.append(size)
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        order.append(rest[kept][np.argsort(at[kept])])
        rest = rest[~kept]
    slots = np.concatenate(order) if order else rest
    return bits, np.concatenate(words) if words else np.zeros(0, np.uint64), h2[slots], np.minimum(n[slots], MOST_COUNT).astype(np.uint16)


def _build(table: pa.Table) -> pa.Table:
    h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    bits, words, prints, counts = build_shard(h1, h2, table.column("n").to_numpy())
    return pa.table([[table.column("shard")[0].as_py()], [bits], [words.tobytes()], [prints.tobytes()], [counts.tobytes()]], schema=_SHARD)


class Index:
    """Some shards of ``shards``, as arrays that a batch of keys probes at once."""

    def __init__(self, shards: int, held: list[tuple]):
        levels = max((len(bits) for _, bits, *_ in held), default=0)
        self.shards = shards
        self.bits = np.zeros((shards, levels), np.int64)
        self.word = np.zeros((shards, levels), np.int64)
        self.rank = np.zeros(shards, np.int64)
        at = slots = 0
        for shard, bits, words, prints, _ in held:
            sizes = np.array(bits, np.int64) // 64
            self.bits[shard, : len(bits)] = bits
            self.word[shard, : len(bits)] = at + np.cumsum(sizes) - sizes
            at, slots = at + len(words) // 8, slots + len(prints) // 8
        self.words = np.frombuffer(b"".join(h[2] for h in held), np.uint64)
        self.prints = np.frombuffer(b"".join(h[3] for h in held), np.uint64)
        self.counts = np.frombuffer(b"".join(h[4] for h in held), np.uint16)
        ones = np.bitwise_count(self.words).astype(np.int64)
        # Slots follow each other over levels and shards, as their words do.
        self.before = np.cumsum(ones) - ones

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents of each key; 0 for keys that are not in these shards."""
        out = np.zeros(len(h1), np.int64)
        shard = shard_of(h1, self.shards)
        rest = np.arange(len(h1))
        for level in range(self.bits.shape[1]):
            bits = self.bits[shard[rest], level]
            rest, bits = rest[bits > 0], bits[bits > 0]
            at = _picked(h1[rest], h2[rest], level, bits).astype(np.int64)
            word = self.word[shard[rest], level] + (at >> 6)
            bit = np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (self.words[word] & bit) != 0
            found, word, bit = rest[hit], word[hit], bit[hit]
            slot = self.before[word] + np.bitwise_count(self.words[word] & (bit - np.uint64(1)))
            out[found] = np.where(self.prints[slot] == h2[found], self.counts[slot], 0)
            rest = rest[~hit]
        return out


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return np.mod(h1.view(np.int64), shards)


def line_index(docs: DataFrame, least_docs: int, least_chars: int, text_col: str = "text") -> tuple[DataFrame, int]:
    """The shards of the keys that enough documents hold, stored, and their number."""
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    counted = texts.mapInArrow(_count_keys(least_chars), "h1 bigint, h2 bigint, n bigint")
    common = stored(counted.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs), "common-lines")
    shards = max(1, -(-common.count() // SHARD_KEYS))
    dealt = common.withColumn("shard", F.pmod("h1", F.lit(shards)))
    built = stored(dealt.groupBy("shard").applyInArrow(_build, _SHARD_SQL), "line-shards")
    discard(docs.sparkSession, common)
    return built, shards


_KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def _probe(held: Broadcast, shards: int, least_docs: int, least_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kept(text: bytes, keys: list[bytes | None], common: set[bytes]) -> tuple[str, int]:
        lines = [line for line, key in zip(text.split(b"\n"), keys, strict=True) if key not in common]
        return b"\n".join(lines).decode("utf-8", "replace"), len(keys) - len(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shards, held.value)
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                texts = [text or b"" for text in part.column(1).to_pylist()]
                keys = [line_keys(text, least_chars) for text in texts]
                distinct = list({key for each in keys for key in each} - {None})
                counts = index.count(*_halves(map(xxhash.xxh3_128_digest, distinct)))
                common = {distinct[i] for i in np.flatnonzero(counts >= min(least_docs, MOST_COUNT))}
                out = [kept(*each, common) for each in zip(texts, keys, strict=True)]
                first = [n if n is not None else len(each) for n, each in zip(part.column(2).to_pylist(), keys, strict=True)]
                dropped = [n + more for n, (_, more) in zip(part.column(3).to_pylist(), out, strict=True)]
                columns = [part.column(0), pa.array([text for text, _ in out], pa.string()), pa.array(first, pa.int64()), pa.array(dropped, pa.int64())]
                yield pa.record_batch(columns, schema=_KEPT)

    return run


def drop_common_lines(
    docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS,
    id_col: str = "doc_id", text_col: str = "text", round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: the other lines joined again, lines before dropping, and lines dropped."""
    spark = docs.sparkSession
    built, shards = line_index(docs, least_docs, least_chars, text_col)
    size = F.octet_length("words") + F.octet_length("prints") + F.octet_length("counts")
    rounds, filled = [[]], 0
    # Number and bytes of each shard; a shard holds SHARD_KEYS keys.
    for row in built.select("shard", size.alias("bytes")).orderBy("shard").toLocalIterator():
        if rounds[-1] and filled + row["bytes"] > round_bytes:
            rounds.append([])
            filled = 0
        rounds[-1].append(row["shard"])
        filled += row["bytes"]
    schema = "doc_id bigint, text string, n_lines bigint, n_dropped bigint"
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
        F.lit(None).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped"),
    )
    for at, chosen in enumerate(rounds):
        if at:
            rows = stored(rows, "lines-kept")
        low, high = (chosen[0], chosen[-1]) if chosen else (0, -1)
        held = [tuple(row) for row in built.where(F.col("shard").between(low, high)).orderBy("shard").collect()]
        probe = _probe(spark.sparkContext.broadcast(held), shards, least_docs, least_chars)
        rows = rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(probe, schema)
    return rows
