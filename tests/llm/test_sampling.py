"""Resampling, common lines and vector codes against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from saldo.llm import ball_codes, bit_sliced_resampling, line_index
from saldo.llm.queries import QUERIES

LONG = "zygote " * 30_000 + "é" * 5_000
TEXTS = [
    (1, "Alpha beta gamma, ALPHA beta"), (2, None), (3, ""), (4, "  \t\n"), (5, LONG), (6, "a"), (None, "alpha beta"),
    (7, "word " * 25), (7, "word " * 25), (8, "word " * 25), (9, "naïve Ünïcode 漢字 x9 " * 6), (None, None),
]


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def features(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small(text or ""))
    return found, [" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def resampled(rows, target):
    docs = Counter(bucket(f) for _, text in rows for f in features(text)[1])
    goal = Counter(bucket(f) for text in target for f in features(text)[1])
    all_docs, all_goal = sum(docs.values()) + 10_000, sum(goal.values()) + 10_000
    out = []
    for i, text in rows:
        found, named = features(text)
        weight = sum(
            math.floor(1000 * math.log((goal[b] + 1) * all_docs / ((docs[b] + 1) * all_goal))) for b in map(bucket, named)
        )
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(named), weight, score, None, len(found)])
    fit = sorted((o for o in out if o[5] >= 20), key=lambda o: (-o[3], math.inf if o[0] is None else o[0], o[1], o[2]))
    for rank, o in enumerate(fit[: len(fit) * 5 // 100], 1):
        o[4] = rank
    return sorted((tuple(o[:5]) for o in out), key=str)


def test_joined_crc_of_any_length():
    rng = np.random.default_rng(1)
    left = [rng.bytes(n) for n in (0, 1, 7, 300)]
    for n in (0, 1, 63, 64, 65, 127, 128, 5000, 70_000):
        right = rng.bytes(n)
        crc = np.array([zlib.crc32(a) for a in left], np.uint32)
        got = bit_sliced_resampling.joined_crc(crc, np.full(4, zlib.crc32(right), np.uint32), np.full(4, n))
        assert got.tolist() == [zlib.crc32(a + right) for a in left]


def test_weights_by_planes_are_the_sums():
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.5, (5, 10_000))
    counts[0, 17], counts[1] = 1_000_003, 0
    gains = rng.integers(-9_000, 9_000, 10_000)
    for signed in (gains, np.abs(gains), -np.abs(gains), np.zeros(10_000, np.int64), np.where(gains > 0, -(1 << 13), (1 << 13) - 1)):
        assert bit_sliced_resampling.weights(counts, bit_sliced_resampling.gain_planes(signed)).tolist() == (counts @ signed).tolist()


def test_resampling_of_odd_rows(spark, documents):
    docs = documents(TEXTS)
    target = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "")], "item_id int, text string")
    got = bit_sliced_resampling.resample(docs, target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled(TEXTS, ["alpha beta gamma", None, ""])


def test_resampling_draws_copies_one_by_one(spark, documents):
    rows = [(None if i % 3 == 0 else i % 7, "word " * 20 + "x" * (i % 2)) for i in range(200)]
    got = bit_sliced_resampling.resample(documents(rows).repartition(5), spark.createDataFrame([("x word",)], "text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled(rows, ["x word"])


def test_resampling_of_empty_tables(spark, documents):
    target = spark.createDataFrame([], "text string")
    assert bit_sliced_resampling.resample(documents([]), target).collect() == []
    rows = [(1, "one two"), (2, "word " * 30)]
    assert sorted((tuple(r) for r in bit_sliced_resampling.resample(documents(rows), target).collect()), key=str) == resampled(rows, [])


def without_common(rows, least_docs, least_chars):
    key = lambda line: small(line.strip(" \t\n\v\f\r"))
    found = Counter()
    for _, text in rows:
        found.update({key(line) for line in (text or "").split("\n")})
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or found[key(x)] < least_docs]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


LINES = [
    (1, "Head\none\n foot \n"), (2, "HEAD\t\ntwo\nfoot"), (3, "head\r\n\nthree\n\nFoot"), (None, "Head"), (None, "head\nfoot"), (4, None), (5, ""),
    (6, "É\né\nÉ"), (7, "É"), (8, "é"), (9, "same\nsame\nsame"), (9, "same\nsame\nsame"), (10, "x" * 200_000 + "\nhead"), (11, "\v\f \n\x1c"),
]


@pytest.mark.parametrize("least_docs, least_chars", [(1, 1), (2, 1), (2, 0), (2, 2), (3, 5), (100, 1)])
def test_common_lines_of_odd_rows(documents, least_docs, least_chars):
    got = line_index.drop_common_lines(documents(LINES), least_docs, least_chars)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == without_common(LINES, least_docs, least_chars)


def test_common_lines_over_many_shards_and_rounds(spark, documents, monkeypatch):
    monkeypatch.setattr(line_index, "SHARD_KEYS", 50)
    rows = [(i, "\n".join(f"line {j}" for j in range(i % 40, 700, i % 40 + 1))) for i in range(120)]
    got = line_index.drop_common_lines(documents(rows).repartition(4), 5, round_bytes=3000)
    assert sorted((tuple(r) for r in got.collect()), key=str) == without_common(rows, 5, 1)


def test_common_lines_of_an_empty_table(documents):
    assert line_index.drop_common_lines(documents([])).collect() == []


def test_the_index_holds_its_keys_and_no_others():
    rng = np.random.default_rng(3)
    h1, h2 = (rng.integers(0, 1 << 63, 30_000).astype(np.uint64) for _ in range(2))
    h1[:100] = h1[100:200]  # Keys that share half of their hash.
    n = rng.integers(1, 100_000, 30_000)
    shard = line_index.shard_of(h1, 7)
    built = []
    for s in (0, 2, 3, 4, 5, 6):
        at = shard == s
        bits, words, prints, counts = line_index.build_shard(h1[at], h2[at], n[at])
        assert len(prints) == len(counts) == at.sum() and sum(bits) < 8 * at.sum()
        built.append((s, bits, words.tobytes(), prints.tobytes(), counts.tobytes()))
    index = line_index.Index(7, built)
    assert index.count(h1, h2).tolist() == np.where(shard == 1, 0, np.minimum(n, line_index.MOST_COUNT)).tolist()
    assert not index.count(h1, h2 ^ np.uint64(1)).any() and not index.count(h1 ^ np.uint64(1 << 40), h2).any()


def coded(rows, parts=16, entries=64, rounds=2):
    """Rows (id, integers, label) by a full search in plain loops."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1])
    ends = np.cumsum([0] + [width // parts + (i < width % parts) for i in range(parts)])
    books = [[list(r[1][ends[p] : ends[p + 1]]) for r in rows[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            held = [[] for _ in book]
            for r in rows:
                part = r[1][ends[p] : ends[p + 1]]
                held[nearest(part, book)[1]].append(part)
            books[p] = [[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(held, book)]
    out, sums = [], Counter()
    for i, v, label in rows:
        found = [nearest(v[ends[p] : ends[p + 1]], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(e for e, _ in found), label))
        sums[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, error, sums[label]) for i, code, error, label in out), key=str), digest


SHAPE = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("name", T.StringType()),
])


def run_codes(spark, rows, **options):
    found, books = ball_codes.encode(spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SHAPE), **options)
    got = ball_codes.with_label_errors(found).select("vec_id", "code", "error", "label_error").collect()
    return sorted((tuple(r) for r in got), key=str), books


@pytest.mark.parametrize("width, count, entries, rounds", [(64, 150, 64, 2), (32, 40, 8, 3), (20, 30, 4, 1), (5, 25, 5, 2), (16, 12, 64, 0)])
def test_vector_codes(spark, width, count, entries, rounds):
    rng = np.random.default_rng(width)
    # Few different values make ties and equal entries.
    rows = [(int(i), (rng.integers(-6, 7, width) / 256 * (1 if i % 3 else 9)).tolist(), int(i) % 4 or None) for i in rng.permutation(count)]
    got, books = run_codes(spark, rows, entries=entries, rounds=rounds)
    want, digest = coded([(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows], entries=entries, rounds=rounds)
    assert got == want and books.sha256() == digest


def test_vector_codes_of_odd_rows(spark):
    good = [(i % 9, [((i * j) % 13 - 6) / 100 for j in range(16)], None if i % 2 else 3) for i in range(40)] + [(None, [0.5] * 16, 1)] * 2
    bad = [(1, None, 1), (2, [], 1), (3, [0.1] * 15 + [None], 1), (4, [float("nan")] + [0.0] * 15, 1), (5, [float("inf")] * 16, 1), (6, [0.1] * 3, 1)]
    got, books = run_codes(spark, good + bad, entries=6)
    single = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in good]
    want, digest = coded(single, entries=6)
    assert got == want and books.sha256() == digest
    assert run_codes(spark, bad[:2])[0] == [] and run_codes(spark, [])[1] is None
    huge = [(i, [3e38 if i % 2 else -3e38] * 16, None) for i in range(4)]
    assert [r[2] for r in run_codes(spark, huge)[0]] == [0] * 4


def test_ball_search_skips_no_winner():
    rng = np.random.default_rng(4)
    for width, spread in ((1, 3), (4, 40), (3, 2)):
        rows, entries = rng.integers(-spread, spread + 1, (3000, width)), rng.integers(-spread, spread + 1, (50, width))
        gap = ((rows[:, None] - entries[None]) ** 2).sum(2)
        best, error = ball_search = ball_codes.ball_search(rows, entries, rng.integers(0, 50, 3000))
        assert best.tolist() == gap.argmin(1).tolist() and error.tolist() == gap.min(1).tolist(), ball_search


def test_the_digest_columns(spark, sf_dir):
    rows = QUERIES["op13_ball_codes"](spark, sf_dir).collect()
    vectors = [(r.vec_id, [math.floor(256 * x) for x in r.embedding], r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, digest = coded(vectors)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in rows), key=str) == want
    assert {r.codebooks_sha256 for r in rows} == {digest}
