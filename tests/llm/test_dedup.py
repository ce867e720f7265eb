"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash

from saldo.llm import block_naming, simhash_bk

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab "), (6, "ab"), (6, "ab"), (None, "ab  "), (8, "x" * 5000), (9, "x" * 5000 + " "), (10, "x" * 4999 + "y"), (11, "é\x0b\x0c\r"), (12, "é")]


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("block", [7, 512, 8192])
@pytest.mark.parametrize("held", [1, 1 << 20])
def test_exact_duplicates(documents, block, held):
    got = block_naming.exact_duplicates(documents(ODD), block_bytes=block, held_bytes=held).collect()
    groups = {}
    for doc_id, text in ODD:
        groups.setdefault(plain(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    by_sha = {hashlib.sha256(p.encode()).hexdigest(): sorted(g) for p, g in groups.items()}
    assert len(got) == len(ODD)
    for row in got:
        group = by_sha[row.text_sha256]
        assert (row.keep_id, row.group_size) == (group[0][3], len(group))
    for sha, group in by_sha.items():
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1


def test_exact_duplicates_of_long_texts_that_differ_late(documents):
    rng = random.Random(3)
    base = "".join(rng.choices("abcdef", k=3000))
    texts = [base[:n] for n in range(2990, 3000)] * 2 + [base[:1500] + c + base[1501:] for c in "uvw"]
    got = block_naming.exact_duplicates(documents(list(enumerate(texts))), block_bytes=64)
    assert {r.doc_id: r.keep_id for r in got.collect()} == {i: texts.index(t) for i, t in enumerate(texts)}


def test_stages_keep_columns_and_one_of_repeated_rows(documents):
    docs = documents(ODD)
    for stage in (block_naming.keep_first_copies, simhash_bk.keep_first_of_components):
        out = stage(docs)
        assert out.schema == docs.schema
    assert block_naming.keep_first_copies(docs).count() == len({plain(t) for _, t in ODD})


def test_empty_tables(documents):
    empty = documents([])
    assert block_naming.exact_duplicates(empty).collect() == []
    assert simhash_bk.near_duplicates(empty).collect() == []
    assert block_naming.keep_first_copies(empty).columns == empty.columns


def slow_fingerprint(text):
    words = [w.lower() for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " ", "One", "one two", "one two three", "Ünï CODE ÀÉ x", "a b c d a b c d a b c", "w " * 70000])
def test_fingerprint(text, monkeypatch):
    if text and len(text) > 1000:
        monkeypatch.setattr(simhash_bk, "CHUNK", 1000)
    assert simhash_bk.fingerprint(text) == slow_fingerprint(text)


def brute_components(values, radius):
    root = list(range(len(values)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(values)):
        groups.setdefault(top(i), set()).add(values[i])
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("crowded", [2, 2048])
def test_links_join_all_within_two_bits(spark, crowded):
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            value = centre
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                value ^= 1 << bit
            values.add(value)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    edges = simhash_bk.links(prints, 2, crowded)
    for e in edges.collect():
        assert ((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 2
    root = {r.node: r.root for r in simhash_bk.components(edges).collect()}
    groups = {}
    for v in signed:
        groups.setdefault(root.get(v, v), set()).add(v & (2**64 - 1))
    assert sorted(map(sorted, groups.values())) == brute_components(values, 2)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a bigint, b bigint")
    assert {r.node: r.root for r in simhash_bk.components(edges).collect()} == {**{i: 0 for i in range(61) if i}, 101: 100}


def test_near_duplicates(documents):
    rng = random.Random(2)
    words = [rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(300)]
    rows = [(5, " ".join(words)), (3, " ".join(words) + " "), (9, " ".join(words).upper()), (7, "quite another text"), (8, None), (2, ""), (None, " ".join(words))]
    got = simhash_bk.near_duplicates(documents(rows)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (3, 3), (9, 3), (None, 3), (7, 7), (8, 2), (2, 2)}
    assert all(r.fingerprint == f"{slow_fingerprint(dict(rows)[r.doc_id]):016x}" for r in got)
    kept = simhash_bk.keep_first_of_components(documents(rows)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 7]
