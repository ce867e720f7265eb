"""Encoders, the automaton, packing and token files against the tokenizers library and brute force."""

from __future__ import annotations

import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from saldo.llm import bpe_automaton, packing, token_store
from saldo.llm import encoder as encoders
from saldo.llm.encoder import library_encoder, tokenizer_path
from saldo.sources.scratch import scratch_dir

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\t", "'", "s", "t", "ll", "é", "1", "23", "<|endoftext|>", "日", "\u0301", ".", "!?", "A", "\u00a0", "\x1c", "a", "b", "the", "\n\n", "|", "Ünder", "x" * 40]


def mixed_texts(n, seed=1):
    rng = random.Random(seed)
    return ["", " ", "a ", " a", "a \n b", "don't 't's", "\U0003fc3b ՘x", "ﬁ İI Σας"] + ["".join(rng.choices(PARTS, k=rng.randint(1, 40))) for _ in range(n)]


def library(path):
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@pytest.mark.parametrize("which", ["byte", "word", "automaton"])
def test_encoders_agree_with_the_library(which, monkeypatch):
    monkeypatch.setattr(encoders, "HELD_PIECES", 200)
    path = WORD if which == "word" else BYTE
    encoder = bpe_automaton.byte_level(BYTE).encoder if which == "automaton" else library_encoder(path, which == "byte")
    texts = mixed_texts(600)
    want = [x.ids for x in library(path).encode_batch(texts, add_special_tokens=False)]
    got = []
    for at in range(0, len(texts), 50):
        ids, counts = encoder.encode(texts[at : at + 50])
        got += [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == want
    monkeypatch.setattr(encoders, "SEGMENT", 20)
    assert [encoder.encode_long(t).tolist() for t in texts] == want


def plain_bpe(word, ranks):
    """Merge the best pair, the leftmost first, until none is left."""
    parts = list(word)
    while len(parts) > 1:
        rank, at = min((ranks.get(pair, 1 << 30), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 30:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def test_automaton_agrees_with_merging_on_random_merges():
    rng = random.Random(4)
    for _ in range(150):
        tokens, merges = list("abc"), []
        for _ in range(rng.randint(1, 12)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        vocab = {t: i for i, t in enumerate(tokens)}
        automaton = bpe_automaton.MergeAutomaton(vocab, merges)
        ranks = {m: i for i, m in enumerate(merges)}
        for _ in range(60):
            word = "".join(rng.choices("abc", k=rng.randint(1, 12)))
            assert [tokens[i] for i in automaton.encode_word(word)] == plain_bpe(word, ranks), (merges, word)


def test_automaton_names_symbols_it_lacks():
    automaton = bpe_automaton.MergeAutomaton({"a": 0, "b": 1, "ab": 2}, [("a", "b")])
    with pytest.raises(ValueError, match="no symbol"):
        automaton.encode_word("abz")


def test_encode_and_decode_documents(documents):
    texts = mixed_texts(60) + ["long " * 30000]
    rows = [(None, None), (1, None), (1, None), *enumerate(texts, 2)]
    tokenizer = library(BYTE)
    got = bpe_automaton.decode(bpe_automaton.encode(documents(rows), BYTE), BYTE).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, bpe_automaton.encode_and_decode(documents(rows), BYTE).collect())) == sorted(map(str, got))
    for row in got:
        text = dict(rows[3:]).get(row.doc_id) or ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        assert row.text == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe_automaton.decode(bpe_automaton.encode(documents([]), BYTE), BYTE).collect() == []


def best_bins(sizes, capacity):
    """The fewest bins, by trying everything."""
    best = [len(sizes)]

    def place(at, bins):
        if len(bins) >= best[0]:
            return
        if at == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[at] <= capacity and bins[k] not in bins[:k]:
                bins[k] += sizes[at]
                place(at + 1, bins)
                bins[k] -= sizes[at]
        place(at + 1, [*bins, sizes[at]])

    place(0, [])
    return best[0]


def test_lower_bound_and_best_fit_bracket_the_best():
    rng = random.Random(6)
    for _ in range(80):
        sizes = np.array([rng.randint(1, 20) for _ in range(rng.randint(1, 9))])
        bins, room = packing.best_fit_decreasing(sizes, 20)
        assert [20 - r for r in room] == [int(sizes[bins == b].sum()) for b in range(len(room))]
        assert packing.lower_bound(sizes, 20) <= best_bins(sorted(sizes.tolist(), reverse=True), 20) <= len(room)


@pytest.mark.parametrize("group_rows", [10, 50_000])
def test_packed_documents(documents, group_rows):
    rng = random.Random(8)
    texts = [None, "", "word " * 3000] + ["word, " * rng.randint(0, 500) for _ in range(150)]
    rows = [(None, "x"), (7, "twice"), (7, "twice"), *enumerate(texts, 10)]
    got = packing.packed_documents(documents(rows), BYTE, capacity=256, group_rows=group_rows).collect()
    tokenizer = library(BYTE)
    for doc_id, text in enumerate(texts, 10):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == doc_id)
        assert [m[0] for m in mine] == list(range(-(-len(ids) // 256)))
        assert all(m[2] == 256 for m in mine[1:]) and sum(m[2] for m in mine) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in mine)
    assert sum(r.doc_id == 7 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        ends = [0] + [o + n for o, n in sorted(places)]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 256
    bound = -(-sum(r.length for r in got) // 256)
    assert bound <= len(sequences) <= bound * 1.1 + 2
    assert packing.packed_documents(documents([]), BYTE).collect() == []


@pytest.mark.parametrize("n", [0, 1, 63, 65_536, 200_001])
def test_token_file_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_000).astype(np.uint32)
    cuts = np.sort(rng.integers(0, n + 1, 5))
    sizes = np.diff(np.concatenate([[0], cuts, [n]]))
    raw = token_store.pack_file([None, 1, 2, 2, 5, 9], ids, sizes)
    found = list(token_store.TokenFile(io.BytesIO(raw)).documents(some_blocks=1))
    assert [d for d, _, _ in found] == [None, 1, 2, 2, 5, 9]
    assert np.array_equal(np.concatenate([x for _, _, x in found]), ids)
    if n > token_store.BLOCK:
        assert np.array_equal(token_store.TokenFile(io.BytesIO(raw)).blocks(1, 2), ids[token_store.BLOCK : 2 * token_store.BLOCK])


@pytest.mark.parametrize("span", [1, 1000, token_store.BLOCK, 150_000])
def test_spans_of_a_token_file_are_its_documents(span):
    rng = np.random.default_rng(span)
    sizes = np.concatenate([rng.integers(0, 2000, 150), [0, 140_000, 0, 0, 1, token_store.BLOCK], rng.integers(0, 50, 20)])
    ids = rng.integers(0, 999, sizes.sum()).astype(np.uint32)
    file = token_store.TokenFile(io.BytesIO(token_store.pack_file(list(range(len(sizes))), ids, sizes)))
    ends = np.cumsum(sizes)
    spans = range(-(-len(ids) // span)) if span > 1 else range(3)
    found = [d for k in spans for d in file.documents(k * span, None if k + 1 == -(-len(ids) // span) else (k + 1) * span, some_blocks=2)]
    assert [d for d, _, _ in found] == (list(range(len(sizes))) if span > 1 else [d for d in range(len(sizes)) if ends[d] - sizes[d] < 3])
    for d, start, some in found:
        assert start == ends[d] - sizes[d] and np.array_equal(some, ids[start : ends[d]])


def test_hot_ids_have_ranges_by_their_number():
    edges = np.array([2, 7, 7, 7, 9])
    names = [None, 7, 1, None, 7, 7, 7, None, 2, 8, 9, 10] * 20
    got = token_store.places(names, edges, 3, 5).tolist()
    taken = {n: {p for m, p in zip(names, got, strict=True) if m == n} for n in set(names)}
    assert taken == {None: {0, 1, 2}, 1: {3}, 2: {3}, 7: {4, 5, 6}, 8: {7}, 9: {7}, 10: {8}}
    assert token_store.places([None, 4], np.array([], np.int64), 0, 9).tolist() == [0, 0]


def test_no_file_holds_all_rows_of_a_hot_id(spark, documents):
    rows = [(None, f"none {i}") for i in range(200)] + [(77, f"hot {i}") for i in range(200)] + [(i, f"text {i}") for i in range(200)]
    manifest = token_store.write_tokens(documents(rows).repartition(3), scratch_dir(spark, "t"), WORD, range_bytes=400)
    assert max(r.docs for r in manifest.collect()) <= 200
    got = sorted(token_store.read_tokens(spark, manifest, span_ids=7).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    tokenizer = library(WORD)
    assert sorted(r.ids for r in got) == sorted(np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes() for _, t in rows)
    assert [r.start for r in got] == [0, *np.cumsum([len(r.ids) // 4 for r in got])[:-1].tolist()]


def test_damaged_token_file_is_an_error():
    raw = bytearray(token_store.pack_file([1], np.arange(70_000, dtype=np.uint32) % 999, np.array([70_000])))
    raw[len(raw) // 4] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(token_store.TokenFile(io.BytesIO(bytes(raw))).documents())


def test_write_and_read_tokens(spark, documents):
    texts = [None, "", "Hello, World! don't", "x" * 300] + mixed_texts(80, seed=9)
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(6, "again"), (6, "again"), (None, "no id")]
    manifest = token_store.write_tokens(documents(rows), scratch_dir(spark, "t"), WORD, range_bytes=1000, file_ids=50)
    got = token_store.read_tokens(spark, manifest).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((d is not None, d or 0) for d, _ in rows)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id or -1 for r in ordered] == sorted(r.doc_id or -1 for r in got) or ordered[0].doc_id is None
    at = 0
    tokenizer = library(WORD)
    for r in ordered:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at
        at += len(ids)
        if r.doc_id not in (None, 6):
            assert ids == tokenizer.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids + [2]
    assert token_store.read_tokens(spark, token_store.write_tokens(documents([]), scratch_dir(spark, "t"), WORD)).collect() == []
