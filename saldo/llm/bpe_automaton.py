"""Byte-pair encoding and decoding by a token automaton.

The automaton starts with one state and an arc for each base symbol. Each merge (a, b) -> c, in the order of the
merges, adds its gadget: the state that follows a is cloned without its arc b, the arcs labelled a lead to the clone,
and every state with an arc a gets an arc c that leads where a and then b led. All paths from the start then
spell proper encodings, one for every word. All arcs with one label lead to one state, so a state is kept as
the token whose arcs led to it and the number of clones it had, and an arc is found from the few gadgets that bear on
it; arcs that were looked up stay in a transition table.

A word is encoded by running over its symbols: of the tokens that end at a place, one only continues the
path of what stands before it. Decoding emits the labels of the arcs, that is the bytes of each token.

Cases: a null text is encoded as an empty one and has no ids; ids of no arc raise an error; bytes that are no
UTF-8 decode to replacement characters; repeated rows are encoded alike; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.encoder import Encoder

#: Rows of a batch that goes back to Spark.
ROWS = 500
#: What a worker remembers at most: transitions that were looked up, words, and pieces of text. They bound memory and
#: change no result.
HELD_ARCS, HELD_WORDS, HELD_PIECES = 2_000_000, 100_000, 450_000


class MergeAutomaton:
    """The proper encodings of all words under a list of merges."""

    START = -1

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        count = max(vocab.values(), default=-1) + 1
        self.width = count + 1
        #: Of a token that a merge made: the merge's number and the token's first half; base symbols have None.
        self.made: list[tuple[int, int] | None] = [None] * count
        #: Arcs that clones of the state after a token lost, and in which merge.
        self.lost: list[dict[int, int]] = [{} for _ in range(count)]
        #: The state after a token before any clone: the owner and the time of an earlier state.
        self.root: list[tuple[int, int]] = [(self.START, 0)] * count
        self.dead: set[int] = set()
        #: Every beginning of a token, with the token it is, if it is one.
        self.spelled: dict[str, int | None] = {t[:n]: None for t in vocab for n in range(1, len(t))} | vocab
        made = {vocab[a + b] for a, b in merges}
        base = {t for t in vocab.values() if t not in made}
        live = set(base)
        for time, (first, second) in enumerate(merges, 1):
            a, b, c = vocab[first], vocab[second], vocab[first + second]
            if a in live and b in live and c not in live and self._arc(a, time - 1, b, time - 1):
                self._gadget(time, a, b, c)
                live.add(c)
        self.dead = set(vocab.values()) - live
        self.table: dict[int, bool] = {}

    def _gadget(self, time: int, a: int, b: int, c: int) -> None:
        # c leads to the state after b as it was before this gadget.
        self.root[c] = (b, time - 1)
        self.lost[a][b] = time
        self.made[c] = (time, a)

    def _arc(self, owner: int, born: int, label: int, time: int) -> bool:
        """Whether the state after owner, as of merge born, had an arc with the label at a time."""
        while True:
            at, when = owner, min(born, time)
            while at != self.START:
                gone = self.lost[at].get(label)
                if gone is not None and gone <= when:
                    return False
                at, since = self.root[at]
                when = min(when, since)
            source = self.made[label]
            if source is None:
                return True
            # The arc came with its merge to the states that had an arc for the first half then.
            time, label = source

    def follows(self, last: int, token: int) -> bool:
        """The transition table: whether the state after last has an arc for the token."""
        key = (last + 1) * self.width + token
        found = self.table.get(key)
        if found is None:
            found = self.table[key] = token not in self.dead and (last == self.START or self._arc(last, 1 << 60, token, 1 << 60))
        return found

    def encode_word(self, word: str) -> list[int]:
        """The one path that spells the word."""
        spelled, follows, size = self.spelled.get, self.follows, len(word)
        last: list[int | None] = [self.START] + [None] * size
        back = [0] * (size + 1)
        for start in range(size):
            before = last[start]
            if before is None:
                raise ValueError(f"no symbol for {word[start - 1]!r}")
            for end in range(start + 1, size + 1):
                token = spelled(word[start:end], -1)
                if token == -1:
                    break
                if token is not None and last[end] is None and follows(before, token):
                    last[end], back[end] = token, start
        out, end = [], size
        while end:
            if last[end] is None:
                raise ValueError(f"no symbol for {word[end - 1]!r}")
            out.append(last[end])
            end = back[end]
        return out[::-1]


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Labels:
    """The labels of the arcs of a byte-level vocabulary: the bytes of each token."""

    def __init__(self, vocab: dict[str, int], special: dict[str, int]):
        symbols = _byte_symbols()
        labels = {i: bytes(symbols[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in special.items()}
        parts = [labels.get(i, b"") for i in range(max(labels) + 1)]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()


def _specification(path: str) -> tuple[dict, dict[str, int]]:
    """The model and the special tokens of a vocabulary file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    return spec["model"], {x["content"]: x["id"] for x in spec["added_tokens"]}


class ByteLevel:
    """A byte-level vocabulary file: words by the library's own splitting, ids by the automaton."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        model, self.special = _specification(path)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges)
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.words: dict[str, list[int]] = {}
        self.encoder = Encoder(lambda words: [self._ids(word) for word in words], spaced=True, held_pieces=HELD_PIECES)

    def _ids(self, text: str) -> list[int]:
        for content, number in self.special.items():
            if content in text:
                parts = [self._ids(part) for part in text.split(content)]
                return sum(([number, *part] for part in parts[1:]), parts[0])
        if len(self.words) > HELD_WORDS:
            self.words.clear()
        if len(self.automaton.table) > HELD_ARCS:
            self.automaton.table.clear()
        out: list[int] = []
        for word, _ in self.split(text):
            ids = self.words.get(word)
            if ids is None:
                ids = self.automaton.encode_word(word)
                if len(word) < 100:
                    self.words[word] = ids
            out += ids
        return out


@cache
def byte_level(path: str) -> ByteLevel:
    """One automaton for each worker process."""
    return ByteLevel(path)


@cache
def labels_of(path: str) -> Labels:
    """Labels alone, for each worker process that decodes."""
    model, special = _specification(path)
    return Labels(model["vocab"], special)


def _batches(columns: list[list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), ROWS):
        yield pa.record_batch([pa.array(c[at : at + ROWS], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and token ids of documents (id, text), some at a time."""
    encoder = byte_level(path).encoder
    for batch in batches:
        names, at = batch.column(0).to_pylist(), 0
        for ids, counts in encoder.batches(t.as_py() for t in batch.column(1)):
            edges = np.concatenate([[0], np.cumsum(counts)])
            tokens = [ids[a:b].astype("<u4") for a, b in zip(edges, edges[1:], strict=False)]
            yield names[at : at + len(tokens)], tokens
            at += len(tokens)


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_BOTH = pa.schema([*_IDS, ("text", pa.string())])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, tokens in _encoded(batches, path):
            yield from _batches([names, [t.tobytes() for t in tokens]], _IDS)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the text that the ids stand for, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = labels_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                raw = part.column(1).to_pylist()
                texts = [labels.decode(np.frombuffer(ids or b"", "<u4")).decode("utf-8", "replace") for ids in raw]
                yield pa.record_batch([part.column(0), pa.array(raw, pa.binary()), pa.array(texts, pa.string())], schema=_BOTH)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, text string")


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, text) as :func:`decode` after :func:`encode`, by one worker a core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = labels_of(path)
        for names, tokens in _encoded(batches, path):
            texts = [labels.decode(t).decode("utf-8", "replace") for t in tokens]
            yield from _batches([names, [t.tobytes() for t in tokens], texts], _BOTH)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, "doc_id bigint, ids binary, text string")
