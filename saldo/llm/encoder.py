"""Token ids of whole texts by way of their distinct words.

Tokenizers treat what stands between two spaces alone, so a text is cut at its spaces, each distinct piece is
encoded once and remembered, and the ids of a text are gathered from the remembered ones. A space is a cut only
where a character other than white space follows; there the next word takes the space, whatever stands before.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: For each word its ids, as a list or an array.
EncodeWords = Callable[[list[str]], list]

#: White space in Python's sense holds all that tokenizers call white space, so no cut is wrong.
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|\Z)")
#: Remembered pieces and ids beyond which a worker forgets what it has not met lately; they bound memory and
#: change no result.
HELD_PIECES = 500_000
HELD_IDS = 4_000_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Runs that every tokenizer of this kind keeps apart: letters old enough to be letters everywhere, marks (but for
#: apostrophes and the angles of special tokens), and single line ends. A piece of such runs alone has the ids of its runs.
_RUNS = re.compile(rf"[{_LETTERS}]+|[!-&(-/:;=?@\[-`{{-~]+|\n(?!\n)")
_PLAIN = re.compile(rf" ?[{_LETTERS}]+")
#: Characters of a text that are looked at together.
SEGMENT = 1 << 20


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The runs of the pool at these places, one after the other."""
    sizes = sizes[places]
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts[places] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Encodes texts with a function that encodes words; ``spaced`` says whether a word takes the space before it."""

    def __init__(self, encode_words: EncodeWords, spaced: bool, held_pieces: int = HELD_PIECES):
        self.encode_words, self.spaced, self.held_pieces = encode_words, spaced, held_pieces
        self.old = ({}, {}, None, None, None)
        self._forget()

    def _forget(self) -> None:
        """What was learnt becomes the old generation, from which words are taken when they come again."""
        if hasattr(self, "pool"):
            self.old = (self.first, self.rest, self.pool, self.starts, self.sizes)
        self.first: dict[str, int] = {}
        self.rest: dict[str, int] = self.first if not self.spaced else {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.count = 0

    def _learn(self, words: list[str], held: dict[str, int], before: str) -> None:
        first, rest, pool, starts, sizes = self.old
        known = rest if before or not self.spaced else first
        olds = [word for word in words if word in known]
        fresh = [word for word in words if word not in known] if olds else words
        # Pieces of several runs are put together from the ids of their runs.
        split, runs_of, whole = [], [], []
        for word in fresh:
            runs = _RUNS.findall(word)
            if len(runs) > 1 and sum(map(len, runs)) == len(word):
                split.append(word)
                runs_of.append(runs)
            else:
                whole.append(word)
        if split:
            heads, tails = self.rest if before or not self.spaced else self.first, self.first
            self._meet({runs[0] for runs in runs_of}, heads, before)
            self._meet({run for runs in runs_of for run in runs[1:]}, tails, "")
            at = np.array([k for runs in runs_of for k in (heads[runs[0]], *(tails[run] for run in runs[1:]))])
            counts = np.array([len(runs) for runs in runs_of])
            self._hold(split, held, _gather(self.pool, self.starts, self.sizes, at), np.add.reduceat(self.sizes[at], np.cumsum(counts) - counts))
        if olds:
            at = np.array([known[word] for word in olds])
            self._hold(olds, held, _gather(pool, starts, sizes, at), sizes[at])
        if whole:
            ids = self.encode_words([before + word for word in whole])
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            self._hold(whole, held, np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts)

    def _meet(self, words: set[str], held: dict[str, int], before: str) -> None:
        fresh = words.difference(held)
        if fresh:
            self._learn(list(fresh), held, before)

    def _hold(self, words: list[str], held: dict[str, int], ids: np.ndarray, counts: np.ndarray) -> None:
        total, n = len(ids), len(words)
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), total), np.uint32)])
        while self.count + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.starts, self.sizes))
        self.pool[self.used : self.used + total] = ids
        self.starts[self.count : self.count + n] = self.used + np.cumsum(counts) - counts
        self.sizes[self.count : self.count + n] = counts
        held.update(zip(words, range(self.count, self.count + n), strict=True))
        self.used += total
        self.count += n

    def _cut(self, text: str) -> list[str]:
        return _CUT.split(text) if _ODD.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        if self.used > HELD_IDS or self.count > self.held_pieces:
            self._forget()
        if not self.spaced:
            return self._encode_distinct(texts)
        pieces: list[str] = []
        heads: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for at, text in enumerate(texts):
            cut = self._cut(text)
            counts[at] = len(cut)
            heads.append(cut[0])
            pieces += cut
        places = np.fromiter(map(self.rest.get, pieces, repeat(-1)), np.int64, len(pieces))
        missed = np.flatnonzero(places < 0).tolist()
        if missed:
            words = [pieces[k] for k in missed]
            fresh = set(words).difference(self.rest)
            self._learn(list(fresh), self.rest, " ")
            places[missed] = [self.rest[word] for word in words]
        if texts:
            fresh = set(heads).difference(self.first)
            if fresh:
                self._learn(list(fresh), self.first, "")
            places[np.cumsum(counts) - counts] = [self.first[head] for head in heads]
        edges = np.concatenate([[0], np.cumsum(self.sizes[places])])[np.concatenate([[0], np.cumsum(counts)])]
        return _gather(self.pool, self.starts, self.sizes, places), np.diff(edges)

    def _encode_distinct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """encode() where every space is a cut: Arrow finds the distinct pieces, so each is looked up once."""
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        places = np.fromiter(map(self.rest.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(places < 0).tolist()
        if missed:
            fresh = [words[k] for k in missed]
            self._learn(fresh, self.rest, "")
            places[missed] = [self.rest[word] for word in fresh]
        places = places[coded.indices.to_numpy()]
        ends = np.cumsum(pc.list_value_length(cut).to_numpy())
        edges = np.concatenate([[0], np.cumsum(self.sizes[places])])[np.concatenate([[0], ends]).astype(np.int64)]
        return _gather(self.pool, self.starts, self.sizes, places), np.diff(edges)

    def encode_long(self, text: str) -> np.ndarray:
        """The ids of one text of any length, looked at in segments that end at a cut."""
        out, start, lead = [], 0, ""
        while len(text) - start > SEGMENT and (cut := _CUT.search(text, start + SEGMENT)):
            out.append(self._segment(text[start : cut.start()], lead))
            start, lead = cut.end(), " "
        out.append(self._segment(text[start:], lead))
        return np.concatenate(out)

    def _segment(self, text: str, lead: str) -> np.ndarray:
        if not (lead and self.spaced):
            return self.encode([text])[0]
        # A first word without text before it would lose its space: put a word before it and take that away.
        ids, _ = self.encode(["a " + text])
        return ids[len(self.encode_words(["a"])[0]) :]

    def batches(self, texts: Iterator[str | None], chars: int = SEGMENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """encode() over runs of texts that hold about so many characters, long texts by themselves."""
        some: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if len(text) > chars:
                if some:
                    yield self.encode(some)
                    some, size = [], 0
                ids = self.encode_long(text)
                yield ids, np.array([len(ids)])
                continue
            some.append(text)
            size += len(text)
            if size > chars:
                yield self.encode(some)
                some, size = [], 0
        if some:
            yield self.encode(some)


@cache
def library_encoder(path: str, spaced: bool) -> Encoder:
    """An encoder whose words the tokenizers library encodes; one for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    # A word of plain letters is one word of the model, and its symbols are those of its letters one by one.
    def symbols(text: str) -> str:
        normal = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
        return "".join(piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal))

    table = {n: symbols(chr(n)) for n in range(256) if re.fullmatch(f"[{_LETTERS}]", chr(n))}
    table[ord(" ")] = symbols(" a").removesuffix(symbols("a"))
    tokenize, plain = tokenizer.model.tokenize, _PLAIN.fullmatch

    def encode_words(words: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[t.id for t in tokenize(word.translate(table))] if plain(word) else [] for word in words]
        others = [k for k, word in enumerate(words) if not plain(word)]
        for at in range(0, len(others), 1000):
            some = others[at : at + 1000]
            for k, found in zip(some, tokenizer.encode_batch_fast([words[k] for k in some], add_special_tokens=False), strict=True):
                out[k] = found.ids
        return out

    return Encoder(encode_words, spaced)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is on this machine; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)
