"""Token ids in binary files, coded by a static range asymmetric numeral system.

Documents are dealt into ranges of their id, and each range becomes one file or more. A file holds

    magic, length of the header, header (JSON: counts, section sizes, checksums), then the sections
    symbols, frequencies   shared by all blocks of the file, 2**bits in total
    doc_ids, doc_sizes     in ascending order; a flag marks null ids
    checkpoints            for each block: first word, words, checksum of its ids, and the state of each lane
    words                  32-bit words, block after block

A block is ``BLOCK`` ids over ``LANES`` interleaved lanes with a 64-bit state each. Blocks are independent: a
checkpoint is all that is needed to decode its block, alone or many at a time, and its checksum is compared.
Sections other than the words are deflated. Files are written under a passing name and renamed when whole, so
a task that runs again or twice leaves the same file. Readers take spans of a file: a task begins at the block its
first document begins in, so several tasks decode one file.

Cases: a null text is an empty one, whose ids are the end id alone; null ids come first, in one order with the
others; repeated rows are kept; null ids and an id of many rows have ranges by their number (by doubles, so an id beyond
2**53 has one); a text of any length spans blocks; an empty table gives no files and an empty result; other
columns are not read. A damaged file raises an error. Folders are opened as in ``stores``.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saldo.llm.encoder import library_encoder
from saldo.llm.stores import open_store
from saldo.sources.scratch import stored

MAGIC = b"TOKRANS1"
BITS = 20
BLOCK = 1 << 16
LANES = 64
LOW = np.uint64(1 << 31)
END_ID = 2
#: Bytes of text for each range of ids, and ids beyond which a range starts another file.
RANGE_BYTES = 64 << 20
FILE_IDS = 4 << 20
#: Ids of a file that a task reads at once: the documents that begin among them.
SPAN_IDS = 32 * BLOCK
#: Ranges at the most, as their edges go to all tasks; beyond it a range has more bytes and so more files.
MOST_RANGES = 1 << 16


def frequencies(ids: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that occur and their shares of 2**bits, at least one each."""
    symbols, counts = np.unique(ids, return_counts=True)
    total = 1 << bits
    if len(symbols) > total // 2:
        raise ValueError("more symbols than the table has room for")
    shares = np.maximum(1, counts * total // max(1, counts.sum())).astype(np.int64)
    over = int(shares.sum()) - total
    # What rounding left or took goes to the most frequent symbols.
    for at in np.argsort(-shares, kind="stable"):
        change = max(-over, 1 - int(shares[at])) if over > 0 else -over
        shares[at] += change
        over += change
        if not over:
            break
    return symbols.astype(np.uint32), shares.astype(np.uint32)


def encode_blocks(places: np.ndarray, shares: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words per block, and states per block and lane, for places (blocks, steps, lanes) in the table."""
    blocks, steps, lanes = places.shape
    freq = shares.astype(np.uint64)
    base = np.cumsum(freq) - freq
    state = np.full((blocks, lanes), LOW, np.uint64)
    words = np.zeros((blocks, steps, lanes), np.uint32)
    full = np.zeros((blocks, steps, lanes), bool)
    limit = freq << np.uint64(63 - bits)
    shift, half = np.uint64(bits), np.uint64(32)
    for step in range(steps - 1, -1, -1):
        now = places[:, step]
        f = freq[now]
        emit = state >= limit[now]
        words[:, step] = state.astype(np.uint32)
        full[:, step] = emit
        state = np.where(emit, state >> half, state)
        whole = state // f
        state = (whole << shift) + (state - whole * f) + base[now]
    return words[full], full.sum(axis=(1, 2)), state


def decode_blocks(words: np.ndarray, starts: np.ndarray, states: np.ndarray, shares: np.ndarray, steps: int, bits: int = BITS) -> np.ndarray:
    """The places (blocks, steps, lanes) that encode_blocks coded."""
    freq = shares.astype(np.uint64)
    base = np.cumsum(freq) - freq
    # A narrow table stays in the processor's cache.
    symbol = np.repeat(np.arange(len(shares), dtype=np.uint16 if len(shares) < 1 << 16 else np.uint32), shares)
    out = np.empty((len(states), steps, states.shape[1]), np.int64)
    state, at = states.copy(), starts.astype(np.int64)
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    mask, shift, half = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32)
    for step in range(steps):
        slot = state & mask
        now = symbol[slot]
        out[:, step] = now
        state = freq[now] * (state >> shift) + slot - base[now]
        need = state < LOW
        order = np.cumsum(need, axis=1)
        read = words[np.minimum(at[:, None] + order - 1, len(words) - 1)]
        state = np.where(need, (state << half) | read, state)
        at += order[:, -1]
    return out


def pack_file(doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """The bytes of a file for documents in order; ids are all theirs, sizes how many each has."""
    symbols, shares = frequencies(ids)
    lookup = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.int64)
    lookup[symbols] = np.arange(len(symbols))
    blocks = -(-len(ids) // BLOCK)
    padded = np.full(blocks * BLOCK, int(np.argmax(shares)) if len(shares) else 0, np.int64)
    padded[: len(ids)] = lookup[ids]
    words, counts, states = encode_blocks(padded.reshape(blocks, BLOCK // LANES, LANES), shares)
    raw = ids.astype("<u4")
    sums = [zlib.crc32(raw[k * BLOCK : (k + 1) * BLOCK].tobytes()) for k in range(blocks)]
    sections = {
        "symbols": symbols.astype("<u4"),
        "frequencies": shares.astype("<u4"),
        "doc_ids": np.array([x or 0 for x in doc_ids], "<i8"),
        "doc_nulls": np.array([x is None for x in doc_ids], np.uint8),
        "doc_sizes": sizes.astype("<i8"),
        "block_words": counts.astype("<i8"),
        "block_sums": np.array(sums, "<u4"),
        "block_states": states.astype("<u8"),
    }
    packed = {name: zlib.compress(x.tobytes(), 1) for name, x in sections.items()} | {"words": words.astype("<u4").tobytes()}
    header = json.dumps(
        {"docs": len(doc_ids), "ids": len(ids), "blocks": blocks, "block": BLOCK, "lanes": LANES, "bits": BITS}
        | {"sections": [[name, len(x), zlib.crc32(x)] for name, x in packed.items()]}
    ).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *packed.values()])


class TokenFile:
    """A file that is open for reading."""

    KINDS = {"symbols": "<u4", "frequencies": "<u4", "doc_ids": "<i8", "doc_nulls": "u1", "doc_sizes": "<i8"} | {
        "block_words": "<i8",
        "block_sums": "<u4",
        "block_states": "<u8",
    }

    def __init__(self, source):
        self.source = source
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("no token file")
        (size,) = struct.unpack("<I", source.read(4))
        self.header = json.loads(source.read(size))
        self.parts: dict[str, np.ndarray] = {}
        for name, length, check in self.header["sections"][:-1]:
            raw = source.read(length)
            if zlib.crc32(raw) != check:
                raise ValueError(f"checksum of {name}")
            self.parts[name] = np.frombuffer(zlib.decompress(raw), self.KINDS[name])
        self.words_at = source.tell()
        self.word_ends = np.cumsum(self.parts["block_words"])

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first up to last, read from their checkpoints on."""
        head, parts = self.header, self.parts
        ends, counts = self.word_ends, parts["block_words"]
        begin = int(ends[first] - counts[first])
        self.source.seek(self.words_at + 4 * begin)
        words = np.frombuffer(self.source.read(4 * int(ends[last - 1] - begin)), "<u4")
        states = parts["block_states"].reshape(-1, head["lanes"])[first:last].astype(np.uint64)
        places = decode_blocks(words, (ends - counts)[first:last] - begin, states, parts["frequencies"], head["block"] // head["lanes"], head["bits"])
        ids = parts["symbols"][places.reshape(-1)][: head["ids"] - first * head["block"]]
        for k in range(first, last):
            piece = ids[(k - first) * head["block"] : (k - first + 1) * head["block"]]
            if zlib.crc32(piece.tobytes()) != parts["block_sums"][k]:
                raise ValueError(f"checksum of block {k}")
        return ids

    def documents(self, begin: int = 0, end: int | None = None, some_blocks: int = 32) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, ids) in order, with few blocks decoded at a time.

        With begin and end, only of the documents whose first id stands from the one place up to the other.
        """
        sizes, width = self.parts["doc_sizes"], self.header["block"]
        starts = np.cumsum(sizes) - sizes
        one = int(np.searchsorted(starts, begin))
        two = len(starts) if end is None else int(np.searchsorted(starts, end))
        if one == two:
            return
        block, at = divmod(int(starts[one]), width)
        last = -(-int(starts[two - 1] + sizes[two - 1]) // width)
        held = np.zeros(0, np.uint32)
        for doc_id, null, start, size in zip(*(x[one:two].tolist() for x in (self.parts["doc_ids"], self.parts["doc_nulls"], starts, sizes)), strict=True):
            if at + size > len(held):
                pieces, have = [held[at:]], len(held) - at
                while have < size:
                    pieces.append(self.blocks(block, min(block + some_blocks, last)))
                    block = min(block + some_blocks, last)
                    have += len(pieces[-1])
                # Before the first document of a span, its block has ids of the one before.
                held, at = np.concatenate(pieces), max(0, at - len(held))
            yield (None if null else doc_id), start, held[at : at + size]
            at += size


_ITEM = pa.schema([("range", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])
_FILE = pa.schema([("range", pa.int64()), ("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
_FILE_SQL = "range bigint, part int, path string, docs bigint, ids bigint"


def places(names: list[int | None], edges: np.ndarray, null_ranges: int, turn: int) -> np.ndarray:
    """The range of each id: after those of null ids, how many of the sorted edges lie below it.

    An id that is several edges has as many ranges, and null ids have theirs; a row takes one by a hash of its place in
    the task, counted from ``turn`` on, so a task that runs again deals alike.
    """
    ids = np.array([name or 0 for name in names], np.int64)
    null = np.array([name is None for name in names], bool)
    low = np.searchsorted(edges, ids, "left")
    room = np.where(null, null_ranges, np.searchsorted(edges, ids, "right") - low)
    drawn = (np.arange(turn, turn + len(ids)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
    return np.where(null, 0, null_ranges + low) + drawn % np.maximum(1, room)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, edges: list[int], null_ranges: int) -> DataFrame:
    """(range, doc_id, ids): ids and end id of each document, in two bytes each where all ids fit."""
    sent = docs.sparkSession.sparkContext.broadcast(np.array(edges, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, turn = library_encoder(tokenizer, spaced=False), 0
        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for ids, counts in encoder.batches(t.as_py() for t in batch.column(1)):
                ends = np.cumsum(counts)
                raw = [_narrow(np.append(ids[b:e], end_id)) for b, e in zip(ends - counts, ends, strict=True)]
                some = names[at : at + len(raw)]
                place = places(some, sent.value, null_ranges, turn)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip((place, some, raw), _ITEM, strict=True)], schema=_ITEM)
                at += len(raw)
                turn += len(raw)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, "range int, doc_id bigint, ids binary")


def _narrow(ids: np.ndarray) -> bytes:
    """A width byte and the ids in that width."""
    wide = int(ids.max()) > 65535
    return bytes([4 if wide else 2]) + ids.astype("<u4" if wide else "<u2").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.uint32)


def _file_writer(folder: str, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_store(folder)
        key, part, names, held, size = None, 0, [], [], 0

        def closed():
            name = f"tokens-{key:09d}-{part:04d}.rans"
            passing = f"{root}/.{name}.{uuid.uuid4().hex}"
            ids = np.concatenate(held)
            with system.open_output_stream(passing) as out:
                out.write(pack_file(names, ids, np.array([len(x) for x in held])))
            system.move(passing, f"{root}/{name}")
            row = [[key], [part], [f"{folder}/{name}"], [len(names)], [len(ids)]]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(row, _FILE, strict=True)], schema=_FILE)

        for batch in batches:
            for range_key, doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if names and (range_key != key or size > file_ids):
                    yield closed()
                    part = part + 1 if range_key == key else 0
                    names, held, size = [], [], 0
                key = range_key
                names.append(doc_id)
                held.append(_wide(raw))
                size += len(held[-1])
        if names:
            yield closed()

    return run


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    range_bytes: int = RANGE_BYTES,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write the files below a folder that all machines share; returns the manifest with each file's first position.

    The ranges follow quantiles of the id, found from the ids alone, so that each text is encoded once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size, rows, nulls = docs.agg(F.sum(F.octet_length(text_col)), F.count(F.lit(1)), F.count_if(F.col(id_col).isNull())).first()
    ranges = min(max(parts, -(-(size or 0) // range_bytes)), MOST_RANGES)
    shares = [k / ranges for k in range(1, ranges)] or [0.5]
    edges = docs.agg(F.percentile_approx(F.col(id_col).cast("bigint"), shares, 10 * len(shares) + 1000)).first()[0] or []
    system, root = open_store(folder)
    system.create_dir(root, recursive=True)
    null_ranges = ranges * nulls // max(1, rows)
    coded = encode_documents(docs, tokenizer, end_id, id_col, text_col, sorted(edges), null_ranges)
    # Every range is a partition of its own, so no task holds several of them by chance.
    dealt = coded.repartitionById(null_ranges + len(shares) + 1, "range").sortWithinPartitions("range", "doc_id")
    files = stored(dealt.mapInArrow(_file_writer(folder, file_ids), _FILE_SQL), "token-files")
    # One row a file, so one task can add up the lengths.
    before = F.sum("ids").over(Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("first", F.coalesce(before, F.lit(0)))


def read_tokens(spark: SparkSession, manifest: DataFrame, rows: int = 500, span_ids: int = SPAN_IDS) -> DataFrame:
    """(doc_id, start, ids): every document of the files, ids as little-endian unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, span, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = open_store(path)
                out: list[tuple] = []
                size = 0
                with system.open_input_file(name) as source:
                    for doc_id, start, ids in TokenFile(source).documents(span * span_ids, None if last else (span + 1) * span_ids):
                        out.append((doc_id, first + start, ids.astype("<u4").tobytes()))
                        size += len(ids)
                        if len(out) == rows or size > 1 << 20:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                            out, size = [], 0
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    last = F.greatest(F.lit(0), F.ceil(F.col("ids") / span_ids).cast("int") - 1)
    spans = manifest.select("path", "first", F.explode(F.sequence(F.lit(0), last)).alias("span"), last.alias("last"))
    files = stored(spans.withColumn("last", F.col("span") == F.col("last")), "token-places")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The spans are dealt out one by one: a few rows of names stand for much data.
    return files.repartition(max(1, parts)).mapInArrow(run, "doc_id bigint, start bigint, ids binary")
