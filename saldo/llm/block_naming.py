"""Exact duplicates by deterministic block naming.

A text without its white space is cut into blocks of a fixed size. Equal blocks get one integer name: the
blocks are dealt out by content, sorted within each partition, and numbered in that order. Adjacent names are
then paired, and the distinct pairs sorted and numbered again, until every document has one name. Names stand
for contents one to one, so two documents share a name exactly when their texts are equal; no hash decides.

Copies are combined before anything moves: each task keeps a block once, with the list of places where it saw
it. Only the contents are dealt out to be named, once for each task; the names go back by task and local number, so
the places of a text that fills a third of the corpus are told their name by as many tasks as found it.

Cases: a null text counts as empty; an empty text is one empty block; a null id keeps its row and yields to
any other id; rows that are repeated in full are members of one group and one of them stays; an empty table
gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.rows import keep_rows, text_mark
from saldo.sources.scratch import discard, stored

WHITE = b" \t\n\v\f\r"
BLOCK_BYTES = 8192
#: Bytes of distinct blocks that a task holds before it sends them.
HELD_BYTES = 24 << 20

_REF = pa.struct(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("pos", pa.int32()), ("blocks", pa.int32())]
    + [("points", pa.int64()), ("sha256", pa.string())]
)
_BLOCK = pa.schema([("block", pa.int64()), ("content", pa.binary()), ("refs", pa.list_(_REF))])
_REF_SQL = (
    "array<struct<row: bigint, doc_id: bigint, mark: bigint, pos: int, blocks: int, points: bigint, sha256: string>>"
)


def _cut(block_bytes: int, held_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = block = TaskContext.get().partitionId() << 40
        held: dict[bytes, list[tuple]] = {}
        size = 0

        def sent():
            nonlocal block
            keys = list(held)
            # Few megabytes a batch, so that neither side holds much at once.
            step = max(1, (4 << 20) * len(keys) // max(1, size))
            for at in range(0, len(keys), step):
                part = keys[at : at + step]
                refs = [[dict(zip(_REF.names, ref, strict=True)) for ref in held[key]] for key in part]
                numbers = pa.array(range(block, block + len(part)), pa.int64())
                yield pa.record_batch([numbers, pa.array(part, pa.binary()), pa.array(refs, _BLOCK.field(2).type)], schema=_BLOCK)
                block += len(part)

        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, mark, text in zip(ids, marks, batch.column(2), strict=True):
                text = text.as_py() or ""
                plain = text.encode().translate(None, WHITE)
                count = max(1, -(-len(plain) // block_bytes))
                sha = hashlib.sha256(plain).hexdigest()
                for pos in range(count):
                    key = plain[pos * block_bytes : (pos + 1) * block_bytes]
                    ref = (row, doc_id, mark, pos, count, len(text), None if pos else sha)
                    if key in held:
                        held[key].append(ref)
                    else:
                        held[key] = [ref]
                        size += len(key)
                    size += 100
                row += 1
                if size > held_bytes:
                    yield from sent()
                    held, size = {}, 0
        yield from sent()

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the distinct contents of a sorted partition; the partition number makes the names unique."""
    name = (TaskContext.get().partitionId() << 40) - 1
    last = None
    for batch in batches:
        names = []
        for content in batch.column(1):
            content = content.as_py()
            if content != last:
                name += 1
                last = content
            names.append(name)
        yield pa.record_batch([batch.column(0), pa.array(names, pa.int64())], names=["block", "name"])


def name_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, held_bytes: int) -> DataFrame:
    """(row, doc_id, mark, pos, blocks, points, sha256, name) for every block of every document, stored."""
    spark = docs.sparkSession
    cut = docs.select(F.col(id_col).cast("bigint"), text_mark(F.col(text_col)), F.col(text_col)).mapInArrow(
        _cut(block_bytes, held_bytes), f"block bigint, content binary, refs {_REF_SQL}"
    )
    held = stored(cut, "cut-blocks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.select("block", "content").repartition(parts, "content").sortWithinPartitions("content")
    names = stored(dealt.mapInArrow(_number, "block bigint, name bigint"), "block-names")
    # A block number is one task's, and its list of places is bounded by what that task holds.
    told = held.select("block", "refs").join(names, "block").select("name", F.explode("refs").alias("ref"))
    out = stored(told.select("ref.*", "name"), "blocks")
    discard(spark, held, names)
    return out


def identities(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """One row per document: row, doc_id, mark, points, sha256, level, name; (level, name) is its identity."""
    spark = docs.sparkSession
    blocks = name_blocks(docs, id_col, text_col, block_bytes, held_bytes)
    most = blocks.agg(F.max("blocks")).first()[0] or 1
    head = blocks.where("pos = 0").select("row", "doc_id", "mark", "points", "sha256", "blocks", "name")
    out = head.where("blocks = 1").select("row", "doc_id", "mark", "points", "sha256", F.lit(0).alias("level"), "name")
    if most == 1:
        return out
    level, left = 0, blocks.where("blocks > 1").select("row", "pos", "blocks", "name")
    final = None
    while most > 1:
        level += 1
        pairs = stored(
            left.groupBy("row", F.expr("pos div 2").cast("int").alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                # A last block without a neighbour is paired with no name at all.
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
                F.max(F.expr("(blocks + 1) div 2")).cast("int").alias("blocks"),
            ),
            "pairs",
        )
        numbers = stored(
            pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id()),
            "pair-names",
        )
        renamed = stored(pairs.join(numbers, ["a", "b"]).select("row", "pos", "blocks", "name"), "names")
        discard(spark, pairs, numbers)
        done = renamed.where("blocks = 1").select("row", F.lit(level).alias("level"), "name")
        final = done if final is None else final.unionByName(done)
        left, most = renamed.where("blocks > 1"), (most + 1) // 2
    return out.unionByName(head.where("blocks > 1").drop("blocks", "name").join(final, "row").select(*out.columns))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, mark for every document.

    Of equal texts the one with the most code points in its original text stays, then the smallest id.
    """
    rows = stored(identities(docs, id_col, text_col, block_bytes, held_bytes), "identities")
    best = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    groups = stored(
        rows.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best")), "groups"
    )
    # Both sides are read from files, so that a hot identity is split at run time.
    return rows.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
        "mark",
    )


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The documents that exact_duplicates keeps; the columns stay as they are."""
    return keep_rows(docs, exact_duplicates(docs).where("kept"))
