"""Near duplicates by SimHash fingerprints and Burkhard-Keller trees.

Every document gets a 64-bit fingerprint of its word shingles. Distinct fingerprints go to shards: cut into four
16-bit parts, two fingerprints at most two bits apart agree in two parts at least, so a shard for each choice
of two parts and their value finds every link. A task builds the tree of a shard, its children keyed by
the Hamming distance to the parent, and each new fingerprint follows only the edges within the radius. The
trees are small parts of the whole and meet their queries by a shuffle on the shard, never by a broadcast of
all fingerprints: their number grows with the corpus, so no bound could be stated for it.

A shard sends a spanning forest of its links, not its pairs. A crowded shard is cut again by the other two
parts, so that no shard is larger than the values of its last 16 bits. Components are found by large and
small star steps over written tables.

Cases: a null or blank text has fingerprint zero and links like any other; repeated rows share a fingerprint;
a null id takes part and never names a component that has another id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.llm.rows import keep_rows, text_mark
from saldo.sources.scratch import discard, stored

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: Members beyond which a shard is cut again.
CROWDED = 2048
#: Shingles whose bits are counted at a time, which bounds the memory of a very long text.
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text as an unsigned number."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(parts) - words + 1
    for start in range(0, n, CHUNK):
        some = parts[start : start + CHUNK + words - 1]
        if words == 3:
            hashes = [digest(b"%b %b %b" % three, SEED) for three in zip(some, some[1:], some[2:], strict=False)]
        else:
            hashes = [digest(b" ".join(some[i : i + words]), SEED) for i in range(len(some) - words + 1)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("bigint")
    def udf(texts: pa.Array) -> pa.Array:
        found = [fingerprint(value.as_py(), words) for value in texts]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return udf(text)


class Tree:
    """A Burkhard-Keller tree of unsigned numbers."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children = radius, [], []

    def add(self, value: int) -> list[int]:
        """The values within the radius that were there before; the new value joins the tree."""
        values, children, radius = self.values, self.children, self.radius
        if not values:
            values.append(value)
            children.append({})
            return []
        found, todo = [], [0]
        while todo:
            node = todo.pop()
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(values[node])
            below = children[node]
            for edge in range(distance - radius, distance + radius + 1):
                if edge in below:
                    todo.append(below[edge])
        node = 0
        while True:
            distance = (values[node] ^ value).bit_count()
            if distance not in children[node]:
                children[node][distance] = len(values)
                values.append(value)
                children.append({})
                return found
            node = children[node][distance]


def forest(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join whatever the radius joins within a shard, one fewer than members at most."""
    tree, parent, out = Tree(radius), {m: m for m in members}, []

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value in members:
        for other in tree.add(value):
            a, b = top(value), top(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((value, other))
    return out


def _links(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members = None, []

        def closed():
            if len(members) > 1:
                pairs = forest([m & (2**64 - 1) for m in members], radius)
                if pairs:
                    yield pa.RecordBatch.from_arrays(
                        list(map(pa.array, np.array(pairs, np.uint64).view(np.int64).T.copy())), schema=schema
                    )

        for batch in batches:
            if not batch.num_rows:
                continue
            kind, key, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(kind)]])
            # Only the first and the last shard of a batch can go on in another one; lone members link to none.
            inner = (ends - starts > 1) | (starts == 0) | (ends == len(kind))
            for start, end in zip(starts[inner], ends[inner], strict=True):
                name = (kind[start], key[start])
                if name != shard:
                    yield from closed()
                    shard, members = name, []
                members.extend(value[start:end].tolist())
        yield from closed()

    return run


def _parts(column: str, width: int, low: int, count: int) -> list[Column]:
    return [F.shiftrightunsigned(F.col(column), low + width * i).bitwiseAND((1 << width) - 1) for i in range(count)]


def shards(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(kind, key, fp): every fingerprint in the shards that hold all that is within two bits of it."""
    spark = prints.sparkSession
    parts, choices = _parts("fp", 16, 0, 4), list(combinations(range(4), 2))
    first = prints.select(
        F.inline(
            F.array(*[F.struct(F.lit(k).alias("kind"), (parts[i] * 65536 + parts[j]).alias("key"), F.col("fp").alias("fp")) for k, (i, j) in enumerate(choices)])
        )
    )
    heavy = stored(first.groupBy("kind", "key").count().where(F.col("count") > crowded).select("kind", "key"), "crowded")
    if heavy.isEmpty():
        discard(spark, heavy)
        return first
    marked = first.join(heavy.withColumn("full", F.lit(True)), ["kind", "key"], "left")
    # The other two parts, as four bytes, of which two agree again.
    rest = F.lit(None).cast("array<bigint>")
    for k, (i, j) in enumerate(choices):
        others = [n for n in range(4) if n not in (i, j)]
        octets = [c for n in others for c in _parts("fp", 8, 16 * n, 2)]
        keys = [F.lit((n + 1) << 48) + F.col("key") * 65536 + octets[a] * 256 + octets[b] for n, (a, b) in enumerate(choices)]
        rest = F.when(F.col("kind") == k, F.array(*keys)).otherwise(rest)
    return marked.select("kind", F.explode(F.when(F.col("full"), rest).otherwise(F.array("key"))).alias("key"), "fp")


def links(prints: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """(a, b): pairs of distinct fingerprints that link all that lie within the radius, directly or by others."""
    if radius > 2:
        raise ValueError("two of four parts are sure to agree up to two bits only")
    count = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shards(prints, crowded).repartition(count, "kind", "key").sortWithinPartitions("kind", "key", "fp")
    return dealt.mapInArrow(_links(radius), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node that has a link, with the smallest node it can reach."""
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct(), "edges")
    was = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "root"))).first())
        if mark == was or mark[0] == 0:
            return now
        was = mark
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = stored(both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("low")), "large")
        large = stored(
            both.join(low, "node").where("root > node").select(F.col("root").alias("node"), F.col("low").alias("root")).distinct(),
            "large-star",
        )
        least = stored(large.groupBy("node").agg(F.min("root").alias("low")), "small")
        step = large.join(least, "node")
        small = stored(
            step.where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root")).unionByName(least.select("node", F.col("low").alias("root"))).distinct(),
            "small-star",
        )
        discard(spark, now, low, large, least)
        now = small


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    crowded: int = CROWDED,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, kept and mark for every document."""
    spark = docs.sparkSession
    text = F.col(text_col)
    marked = stored(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"), text_mark(text).alias("mark"), fingerprint_column(text, words).alias("fp")
        ),
        "prints",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark"))
    prints = stored(marked.groupBy("fp").agg(first.alias("first")), "distinct-prints")
    edges = stored(links(prints.select("fp"), radius, crowded), "links")
    joined = components(edges)
    rooted = stored(
        prints.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"),
        "roots",
    )
    firsts = stored(rooted.groupBy("root").agg(F.min("first").alias("first")), "firsts")
    named = stored(rooted.drop("first").join(firsts, "root").select("fp", "first"), "components")
    discard(spark, edges, joined, prints, rooted, firsts)
    # Both sides are read from files, so that a fingerprint shared by many rows is split at run time.
    return marked.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))).alias("kept"),
        "mark",
    )


def keep_first_of_components(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id; the columns stay as they are."""
    return keep_rows(docs, near_duplicates(docs).where("kept").select("doc_id", "mark").distinct())
