"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The upper tree is fitted on at most ``SAMPLE`` unit vectors, drawn by a hash; every vector is then put into the leaf that
it reaches by going to the nearest child. A leaf that is still crowded is split again by a tree of its own, fitted in one task
on about ``NODE_SAMPLE`` of its vectors, level by level, so leaves grow in number with the table and not in size. A query
walks the tree with a priority queue: it takes the branch whose centre is nearest, leaves the other branches in the
queue, and opens leaves until it has seen enough of them; on a lower level each opened leaf goes on with its own queue from
the priority it had, and the first of all the query's leaves are kept. How many are enough is calibrated level by level:
for ``TRIALS`` drawn vectors the true neighbours among all rows are computed, and the number of leaves is widened until
they hold the wanted share of them.

Of equal vectors only the smallest ids can be among the nearest, one more than asked for: the others are
left out of the leaves, and equal query vectors are searched once. A query meets the rows of the leaves it opens and no
others; leaves that follow each other do so in one task. Leaves that cannot be split are cut by a hash of the id, and so are
the queries that open much the same, so no task holds a crowded one. Only the upper tree, bounded by ``SAMPLE``, is sent to all tasks; lower trees are rows of a table that
are joined to the vectors and queries in their leaf.

Cases: vectors that are null, empty or zero, or hold null or non-finite numbers, take no part, nor do those of
another length than most; ties go to the smaller id; null ids take no part; of rows with one id that with the
smallest bytes counts; with fewer candidates than asked for all are returned; an empty table gives an empty result; other
columns are not read. Components are compared in double precision.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saldo.sources.scratch import discard, stored

SAMPLE = 20_000
BRANCHES = 8
#: Sampled vectors below which a node is a leaf, at the least.
LEAF_SAMPLE = 64
#: Vectors of the whole table in a leaf, where the sample allows.
LEAF_ROWS = 400
TRIALS = 200
RECALL = 0.97
#: A leaf of more than this many times its wanted rows is split again.
CROWDED = 4
#: Vectors of a crowded leaf that its own tree is fitted on, about, and rows that one task puts into its leaves.
NODE_SAMPLE, PLACE_ROWS = 4_096, 50_000
#: Levels below the upper tree; each multiplies the leaves by up to a hundred.
LOWER_LEVELS = 3
#: Vectors and queries that meet in one task, about.
CELL_ROWS, CELL_QUERIES = 4_000, 2_000
#: A node is its level and the leaf numbers on its way, in bits of these widths.
_LEVEL_BITS, _LEAF_BITS = 58, 13


@dataclass
class Tree:
    """Centres of nodes; children of inner nodes follow each other, leaves have numbers."""

    centres: np.ndarray
    first: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    def leaves(self) -> int:
        return max(self.leaf, default=-1) + 1

    def assign(self, units: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        node = np.zeros(len(units), np.int64)
        out = np.full(len(units), -1, np.int64)
        todo = [0]
        rows = {0: np.arange(len(units))}
        while todo:
            at = todo.pop()
            held = rows.pop(at)
            if not self.count[at]:
                out[held] = self.leaf[at]
                continue
            start, stop = self.first[at], self.first[at] + self.count[at]
            near = start + (units[held] @ self.centres[start:stop].T - 0.5 * (self.centres[start:stop] ** 2).sum(1)).argmax(1)
            node[held] = near
            for child in range(start, stop):
                if len(part := held[near == child]):
                    rows[child] = part
                    todo.append(child)
        return out

    def best_first(self, unit: np.ndarray, leaves: int | None = None, start: float = 0.0) -> list[tuple[int, float]]:
        """(leaf, priority) in the order in which a query opens them; a priority is never below an earlier one."""
        gap = ((self.centres - unit) ** 2).sum(1)
        queue, out, most = [(start, 0)], [], start
        while queue and (leaves is None or len(out) < leaves):
            priority, at = heapq.heappop(queue)
            most = max(most, priority)
            while self.count[at]:
                children = range(self.first[at], self.first[at] + self.count[at])
                nearest = min(children, key=lambda c: gap[c])
                for child in children:
                    if child != nearest:
                        heapq.heappush(queue, (float(gap[child]), child))
                at = nearest
            out.append((self.leaf[at], most))
        return out


def fit_tree(units: np.ndarray, leaf_sample: int, branches: int = BRANCHES, seed: int = 5) -> Tree:
    """Split by k-means until a node holds few sampled vectors or all of them are alike."""
    rng = np.random.default_rng(seed)
    width = units.shape[1] if units.ndim == 2 and len(units) else 0
    centres = [units.mean(0) if len(units) else np.zeros(width)]
    tree = Tree(np.zeros((0, width)), [0], [0], [-1])
    todo, leaf = [(0, units)], 0
    while todo:
        at, held = todo.pop(0)
        kinds = np.unique(held, axis=0) if len(held) > leaf_sample else held[:1]
        if len(kinds) < 2:
            tree.leaf[at] = leaf
            leaf += 1
            continue
        k = min(branches, len(kinds))
        means = kinds[rng.choice(len(kinds), k, replace=False)]
        for _ in range(10):
            near = (held @ means.T - 0.5 * (means**2).sum(1)).argmax(1)
            means = np.array([held[near == j].mean(0) if (near == j).any() else means[j] for j in range(k)])
        near = (held @ means.T - 0.5 * (means**2).sum(1)).argmax(1)
        used = [j for j in range(k) if (near == j).any()]
        if len(used) < 2:
            tree.leaf[at] = leaf
            leaf += 1
            continue
        tree.first[at], tree.count[at] = len(centres), len(used)
        for j in used:
            todo.append((len(centres), held[near == j]))
            centres.append(means[j])
            tree.first.append(0)
            tree.count.append(0)
            tree.leaf.append(-1)
    tree.centres = np.array(centres)
    return tree


def _matrix(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1) if raw else np.zeros((0, 0))


def _units(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that neither tiny nor huge components leave the range of doubles.
    scaled = vectors / np.abs(vectors).max(1, keepdims=True) if len(vectors) else vectors
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True)) if len(vectors) else vectors


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, by the same steps for every pair, so that equal vectors tie."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query row, candidate row, cosine) of each query's nearest, all ties at the end of the list included."""
    if not len(queries) or not len(vectors):
        return
    near = _units(queries) @ _units(vectors).T
    keep = min(k, len(vectors))
    edge = np.partition(near, len(vectors) - keep, axis=1)[:, len(vectors) - keep]
    row, at = np.nonzero(near >= edge[:, None] - 1e-9)
    score = cosines(queries[row], vectors[at])
    order = np.lexsort((ids[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    for r, a, s in zip(row[rank < k].tolist(), at[rank < k].tolist(), score[rank < k].tolist(), strict=True):
        yield r, a, s


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec): the vectors that take part, as doubles in bytes."""
    size = F.size(vector_col)
    kept = rows.where(F.col(id_col).isNotNull() & (size > 0)).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    widths = kept.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = widths["width"] if widths else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, raw = [], []
            flat = batch.column(1).flatten()
            if flat.null_count:
                pairs = [(n, v) for n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if None not in v]
                ids, block = [n for n, _ in pairs], np.array([v for _, v in pairs], float).reshape(len(pairs), width)
            else:
                ids, block = batch.column(0).to_pylist(), flat.to_numpy().reshape(batch.num_rows, width)
            good = np.isfinite(block).all(1) & (block != 0).any(1)
            names = [n for n, g in zip(ids, good.tolist(), strict=True) if g]
            # Both zeros are one number, so that equal vectors have equal bytes.
            raw = [v.tobytes() for v in (block[good] + 0.0).astype("<f8")]
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "vec"])

    return kept.where(F.size("v") == width).mapInArrow(run, "vec_id bigint, vec binary")


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall: float = RECALL,
    sample: int = SAMPLE,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each id of queries (query_id) its nearest rows but itself."""
    spark: SparkSession = rows.sparkSession
    usable = usable_vectors(rows, id_col, vector_col)
    vectors = stored(usable.groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors")
    total = vectors.count()
    edge = min(1 << 30, (sample << 30) // max(1, total))
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < edge).orderBy("vec_id").toArrow()
    units = _units(_matrix(drawn.column("vec")))
    tree = fit_tree(units, _leaf_sample(len(units), total, leaf_rows))
    sent = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = sent.value.assign(_units(_matrix(batch.column(1))))
                yield pa.record_batch([pa.array(leaf), batch.column(0), batch.column(1)], names=["node", "vec_id", "vec"])

    alike = Window.partitionBy("vec").orderBy("vec_id")
    several = vectors.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1).select("vec_id", "vec")
    placed, lower = _split(stored(several.mapInArrow(place, _PLACED), "placed"), leaf_rows)
    visits = _calibrated(placed, drawn, sent, lower, k, recall)

    asked = stored(queries.select("query_id").distinct().join(vectors.withColumnRenamed("vec_id", "query_id"), "query_id"), "queries")
    heads = stored(asked.groupBy("vec").agg(F.min("query_id").alias("head")), "query-heads")
    opened = _open(heads.select("head", "vec"), sent, visits[0])
    opened = stored(opened, "opened") if lower else opened
    for trees, most in zip(lower, visits[1:], strict=True):
        opened = _first(_descend(opened, trees, most), most)
    # Leaves that follow each other meet their queries in one task, so that a query sends one list of hits for them.
    sizes = placed.groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    leaves = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).first()
    cell = F.expr(f"node div {max(1, CELL_ROWS * leaves['n'] // max(1, leaves['rows'] or 0))}").alias("cell")
    walks = stored(opened.select(cell, "head", "node").groupBy("cell", "head").agg(F.collect_list("node").alias("nodes")).join(heads, "head"), "walks")
    # A leaf that could not be split is cut into several, and so are the queries of a cell that many open.
    cuts = sizes.groupBy(cell).agg(F.ceil(F.sum("rows") / CELL_ROWS).alias("cuts"))
    parts = stored(walks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).alias("parts")).join(cuts, "cell"), "cells")
    left = placed.withColumn("cell", cell).join(parts, "cell").select(
        "cell", F.pmod(F.xxhash64("vec_id"), "cuts").alias("cut"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), "node", "vec_id", "vec"
    )
    right = walks.join(parts, "cell").select(
        "cell", F.explode(F.expr("sequence(0L, cuts - 1)")).alias("cut"), F.pmod(F.xxhash64("head"), "parts").alias("part"), "head", "vec", "nodes"
    )
    keys = ("cell", "cut", "part")
    hit_type = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))

    def meet(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        """The nearest of each query among the rows of the leaves it opened."""
        node, ids, vectors = held.column("node").to_numpy(), held.column("vec_id").to_numpy(), _matrix(held.column("vec"))
        heads, queries = asked.column("head").to_pylist(), _matrix(asked.column("vec"))
        openers: dict[int, list[int]] = {}
        for query, nodes in enumerate(asked.column("nodes").to_pylist()):
            for opened in nodes:
                openers.setdefault(opened, []).append(query)
        hits: list[list[tuple[float, int]]] = [[] for _ in heads]
        for leaf in np.unique(node).tolist():
            rows, some = np.flatnonzero(node == leaf), openers.get(leaf, [])
            if some:
                for r, a, s in _best(queries[some], ids[rows], vectors[rows], k + 1):
                    hits[some[r]].append((-s, int(ids[rows[a]])))
        found = [(head, [{"vec_id": n, "score": -far} for far, n in sorted(mine)[: k + 1]]) for head, mine in zip(heads, hits, strict=True) if mine]
        return pa.table([pa.array([h for h, _ in found], pa.int64()), pa.array([f for _, f in found], hit_type)], names=["head", "hits"])

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "head bigint, hits array<struct<vec_id: bigint, score: double>>")
    every = F.transform(F.flatten(F.collect_list("hits")), lambda h: F.struct((-h["score"]).alias("far"), h["vec_id"].alias("vec_id"), h["score"].alias("score")))
    hits = stored(met.groupBy("head").agg(F.slice(F.array_sort(every), 1, k + 1).alias("hits")), "hits")
    discard(spark, vectors, placed, walks, parts, *lower)
    # Both sides come from files, so that a vector which many queries share is split at run time.
    named = asked.join(heads, "vec").select("query_id", "head").join(hits, "head")
    mine = F.filter("hits", lambda h: h["vec_id"] != F.col("query_id"))
    ranked = F.slice(F.array_sort(F.transform(mine, lambda h: F.struct((-h["score"]).alias("far"), h["vec_id"].alias("vec_id"), h["score"].alias("score")))), 1, k)
    out = named.select("query_id", F.posexplode(ranked).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


_PLACED = "node bigint, vec_id bigint, vec binary"
_OPENED = "head bigint, vec binary, node bigint, priority double, place int"


def _leaf_sample(drawn: int, rows: int, leaf_rows: int) -> int:
    """Sampled vectors below which a node is a leaf, so that a leaf holds about leaf_rows of all rows."""
    return max(LEAF_SAMPLE if drawn > 4 * LEAF_SAMPLE else 8, leaf_rows * drawn // max(1, rows))


def _level(node) -> Column:
    return F.shiftright(node, _LEVEL_BITS)


def _ancestor(node: int, level: int) -> int:
    """The node on the way to another at a level, or the node itself if it lies above."""
    own, path = node >> _LEVEL_BITS, node & (1 << _LEVEL_BITS) - 1
    return node if own <= level else level << _LEVEL_BITS | path >> _LEAF_BITS * (own - level)


def _below(node: int, leaf: np.ndarray) -> np.ndarray:
    """The nodes of the leaves of a node's own tree."""
    level, path = node >> _LEVEL_BITS, node & (1 << _LEVEL_BITS) - 1
    return ((level + 1) << _LEVEL_BITS | path << _LEAF_BITS) + np.asarray(leaf, np.int64)


def _split(placed: DataFrame, leaf_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """The vectors in leaves that are not crowded, and the trees (node, tree, parts) of each lower level."""
    spark, lower = placed.sparkSession, []

    def fit(key: tuple, held: pa.Table) -> pa.Table:
        held = held.sort_by("vec_id").slice(0, 1 << _LEAF_BITS)
        units = _units(_matrix(held.column("vec")))
        tree = fit_tree(units, _leaf_sample(len(units), held.column("rows")[0].as_py(), leaf_rows))
        parts = -(-held.column("rows")[0].as_py() // PLACE_ROWS)
        found = [(key[0].as_py(), pickle.dumps(tree), parts)] if tree.leaves() > 1 else []
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ([], [], []), (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["node", "tree", "parts"])

    def place(key: tuple, held: pa.Table, trees: pa.Table) -> pa.Table:
        if not trees.num_rows or not held.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["node", "vec_id", "vec"])
        leaf = pickle.loads(trees.column("tree")[0].as_py()).assign(_units(_matrix(held.column("vec"))))
        return pa.table([pa.array(_below(key[0].as_py(), leaf)), held.column("vec_id"), held.column("vec")], names=["node", "vec_id", "vec"])

    for level in range(1, LOWER_LEVELS + 1):
        # A node of an earlier level that no tree could split is not tried again.
        sizes = placed.where(_level("node") == level - 1).groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
        crowded = stored(sizes.where(F.col("rows") > CROWDED * leaf_rows), "crowded-nodes")
        if crowded.isEmpty():
            discard(spark, crowded)
            break
        share = F.pmod(F.xxhash64(F.lit(level), "vec_id"), F.lit(1 << 30)) * F.col("rows").cast("double") < float(NODE_SAMPLE << 30)
        drawn = placed.join(crowded, "node").where(share).groupBy("node")
        trees = stored(drawn.applyInArrow(fit, "node bigint, tree binary, parts bigint"), "node-trees")
        dealt = placed.join(trees.select("node", "parts"), "node").select("node", F.pmod(F.xxhash64("vec_id"), "parts").alias("part"), "vec_id", "vec")
        copies = trees.select("node", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), "tree")
        moved = dealt.groupBy("node", "part").cogroup(copies.groupBy("node", "part")).applyInArrow(place, _PLACED)
        further = stored(placed.join(trees.select("node"), "node", "left_anti").select("node", "vec_id", "vec").unionByName(moved), "placed")
        discard(spark, placed, crowded)
        placed = further
        lower.append(trees)
    return placed, lower


def _open(heads: DataFrame, sent, visits: int | None) -> DataFrame:
    """The first leaves (all for None) of the upper tree for each query: head, vec, node, priority, place."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head, raw, unit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _units(_matrix(batch.column(1))), strict=True):
                yield pa.RecordBatch.from_pydict(_leaves([head], [raw], [unit], [0.0], sent.value, visits, lambda leaf: leaf))

    return heads.mapInArrow(walk, _OPENED)


def _leaves(heads: list, raws: list, units, starts: list[float], tree: Tree, visits: int | None, named) -> dict[str, pa.Array]:
    """Columns of _OPENED: for each query the leaves of a tree in the order it opens them."""
    rows = [(h, r, n, p, at) for h, r, u, s in zip(heads, raws, units, starts, strict=True) for at, (n, p) in enumerate(tree.best_first(u, visits, s))]
    head, raw, leaf, priority, place = zip(*rows, strict=True) if rows else ([],) * 5
    return {
        "head": pa.array(head, pa.int64()),
        "vec": pa.array(raw, pa.binary()),
        "node": pa.array(named(np.array(leaf, np.int64)), pa.int64()),
        "priority": pa.array(priority, pa.float64()),
        "place": pa.array(place, pa.int32()),
    }


def _descend(opened: DataFrame, trees: DataFrame, visits: int | None) -> DataFrame:
    """Nodes with a tree of their own give way to its leaves; each tree's queue starts at the node's priority."""
    parts = stored(opened.join(trees.select("node"), "node").groupBy("node").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).alias("parts")), "opened-nodes")
    left = opened.join(parts, "node").select("node", F.pmod(F.xxhash64("head"), "parts").alias("part"), "head", "vec", "priority")
    again = parts.select("node", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    right = trees.select("node", "tree").join(again, "node").select("node", "part", "tree")

    def walk(key: tuple, held: pa.Table, trees: pa.Table) -> pa.Table:
        tree = pickle.loads(trees.column("tree")[0].as_py())
        raw = held.column("vec").to_pylist()
        units = _units(_matrix(held.column("vec")))
        return pa.table(_leaves(held.column("head").to_pylist(), raw, units, held.column("priority").to_pylist(), tree, visits, lambda leaf: _below(key[0].as_py(), leaf)))

    final = opened.join(trees.select("node"), "node", "left_anti").select("head", "vec", "node", "priority", "place")
    return final.unionByName(left.groupBy("node", "part").cogroup(right.groupBy("node", "part")).applyInArrow(walk, _OPENED))


def _first(opened: DataFrame, visits: int | None) -> DataFrame:
    """The first leaves of each query over all the trees it walked, numbered anew."""
    order = Window.partitionBy("head").orderBy("priority", "place", "node")
    ranked = opened.withColumn("place", F.row_number().over(order) - 1)
    return stored(ranked if visits is None else ranked.where(F.col("place") < visits), "opened")


def _calibrated(placed: DataFrame, drawn: pa.Table, sent, lower: list[DataFrame], k: int, recall: float) -> list[int]:
    """For each level the leaves that hold the wanted share of the true neighbours of the first drawn vectors."""
    spark = placed.sparkSession
    trials = drawn.slice(0, TRIALS)
    ids, asked = trials.column("vec_id").to_numpy(), _matrix(trials.column("vec"))
    if not len(ids):
        return [1] * (1 + len(lower))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, names = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                found = list(_best(asked, names, _matrix(batch.column(2)), k + 1))
                rows, at = [r for r, _, _ in found], [a for _, a, _ in found]
                yield pa.record_batch(
                    [pa.array(rows, pa.int64()), pa.array(node[at], pa.int64()), pa.array(names[at], pa.int64()), pa.array([s for _, _, s in found], pa.float64())],
                    names=["trial", "node", "vec_id", "score"],
                )

    found = placed.mapInArrow(search, "trial bigint, node bigint, vec_id bigint, score double")
    window = Window.partitionBy("trial").orderBy(F.desc("score"), "vec_id")
    truth = found.withColumn("n", F.row_number().over(window)).where(F.col("n") <= k + 1).select("trial", "node", "vec_id").collect()
    truth = [(int(ids[r["trial"]]), r["node"]) for r in truth if r["vec_id"] != ids[r["trial"]]]
    heads = spark.createDataFrame(trials.rename_columns(["head", "vec"]))
    share, visits, opened = recall ** (1 / (1 + len(lower))), [], None
    for level in range(1 + len(lower)):
        wanted = Counter((head, _ancestor(node, level)) for head, node in truth)
        everything = stored(_open(heads, sent, None), "opened") if opened is None else _first(_descend(opened, lower[level - 1], None), None)
        pairs = spark.createDataFrame(list(wanted), "head bigint, node bigint") if wanted else None
        places = [] if pairs is None else sorted(r["place"] for r in everything.join(pairs, ["head", "node"]).select("head", "node", "place").collect() for _ in range(wanted[r["head"], r["node"]]))
        visits.append(places[min(len(places), int(np.ceil(share * len(places)))) - 1] + 1 if places else 1)
        opened = everything.where(F.col("place") < visits[-1])
    return visits
