"""Operator 3: nearest neighbours by stable projections, kd-trees and a chi-square stop.

Vectors are projected on ``M`` Gaussian directions (2-stable): the squared
projected distance of two vectors at distance d is d^2 times a chi-square variable
of M degrees.  So once the next neighbour in projected space lies at s with
``chi2_M(s^2 / d_k^2) >= CONFIDENCE``, d_k being the k-th best distance verified, a
nearer vector would have shown up before with that probability, and the search
stops.

1. A kd-tree over a sample of at most ``SAMPLE`` projected vectors cuts the space
   into cells of about ``CELL`` vectors (its only use of the sample; every vector
   is indexed).  Cells that turn out larger are cut into blocks by hash.
2. Each block has its own kd-tree.  A query takes its leaves in the order of their
   projected distance and verifies what the stop allows on the original vectors.
3. Round one searches a query's own cell and finds a first d_k.  Round two sends it
   down the tree, ``FAN`` bits at a time by joins on the node, to the blocks whose
   bounding boxes the stop doesn't rule out at that d_k.
   Queries meet blocks in chunks of ``CHUNK`` queries.
4. The best k of both rounds are ranked.

Of equal vectors only the k+1 smallest ids are indexed, as no others can be in any
result; so copies don't multiply work.

Defined results: vectors that are null, zero, or hold a null or non-finite
component, vectors of another length than most (of tied lengths the smallest), and
null ids take no part; a repeated id counts once per distinct vector, and rows
with the query's id are its own; fewer candidates than k are all returned, since
cells too small to give k neighbours leave d_k open and every block is searched; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, materialize

M, CONFIDENCE, SAMPLE, CELL, LEAF, CHUNK, SEED, FAN = 8, 0.99, 20_000, 4096, 128, 1024, 11, 6


def chi2_quantile(p: float, m: int) -> float:
    """The p-quantile of the chi-square distribution with an even number of degrees."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - exp(-x / 2) * total < p else (low, x)
    return low


LIMIT = chi2_quantile(CONFIDENCE, M)


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, M))


def cut_space(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """A complete kd-tree as a heap of (axis, threshold): medians along the widest axis."""
    nodes: list[tuple[int, float]] = []
    todo = [points]
    while len(nodes) < cells - 1:
        part = todo.pop(0)
        axis = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
        at = float(np.median(part[:, axis])) if len(part) else 0.0
        nodes.append((axis, at))
        todo += [part[part[:, axis] <= at], part[part[:, axis] > at]]
    return nodes


def cell_of(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    axes, cuts = np.array([n[0] for n in nodes], np.int64), np.array([n[1] for n in nodes])
    for _ in range((len(nodes) + 1).bit_length() - 1):
        at = 2 * at + 1 + (points[np.arange(len(points)), axes[at]] > cuts[at])
    return at - len(nodes)


class Block:
    """A kd-tree over the projections of one block, as leaves with their boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, sight: np.ndarray) -> None:
        points = vectors @ sight
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(ids))]
        while todo:
            part = todo.pop()
            if len(part) > LEAF:
                axis = np.ptp(points[part], axis=0).argmax()
                order = part[np.argpartition(points[part, axis], len(part) // 2)]
                todo += [order[: len(part) // 2], order[len(part) // 2 :]]
            elif len(part):
                self.leaves.append(part)
        self.ids, self.vectors, self.points = ids, vectors, points
        self.low = np.array([points[x].min(0) for x in self.leaves])
        self.high = np.array([points[x].max(0) for x in self.leaves])

    def search(self, own: int, vector: np.ndarray, point: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k (ids, distances) but for the id ``own``; ``bound``: a known d_k."""
        away = np.maximum(self.low - point, 0) + np.maximum(point - self.high, 0)
        near = (away**2).sum(1)
        ids, dist = np.empty(0, np.int64), np.empty(0)
        for leaf in np.argsort(near):
            if near[leaf] > LIMIT * bound * bound:
                break
            part = self.leaves[leaf]
            s = ((self.points[part] - point) ** 2).sum(1)
            part = part[(s <= LIMIT * bound * bound) & (self.ids[part] != own)]
            d = np.sqrt(((self.vectors[part] - vector) ** 2).sum(1))
            ids, dist = np.concatenate([ids, self.ids[part]]), np.concatenate([dist, d])
            order = np.lexsort((ids, dist))[:k]
            ids, dist = ids[order], dist[order]
            if len(dist) == k:
                bound = min(bound, float(dist[-1]))
        return ids, dist


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _assign(nodes, sight):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = cell_of(_matrix(batch.column("vector")) @ sight, nodes) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cells, pa.int64())], names=["id", "vector", "cell"])

    return run


def _boxes(sight):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                p = _matrix(batch.column("vectors")[r].values) @ sight
                yield pa.RecordBatch.from_arrays([batch.column("cell").slice(r, 1), batch.column("part").slice(r, 1), pa.array([p.min(0)], pa.list_(pa.float64())), pa.array([p.max(0)], pa.list_(pa.float64()))], names=["cell", "part", "low", "high"])

    return run


def _search(sight, k: int):
    """Rows (cell, part, ids, vectors, queries) to (query, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block = Block(batch.column("ids")[r].values.to_numpy(), _matrix(batch.column("vectors")[r].values), sight)
                q = batch.column("queries")[r].values
                vectors = _matrix(q.field("vector"))
                points = vectors @ sight
                out = [(x, *block.search(x, v, p, b, k)) for x, v, p, b in zip(q.field("query").to_pylist(), vectors, points, q.field("bound").to_pylist(), strict=True)]
                size = [len(i) for _, i, _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x for x, _, _ in out], size)), pa.array(np.concatenate([i for _, i, _ in out])), pa.array(np.concatenate([d for _, _, d in out]))], names=["query", "id", "score"])

    return run


def _usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def nearest(table: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest of the rows that ``query`` selects."""
    spark = table.sparkSession
    rows = table.filter(F.col(id_col).isNotNull() & _usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), query.alias("asks"))
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths[0]["dim"]
    rows = rows.filter(F.size("vector") == dim)
    sight = directions(dim)

    # Of equal vectors the k+1 smallest ids, a salt at a time and then together.
    one = Window.partitionBy("vector", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    two = Window.partitionBy("vector").orderBy("id")
    index = rows.select("id", "vector").distinct()
    for w in (one, two):
        index = index.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k + 1).drop("nth")
    index = materialize(index, "op3-index")
    n = index.count()
    cells = 1 << max(0, (n // CELL).bit_length())
    sample = index.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    nodes = cut_space(_matrix(sample.column("vector").combine_chunks()) @ sight, cells)
    placed = index.mapInArrow(_assign(nodes, sight), f"id long, vector {index.schema['vector'].dataType.simpleString()}, cell long")
    placed = materialize(placed, "op3-placed")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL).alias("parts"))
    blocks = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).groupBy("cell", "part").agg(F.collect_list("id").alias("ids"), F.collect_list("vector").alias("vectors"))
    blocks = materialize(blocks, "op3-blocks")
    boxes = materialize(blocks.mapInArrow(_boxes(sight), "cell long, part long, low array<double>, high array<double>"), "op3-boxes")

    asked = rows.filter("asks").select("id", "vector").distinct().mapInArrow(_assign(nodes, sight), f"id long, vector {rows.schema['vector'].dataType.simpleString()}, cell long")
    asked = materialize(asked.withColumnRenamed("id", "query"), "op3-queries")
    chunks = max(1, -(-asked.count() // CHUNK))
    chunk = F.pmod(F.xxhash64("query"), F.lit(chunks))

    def search(sent: DataFrame) -> DataFrame:
        """Search (cell, part, query, vector, bound)."""
        groups = sent.groupBy("cell", "part", chunk.alias("chunk")).agg(F.collect_list(F.struct("query", "vector", "bound")).alias("queries"))
        met = groups.join(blocks, ["cell", "part"]).select("ids", "vectors", "queries").repartition(4 * spark.sparkContext.defaultParallelism)
        return met.mapInArrow(_search(sight, k), "query long, id long, score double")

    first = materialize(search(asked.join(boxes, "cell").select("cell", "part", "query", "vector", F.lit(float("inf")).alias("bound"))), "op3-first")
    at = Window.partitionBy("query").orderBy("score", "id")
    kth = first.withColumn("rank", F.row_number().over(at)).filter(F.col("rank") == k).select("query", F.col("score").alias("bound"))
    open_ = asked.join(kth, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).withColumnRenamed("cell", "own")
    flat = [float(x) for x in sight.T.ravel()]
    # A query's projection, by expression, as the boxes' distances decide where it goes.
    point = F.transform(F.sequence(F.lit(0), F.lit(M - 1)), lambda j: F.aggregate(F.zip_with("vector", F.slice(F.array(*map(F.lit, flat)), j * dim + 1, F.lit(dim)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x))
    open_ = materialize(open_.withColumns({"point": point, "ask": F.xxhash64("query", "vector")}), "op3-open")
    gap = F.zip_with(F.zip_with("point", "low", lambda p, a: F.greatest(a - p, F.lit(0.0))), F.zip_with("point", "high", lambda p, b: F.greatest(p - b, F.lit(0.0))), lambda a, b: (a + b) * (a + b))
    reach = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) <= F.lit(LIMIT) * F.col("bound") * F.col("bound") * F.lit(1 + 1e-9)

    def boxes_of(level: int) -> DataFrame:
        """The boxes around the nodes that many levels of ``FAN`` bits above the cells."""
        corner = lambda fold, c: F.array(*(fold(F.get(c, F.lit(i))) for i in range(M)))
        return boxes.groupBy(F.shiftright("cell", FAN * level).alias("node")).agg(corner(F.min, "low").alias("low"), corner(F.max, "high").alias("high"))

    # Down the tree, as joins on the node: a query goes on to the children whose boxes the stop doesn't rule out.
    top = max(0, -(-(cells.bit_length() - 1) // FAN) - 1)
    at_node = open_.select("ask", "own", "point", "bound", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((cells - 1) >> FAN * top).cast("long"))).alias("node"))
    for level in range(top, 0, -1):
        at_node = at_node.join(boxes_of(level), "node").filter(reach).select("ask", "own", "point", "bound", "node")
        at_node = at_node.select("ask", "own", "point", "bound", F.explode(F.sequence(F.shiftleft("node", FAN), F.shiftleft("node", FAN) + ((1 << FAN) - 1))).alias("node"))
    met = at_node.filter(F.col("own") != F.col("node")).join(boxes.withColumnRenamed("cell", "node"), "node").filter(reach).select("ask", F.col("node").alias("cell"), "part")
    sent = met.join(open_.select("ask", "query", "vector", "bound"), "ask").select("cell", "part", "query", "vector", "bound")
    best = first.union(search(sent)).withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= k)
    return best.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op3_nearest": op3_nearest}
SQL: dict[str, str] = {}
