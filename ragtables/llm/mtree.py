"""Exact search of the highest inner products: an M-tree of paged metric nodes, searched best first.

The metric is the Euclidean distance. A page keeps its routing vector, its covering radius, and for every entry the
distance to the routing vector (the parent distance) and the square of its norm. For a query q, an entry x and a known
d(q, parent), the triangle inequality gives d(q, x) >= |d(q, parent) - d(parent, x)|, and 2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2
turns that into an upper bound of the score. So entries are dropped by stored numbers, before their product is computed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragtables.session import materialize

PAGE, FANOUT, SUBTREE, QUERIES_PER_BLOCK = 2_048, 16, 16_384, 50_000
MOST_ROUTES = 2_048
SCALE = 64


@dataclass
class Node:
    """A page: inner node with ``children``, or leaf with its entries side by side, ids ascending."""

    center: np.ndarray
    radius: float
    to_parent: float
    largest: float
    children: list | None = None
    vectors: np.ndarray | None = None
    ids: np.ndarray | None = None
    norms: np.ndarray | None = None
    to_center: np.ndarray | None = None


def _distances(vectors: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - center) ** 2).sum(axis=1))


def build(vectors: np.ndarray, ids: np.ndarray, k: int, parent: np.ndarray | None = None) -> Node:
    """Tree over vectors with ascending ids: routing vectors are spread by farthest-first choice, each vector goes to the
    nearest one. A page of equal vectors keeps the k + 1 first ids: all score the same, and a query leaves out itself only.
    """
    center = vectors[len(vectors) // 2]
    to_center = _distances(vectors, center)
    norms = (vectors**2).sum(axis=1)
    node = Node(center, float(to_center.max()), 0.0 if parent is None else float(_distances(center[None], parent)[0]), float(norms.max()))
    if len(vectors) <= PAGE or node.radius == 0.0:
        own = slice(k + 1) if node.radius == 0.0 else slice(None)
        # Single precision is exact while every product of two vectors stays below 2^24.
        kind = np.float32 if node.largest < 1 << 24 else np.float64
        node.vectors, node.ids, node.norms, node.to_center = vectors[own].astype(kind), ids[own], norms[own], to_center[own]
        return node
    nearest, owner = to_center, np.zeros(len(vectors), np.int64)
    for number in range(1, FANOUT):
        far = int(nearest.argmax())
        if nearest[far] == 0.0:
            break
        distance = _distances(vectors, vectors[far])
        owner[distance < nearest] = number
        nearest = np.minimum(nearest, distance)
    node.children = [build(vectors[owner == j], ids[owner == j], k, center) for j in np.unique(owner)]
    return node


def _bound(query_norm: float, largest, gap) -> np.ndarray:
    """Upper bound of inner products with vectors of squared norms up to ``largest`` at a distance of ``gap`` or more."""
    gap = np.maximum(gap, 0.0)
    return 0.5 * (query_norm + largest - gap * gap) + 1e-6 * (1.0 + query_norm + largest)


def search(root: Node, query: np.ndarray, own_id: int, k: int, least: float) -> list[tuple[int, int]]:
    """The best (score, id) of a tree for a query, ties to smaller ids; scores below ``least`` may be left out."""
    query_norm = float(query @ query)
    narrow = query.astype(np.float32) if query_norm < 1 << 24 else query
    best: list[tuple[float, int]] = []  # heap of (score, -id)
    count = 0
    heap = [(-np.inf, count, root, float(_distances(root.center[None], query)[0]))]
    while heap:
        bound, _, node, distance = heapq.heappop(heap)
        floor = max(least, best[0][0]) if len(best) == k else least
        if -bound < floor:
            break
        if node.children is not None:
            # Before a child's own distance is computed: by the parent's.
            kept = [c for c in node.children if _bound(query_norm, c.largest, abs(distance - c.to_parent) - c.radius) >= floor]
            if kept:
                real = _distances(np.stack([c.center for c in kept]), query)
                for child, d in zip(kept, real.tolist(), strict=True):
                    score = float(_bound(query_norm, child.largest, d - child.radius))
                    if score >= floor:
                        count += 1
                        heapq.heappush(heap, (-score, count, child, d))
            continue
        vectors, ids = node.vectors, node.ids
        if floor > -np.inf:
            hopeful = _bound(query_norm, node.norms, np.abs(distance - node.to_center)) >= floor
            if 2 * np.count_nonzero(hopeful) < len(ids):
                vectors, ids = vectors[hopeful], ids[hopeful]
        scores = vectors @ (narrow if vectors.dtype == np.float32 else query)
        level = floor
        if len(scores) > k + 1:
            level = max(level, float(np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]))
        for place in np.flatnonzero(scores >= level).tolist():
            number = int(ids[place])
            if number == own_id:
                continue
            entry = (float(scores[place]), -number)
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return [(int(s), -i) for s, i in sorted(best, reverse=True)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def _assign(routes: np.ndarray):
    norms = (routes**2).sum(axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                v = _matrix(part.column("v"), routes.shape[1])
                squares = (v**2).sum(axis=1)[:, None] + norms - 2 * v @ routes.T
                yield pa.record_batch([part.column("vec_id"), part.column("v"), pa.array(squares.argmin(axis=1))],
                                      names=["vec_id", "v", "route"])

    return assign


_HITS = "query_id long, vec_id long, score long"


def _search(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: the vectors of a subtree, then the queries that ask it."""
        place, vectors, ids, tree = None, [], [], None
        for batch in batches:
            where = batch.column("subtree").to_numpy()
            block = batch.column("block").to_numpy()
            kind = batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(where) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            found = []
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                part = batch.slice(begin, end - begin)
                if not len(part):
                    continue
                here = (where[begin], block[begin])
                if here != place:
                    place, vectors, ids, tree = here, [], [], None
                values, numbers = _matrix(part.column("v"), width), part.column("vec_id").to_numpy()
                if kind[begin] == 0:
                    vectors.append(values)
                    ids.append(numbers)
                    continue
                if not vectors:
                    continue
                if tree is None:
                    v, i = np.concatenate(vectors), np.concatenate(ids)
                    order = np.argsort(i, kind="stable")
                    tree = build(v[order], i[order], k)
                for q, number, least in zip(values, numbers.tolist(), part.column("least").to_pylist(), strict=True):
                    for score, other in search(tree, q, number, k, -np.inf if least is None else least):
                        found.append((number, other, score))
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=[c.split()[0] for c in _HITS.split(", ")])

    return run


def _ask(roots: np.ndarray, radii: np.ndarray, largest: np.ndarray, numbers: np.ndarray):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query, subtree) for every subtree whose bound reaches the query's least score."""
        for batch in batches:
            v = _matrix(batch.column("v"), roots.shape[1])
            least = np.array([-np.inf if x is None else x for x in batch.column("least").to_pylist()])
            home = batch.column("home").to_numpy()
            for i in range(len(batch)):
                gaps = _distances(roots, v[i]) - radii
                chosen = numbers[(_bound(float(v[i] @ v[i]), largest, gaps) >= least[i]) & (numbers != home[i])]
                if len(chosen):
                    row = batch.slice(i, 1)
                    yield pa.record_batch([pa.array(chosen), pa.array(np.repeat(row.column("vec_id").to_numpy(), len(chosen))),
                                           pa.concat_arrays([row.column("v")] * len(chosen)),
                                           pa.array(np.repeat(least[i : i + 1], len(chosen)))], names=["subtree", "vec_id", "v", "least"])

    return ask


def _visit(vectors: DataFrame, asked: DataFrame, k: int, width: int) -> DataFrame:
    """Hits of asked (subtree, vec_id, v, least) in their subtrees.

    A subtree and a block of at most about ``QUERIES_PER_BLOCK`` of its queries meet in one task; a subtree that more
    queries ask is sent once per block.
    """
    blocks = asked.groupBy("subtree").agg(F.ceil(F.count("*") / QUERIES_PER_BLOCK).alias("blocks"))
    queries = asked.join(blocks, "subtree").select(
        "subtree", F.pmod(F.xxhash64("vec_id"), "blocks").alias("block"), F.lit(1).alias("kind"), "vec_id", "v", "least")
    entries = vectors.join(blocks, "subtree").select(
        "subtree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "vec_id", "v",
        F.lit(None).cast("double").alias("least"))
    both = entries.unionByName(queries).repartition("subtree", "block").sortWithinPartitions("subtree", "block", "kind", "vec_id")
    return both.mapInArrow(_search(k, width), _HITS)


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 20, subtree: int = SUBTREE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query vector the ``k`` vectors of highest inner product but itself.

    Both tables have (vec_id long, v array<long>); shorter vectors count as padded with zeros; queries are some of the vectors. Ties go to smaller ids.
    Routing vectors of the top level are a bounded sample, chosen by a hash of the id (one per half ``subtree`` vectors,
    at most ``MOST_ROUTES``); every vector is stored under its nearest one, in subtrees of about ``subtree`` vectors:
    a route with more is dealt over several by a hash, so equal vectors do not make one task. A query first searches a
    subtree of its own route; its k-th score is then a floor, and only subtrees whose bound reaches it are asked.
    Scores are exact while products stay below 2^53. Repeated ids keep their row with the smallest vector.
    """
    vectors = vectors.groupBy("vec_id").agg(F.min("v").alias("v"))
    vectors = materialize(vectors, "vectors")
    width, count = vectors.agg(F.max(F.size("v")), F.count("*")).first()
    spark = vectors.sparkSession
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))
    vectors = vectors.withColumn("v", F.concat("v", zeros))
    routes = min(MOST_ROUTES, max(1, count * 2 // subtree))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(routes).collect()
    routed = np.array([r["v"] for r in sample], float).reshape(len(sample), width)
    placed = materialize(vectors.mapInArrow(_assign(routed), "vec_id long, v array<long>, route long"), "routed")
    sizes = placed.groupBy("route").agg(F.ceil(F.count("*") / subtree).alias("parts"))
    first = Window.orderBy("route").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("first", F.coalesce(F.sum("parts").over(first), F.lit(0)))
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), "parts")
    placed = materialize(placed.join(F.broadcast(sizes), "route").select("vec_id", "v", "route", (F.col("first") + part).alias("subtree")), "subtrees")

    # The root entry of each subtree: its route, covering radius and largest squared norm.
    difference = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    centers = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(routed)], "route long, c array<double>")
    roots = placed.join(F.broadcast(centers), "route").groupBy("subtree", "route").agg(
        F.sqrt(F.max(difference)).alias("radius"), F.max(square).alias("largest")).collect()

    asked = placed.join(queries.select("vec_id").distinct(), "vec_id").select("subtree", "vec_id", "v")
    asked = materialize(asked, "queries")
    home = materialize(_visit(placed, asked.withColumn("least", F.lit(None).cast("double")), k, width), "home")
    least = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    least = least.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("least")).cast("double").alias("least"))
    known = asked.join(least, "vec_id", "left").select("vec_id", "v", F.col("subtree").alias("home"), "least")
    where = np.array([r["route"] for r in roots], np.int64)
    ask = _ask(routed[where], np.array([r["radius"] for r in roots]) * (1 + 1e-9), np.array([r["largest"] for r in roots]),
               np.array([r["subtree"] for r in roots], np.int64))
    more = materialize(known.mapInArrow(ask, "subtree long, vec_id long, v array<long>, least double"), "asked")
    hits = home.unionByName(_visit(placed, more, k, width))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantized(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(64 * x) of each component as double; vectors null, empty or with null or non-finite components left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = embeddings.select("vec_id", "embedding").filter("vec_id is not null and size(embedding) > 0").filter(finite)
    return valid.select(F.col("vec_id").cast("long").alias("vec_id"),
                        F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
