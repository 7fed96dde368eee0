"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M the longest
vector: the nearest vector is then the one with the largest inner product.

The tree is fitted on a sample of bounded size; every row is then put into its leaf. A query
walks the tree with a priority queue and visits leaves in the order of the queue. How many is
calibrated: for some queries the true neighbours are found by scanning all rows, and the visits
are widened until the wanted share of these lies in visited leaves.

Defined results: see ``valid_vectors`` for rows that take no part; a table with no valid row gives
no rows; with fewer candidates than k, all come back.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattlens.llm.vectors import bounded_sample, is_query, matrix, top_rows, valid_vectors
from wattlens.session import materialize

SAMPLE = 20_000  # vectors the tree is fitted on, at most
BRANCH = 16
LEAVES = 4_096  # at most
LEAF = 512  # rows per leaf aimed at while there are fewer than LEAVES leaves
CALIBRATION = 256  # queries with known neighbours, at most
RECALL = 0.96
FIRST = 4  # leaves whose results set the score that rows of later leaves have to reach
MEMBERS, QUERIES = 4_096, 1_024  # rows of a leaf, and queries on it, that one task compares


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
    return np.column_stack([vectors, rest])


def inner(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products added up component by component, the same whatever block a row is in."""
    out = np.zeros((len(queries), len(vectors)))
    for q, x in zip(queries.T, vectors.T, strict=True):
        out += q[:, None] * x[None, :]
    return out


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = points[np.sort(rng.choice(len(points), k, replace=False))]
    for _ in range(rounds):
        owner = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, points)
        sizes = np.bincount(owner, minlength=k)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres, _nearest(points, centres)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * points @ centres.T).argmin(1)


class Tree:
    """Centres of all nodes; node 0 is the root, ``children`` lists each node's, leaves have none."""

    def __init__(self, centres: np.ndarray, children: list[list[int]]):
        self.centres, self.children = centres, children
        self.leaves = [i for i, c in enumerate(children) if not c]

    @classmethod
    def fit(cls, points: np.ndarray, leaves: int, seed: int = 7) -> Tree:
        """Split the node with most sample points until there are enough leaves."""
        rng, centres, children = np.random.default_rng(seed), [points.mean(0)], [[]]
        heap, count = [(-len(points), 0, np.arange(len(points)))], 1
        while heap and count < leaves:
            size, node, mine = heapq.heappop(heap)
            k = min(BRANCH, leaves - count + 1, -size)
            if k < 2 or (points[mine] == points[mine[0]]).all():
                continue
            found, owner = _kmeans(points[mine], k, rng)
            if len(np.unique(owner)) < 2:
                continue
            for c in range(k):
                if (owner == c).any():
                    children[node].append(len(centres))
                    heapq.heappush(heap, (-int((owner == c).sum()), len(centres), mine[owner == c]))
                    centres.append(found[c])
                    children.append([])
            count += len(children[node]) - 1
        return cls(np.array(centres), children)

    def assign(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point, by the nearest child from the root down."""
        node = np.zeros(len(points), dtype=np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, mine = todo.pop()
            node[mine] = at
            kids = np.array(self.children[at], dtype=np.int64)
            if len(kids) and len(mine):
                owner = _nearest(points[mine], self.centres[kids])
                todo += [(int(kids[c]), mine[owner == c]) for c in range(len(kids))]
        return node

    def visits(self, queries: np.ndarray, most: int) -> list[list[int]]:
        """The first ``most`` leaves of each query, best bin first."""
        away = (self.centres**2).sum(1)[None, :] - 2 * queries @ self.centres.T
        out = []
        for distance in away:
            heap, order = [(0.0, 0)], []
            while heap and len(order) < most:
                _, node = heapq.heappop(heap)
                if not self.children[node]:
                    order.append(node)
                for child in self.children[node]:
                    heapq.heappush(heap, (float(distance[child]), child))
            out.append(order)
        return out


def fit_tree(rows: DataFrame, total: int, longest: float, sample: int = SAMPLE) -> Tree:
    """Fit in one task on the sample; the nodes come back, a bounded number of them."""
    leaves = int(min(LEAVES, max(1, total // LEAF)))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            points = pd.concat(parts).sort_values("vec_id")
            tree = Tree.fit(lifted(matrix(points["vector"]), longest), leaves)
            yield pd.DataFrame({"node": range(len(tree.centres)), "centre": list(tree.centres), "children": tree.children})

    nodes = bounded_sample(rows, sample).repartition(1).mapInPandas(fit, "node int, centre array<double>, children array<int>")
    found = sorted(nodes.collect(), key=lambda r: r["node"])
    return Tree(np.array([r["centre"] for r in found]), [list(r["children"]) for r in found])


def _scan(rows: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """True neighbours (query_id, vec_id, leaf) of a few given queries, from all rows."""
    ids, wanted = queries["vec_id"].to_numpy(np.int64), matrix(queries["vector"])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values("vec_id", ignore_index=True)
            own, vectors = batch["vec_id"].to_numpy(np.int64), matrix(batch["vector"])
            scores = np.where(own[None, :] == ids[:, None], -np.inf, wanted @ vectors.T) if len(batch) else np.zeros((len(ids), 0))
            picked = top_rows(scores, own, k)
            found = pd.DataFrame(
                {
                    "query_id": np.repeat(ids, picked.shape[1]),
                    "vec_id": own[picked].ravel(),
                    "leaf": batch["leaf"].to_numpy()[picked].ravel(),
                    "score": np.take_along_axis(scores, picked, 1).ravel(),
                }
            )
            yield found[np.isfinite(found["score"])]

    return _ranked(rows.mapInPandas(best, "query_id long, vec_id long, leaf int, score double"), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; at most k come from any block, so groups stay small."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def calibrated_visits(tree: Tree, rows: DataFrame, k: int, recall: float, longest: float) -> int:
    """The smallest number of leaf visits whose recall on the calibration queries is reached."""
    queries = bounded_sample(rows.filter(is_query(F.col("vec_id"))), CALIBRATION, seed=11).select("vec_id", "vector").toPandas()
    if queries.empty:
        return len(tree.leaves)
    truth = _scan(rows, queries, k).select("query_id", "leaf").toPandas()
    orders = tree.visits(np.column_stack([matrix(queries["vector"]), np.zeros(len(queries))]), len(tree.leaves))
    place = {q: {leaf: i for i, leaf in enumerate(o)} for q, o in zip(queries["vec_id"], orders, strict=True)}
    needed = np.sort([place[q][leaf] + 1 for q, leaf in zip(truth["query_id"], truth["leaf"], strict=True)])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1


def nearest(table: DataFrame, k: int = 20, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the neighbours found for every query row."""
    rows = materialize(valid_vectors(table, zero=False), "vectors")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    total, longest = rows.agg(F.count(F.lit(1)), F.coalesce(F.sqrt(F.max(norm)), F.lit(0.0))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return rows.sparkSession.createDataFrame([], schema)
    tree = fit_tree(rows, total, longest, sample)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["leaf"] = tree.assign(lifted(matrix(batch["vector"]), longest)).astype(np.int32) if len(batch) else 0
            yield batch

    placed = materialize(rows.mapInPandas(place, "vec_id long, vector array<double>, leaf int"), "leaves")
    visits = calibrated_visits(tree, placed, k, recall, longest)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), QUERIES):
                part = batch.iloc[at : at + QUERIES]
                vectors = matrix(part["vector"])
                leaves = tree.visits(np.column_stack([vectors, np.zeros(len(part))]), visits)
                sizes = [len(order) for order in leaves]
                yield pd.DataFrame(
                    {
                        "vec_id": np.repeat(part["vec_id"].to_numpy(), sizes),
                        "leaf": np.concatenate(leaves).astype(np.int32),
                        "nth": np.concatenate([np.arange(n) for n in sizes]).astype(np.int32),
                    }
                )

    # read apart from the rows they are compared with, so that the two sides are different columns
    queries = materialize(placed.filter(is_query(F.col("vec_id"))).select("vec_id", "vector"), "queries")
    plan = materialize(queries.mapInPandas(walk, "vec_id long, leaf int, nth int"), "visits")
    near = plan.filter(F.col("nth") < FIRST).join(queries, "vec_id").withColumn("least", F.lit(float("-inf")))
    first = materialize(_ranked(_compared(near, placed, k), k), "first")
    # a row below the k-th score of the first leaves cannot be among the k best
    least = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    far = plan.filter(F.col("nth") >= FIRST).join(queries.join(least, "vec_id", "left"), "vec_id")
    second = _compared(far.withColumn("least", F.coalesce("least", F.lit(float("-inf")))), placed, k)
    found = first.select("query_id", "vec_id", "score").unionByName(second)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _compared(asked: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): for every visit the k best rows of the leaf that reach ``least``.

    A cell is a leaf; both of its sides are cut into blocks, and every pair of blocks is compared on its own.
    """
    rows_in = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("mblocks"))
    asks_in = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("qblocks"))
    blocks = materialize(rows_in.join(asks_in, "leaf"), "blocks")
    nth = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    members = placed.join(blocks, "leaf").select("leaf", nth("mblocks").alias("mb"), each("qblocks").alias("qb"), "vec_id", "vector")
    asking = asked.join(blocks, "leaf").select("leaf", each("mblocks").alias("mb"), nth("qblocks").alias("qb"), "vec_id", "vector", "least")

    def compare(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or members.empty:
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        members = members.sort_values("vec_id", ignore_index=True)
        ids, own = members["vec_id"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64)
        scores = inner(matrix(queries["vector"]), matrix(members["vector"]))
        scores[(own[:, None] == ids[None, :]) | (scores < queries["least"].to_numpy()[:, None])] = -np.inf
        picked = top_rows(scores, ids, k)
        found = pd.DataFrame(
            {
                "query_id": np.repeat(own, picked.shape[1]),
                "vec_id": ids[picked].ravel(),
                "score": np.take_along_axis(scores, picked, 1).ravel(),
            }
        )
        return found[found["score"] > -np.inf]

    cell = ["leaf", "mb", "qb"]
    return asking.groupBy(*cell).cogroup(members.groupBy(*cell)).applyInPandas(compare, "query_id long, vec_id long, score double")
