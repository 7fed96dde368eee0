"""Exact top-k by integer inner product: dual-tree search over cover trees.

Rows go to their nearest pivot and are cut into blocks there; queries likewise. A task has a block
of queries and a block of rows, builds a cover tree over each, and descends both trees together.
A pair of nodes is left out if even its best conceivable product, from the centres and covering
radii, is below the worst k-th score of the queries under the query node.

A first round compares query blocks with the row blocks of their own pivot, which gives every
query a k-th score to start from; the second round takes the other blocks, leaving out the pairs
of blocks that the same bound excludes.

Defined results: see ``valid_vectors`` for rows that take no part (zero vectors do); with fewer
candidates than k, all come back; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattlens.llm.vectors import bounded_sample, is_query, matrix, valid_vectors
from wattlens.session import materialize

SCALE = 64
PIVOTS = 64  # at most, and no more than it takes to fill blocks; they shape the blocks, not the results
MEMBERS, QUERIES = 4_096, 512
LEAF = 128  # points below which a node is not divided
BASE = 1.3  # ratio of the scales of a node and its children
_SLACK = 1e-9
_KEPT = 24  # trees a task keeps at hand


class Node:
    """A centre, the largest distance to a point below it, and children or points."""

    __slots__ = ("centre", "length", "radius", "points", "children")

    def __init__(self, data: np.ndarray, points: np.ndarray, centre: int, away: np.ndarray):
        self.centre = data[centre]
        self.length = float(np.sqrt(self.centre @ self.centre))
        self.radius = float(away.max())
        self.points, self.children = points, []


def cover_tree(data: np.ndarray) -> Node:
    """Every child's centre is a point, farther than the next smaller scale from its siblings' centres."""

    def grow(points: np.ndarray, centre: int, away: np.ndarray, scale: float) -> Node:
        node = Node(data, points, centre, away)
        if len(points) <= LEAF or node.radius == 0:
            return node
        scale = min(scale, node.radius) / BASE
        left, far, at = points, away, centre
        while len(left):
            near = far <= scale
            if not near.all() or node.children:
                node.children.append((left[near], at, far[near]))
            else:
                return grow(points, centre, away, scale)
            left = left[~near]
            if len(left):
                at = int(left[0])
                far = np.sqrt(((data[left] - data[at]) ** 2).sum(1))
        # single points would make a node each; they stay together under the node's own ball
        small = [c for c in node.children if len(c[0]) <= LEAF // 8]
        node.children = [grow(*c, scale) for c in node.children if len(c[0]) > LEAF // 8]
        if small:
            rest = np.concatenate([c[0] for c in small])
            for at in range(0, len(rest), LEAF):
                part = rest[at : at + LEAF]
                middle = int(part[0])
                node.children.append(Node(data, part, middle, np.sqrt(((data[part] - data[middle]) ** 2).sum(1))))
        return node

    points = np.arange(len(data))
    return grow(points, 0, np.sqrt(((data - data[0]) ** 2).sum(1)), np.inf)


def bound(product: float, a_length: float, a_radius: float, b_length: float, b_radius: float) -> float:
    """No inner product between the two balls is larger."""
    most = product + a_length * b_radius + b_length * a_radius + a_radius * b_radius
    return most + _SLACK * (abs(most) + a_length * b_length + 1)


def search(
    queries: np.ndarray,
    query_ids: np.ndarray,
    rows: np.ndarray,
    row_ids: np.ndarray,
    start: np.ndarray,
    k: int,
    trees: tuple[Node, Node] | None = None,
):
    """(query index, row index, score) of all pairs that may be among the k best.

    ``start`` holds scores that each query's k-th best is known to reach.
    """
    exact = max(np.abs(queries).max(initial=0), 1) * max(np.abs(rows).max(initial=0), 1) * queries.shape[1] < 2.0**53
    q_tree, r_tree = trees or (cover_tree(queries.astype(np.float64)), cover_tree(rows.astype(np.float64)))
    left, right = (queries.astype(np.float64), rows.astype(np.float64)) if exact else (queries, rows)
    worst = start.astype(np.float64).copy()
    best = np.full((len(queries), k), -np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def most(q: Node, r: Node) -> float:
        return bound(float(q.centre @ r.centre), q.length, q.radius, r.length, r.radius)

    heap, turn = [(-most(q_tree, r_tree), 0, q_tree, r_tree)], 0
    while heap:
        reach, _, q, r = heapq.heappop(heap)
        if -reach < worst[q.points].min():
            continue
        if q.children and (not r.children or q.radius > r.radius):
            pairs = [(child, r) for child in q.children]
        elif r.children:
            pairs = [(q, child) for child in r.children]
        else:
            scores = left[q.points] @ right[r.points].T
            scores = np.where(query_ids[q.points][:, None] == row_ids[r.points][None, :], -np.inf, scores)
            qi, ri = np.nonzero((scores >= worst[q.points][:, None]) & (scores > -np.inf))
            if len(qi):
                found.append((q.points[qi], r.points[ri], scores[qi, ri]))
                merged = np.concatenate([best[q.points], scores], axis=1)
                merged = -np.partition(-merged, k - 1, axis=1)[:, :k]
                best[q.points] = merged
                worst[q.points] = np.maximum(worst[q.points], merged.min(1))
            continue
        for a, b in pairs:
            reach = most(a, b)
            if reach >= worst[a.points].min():
                turn += 1
                heapq.heappush(heap, (-reach, turn, a, b))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    qi, ri, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = scores >= worst[qi]
    return qi[keep], ri[keep], scores[keep]


def first_of_ties(qi: np.ndarray, ri: np.ndarray, scores: np.ndarray, row_ids: np.ndarray, k: int):
    """At most k pairs a query: among equal scores the smaller ids go on."""
    order = np.lexsort((row_ids[ri], -scores, qi))
    nth = np.arange(len(order)) - np.searchsorted(qi[order], qi[order])
    order = order[nth < k]
    return qi[order], ri[order], scores[order]


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """One row per block: ids, vectors as bytes, centre and radius. Blocks are of bounded size."""

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("vec_id", ignore_index=True)
        data = np.array(block["vector"].tolist(), dtype=np.int64)
        centre = data.mean(0)
        out = {
            "pivot": [int(block["pivot"][0])],
            key: [block[key][0]],
            "ids": [block["vec_id"].to_numpy(np.int64).tobytes()],
            "data": [data.tobytes()],
            "centre": [centre],
            "length": [float(np.sqrt(centre @ centre))],
            "radius": [float(np.sqrt(((data - centre) ** 2).sum(1)).max())],
        }
        if "least" in block:
            out |= {"starts": [block["least"].to_numpy(np.float64).tobytes()], "least": [float(block["least"].min())]}
        return pd.DataFrame(out)

    schema = f"pivot int, {key} string, ids binary, data binary, centre array<double>, length double, radius double"
    if "least" in rows.columns:
        schema += ", starts binary, least double"
    return rows.groupBy(key).applyInPandas(pack, schema)


def _searched(pairs: DataFrame, k: int, parts: int) -> DataFrame:
    """Search every (query block, row block) pair. Pairs of a row block follow each other, so its tree is built once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: OrderedDict[str, Node] = OrderedDict()

        def tree(name: str, data: np.ndarray) -> Node:
            if name not in known:
                if len(known) >= _KEPT:
                    known.popitem(last=False)
                known[name] = cover_tree(data.astype(np.float64))
            known.move_to_end(name)
            return known[name]

        for batch in batches:
            for pair in batch.itertuples(index=False):
                q_ids, r_ids = np.frombuffer(pair.q_ids, np.int64), np.frombuffer(pair.r_ids, np.int64)
                queries = np.frombuffer(pair.q_data, np.int64).reshape(len(q_ids), -1)
                rows = np.frombuffer(pair.r_data, np.int64).reshape(len(r_ids), -1)
                start = np.frombuffer(pair.starts, np.float64) if pair.starts else np.full(len(q_ids), -np.inf)
                trees = tree(f"q{pair.q_block}", queries), tree(f"r{pair.r_block}", rows)
                qi, ri, scores = first_of_ties(*search(queries, q_ids, rows, r_ids, start, k, trees), r_ids, k)
                yield pd.DataFrame({"query_id": q_ids[qi], "vec_id": r_ids[ri], "score": scores.astype(np.int64)})

    # at scale a row block meets many query blocks: these are dealt over several tasks, in groups
    dealt = pairs.withColumn("_part", F.pmod(F.xxhash64("q_block"), F.lit(parts))).repartition("r_block", "_part")
    dealt = dealt.sortWithinPartitions("r_block", "q_block")
    return dealt.select("q_block", "r_block", "q_ids", "q_data", "starts", "r_ids", "r_data").mapInPandas(run, "query_id long, vec_id long, score long")


def exact_top_k(table: DataFrame, k: int = 20, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of every query row's k best rows."""
    vectors = valid_vectors(table, zero=True)
    scaled = vectors.select("vec_id", F.transform("vector", lambda x: F.floor(x * scale)).alias("vector"))
    scaled = materialize(scaled, "scaled")
    total = scaled.count()
    parts = 1 + total // (20 * QUERIES * 64)
    sample = bounded_sample(scaled, min(PIVOTS, -(-total // MEMBERS))).select("vector").collect()
    if not sample:
        return scaled.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = np.unique(np.array([r["vector"] for r in sample], dtype=np.float64), axis=0)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                points = matrix(batch["vector"])
                batch["pivot"] = ((pivots**2).sum(1)[None, :] - 2 * points @ pivots.T).argmin(1).astype(np.int32)
                yield batch

    placed = materialize(scaled.mapInPandas(nearest, "vec_id long, vector array<long>, pivot int"), "pivoted")
    asked = placed.filter(is_query(F.col("vec_id")))

    def blocked(rows: DataFrame, size: int, name: str) -> DataFrame:
        sizes = rows.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
        nth = F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
        return rows.join(sizes, "pivot").withColumn(name, F.concat_ws("-", "pivot", nth)).drop("blocks")

    row_blocks = materialize(_packed(blocked(placed, MEMBERS, "r_block"), "r_block"), "rows")
    asked = blocked(asked, QUERIES, "q_block")
    sides = lambda df, side, *more: df.select(
        "pivot", f"{side}_block", F.col("ids").alias(f"{side}_ids"), F.col("data").alias(f"{side}_data"), *more
    )
    first_queries = sides(_packed(asked, "q_block"), "q").withColumn("starts", F.lit(None).cast("binary"))
    home = first_queries.join(sides(row_blocks, "r"), "pivot")
    first = materialize(_best(_searched(home, k, parts), k), "first")

    known = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    least = known.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("s").cast("double")).alias("least"))
    started = asked.join(least, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    query_blocks = materialize(_packed(started, "q_block"), "queries")
    # summaries first: every query block meets every row block's ball, and only pairs that may matter move data
    shape = ("centre", "length", "radius")
    counted = row_blocks.select("r_block", "pivot", *shape).withColumn("nth", F.pmod(F.xxhash64("r_block"), F.lit(64)).cast("int"))
    q_shape = query_blocks.select(
        "q_block", F.col("pivot").alias("q_pivot"), "least", *[F.col(c).alias(f"q_{c}") for c in shape]
    ).withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(63))))
    product = F.aggregate(F.zip_with("q_centre", "centre", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    reach = product + F.col("q_length") * F.col("radius") + F.col("length") * F.col("q_radius") + F.col("q_radius") * F.col("radius")
    pairs = (
        q_shape.join(counted, "nth")
        .filter((F.col("q_pivot") != F.col("pivot")) & (reach * (1 + _SLACK) + 1 >= F.col("least")))
        .select("q_block", "r_block")
    )
    other = (
        pairs.join(sides(query_blocks, "q", "starts").drop("pivot"), "q_block")
        .join(sides(row_blocks, "r").drop("pivot"), "r_block")
    )
    second = _searched(other, k, parts)
    return _best(first.select("query_id", "vec_id", "score").unionByName(second), k).select("query_id", "rank", "vec_id", "score")
