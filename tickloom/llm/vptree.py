"""Nearest neighbours by inner product with vantage-point trees per shard.

Largest inner product becomes smallest Euclidean distance by one extra coordinate
sqrt(M^2 - |x|^2), with M the largest norm. A small tree fitted on a bounded sample cuts the
space into shards of about equal size; every shard builds its own tree over all its vectors. A
query first searches the shard it falls into, which gives it a radius; with that radius it goes
through the top tree and visits the other shards the triangle inequality leaves. A task of this second
search takes a block of queries through a lane of neighbouring shards, so that queries and trees are sent
once a lane and block, and only the k best of a lane, none below the first shard's k-th, come back.

A subtree whose points lie between distances lo and hi of the vantage point is skipped if
factor * max(lo - d, d - hi) > radius. Factor 1 is exact search; larger factors skip more. Leaves next to
each other are scored by one product, for the queries that have to see at least one of them.

Equal vectors are one entry with the k + 1 smallest ids, more of which no answer can need, so a
vector shared by a third of all rows is small.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.plans.staging import stage

#: Vectors per shard and queries per task, about; points per leaf; rows the top tree is fitted on.
SHARD_ROWS, QUERY_ROWS, LEAF_ROWS, SAMPLE_ROWS = 4096, 2048, 48, 20_000
#: A task of the second search: neighbouring shards at most, and blocks of queries. Vectors and queries of one product, about.
LANE_SHARDS, LANE_BLOCKS, BLOCK_ROWS, TILE_QUERIES = 32, 2, 512, 1024
#: Pruning factor of the registered query; recall against brute force is in the README.
FACTOR = 1.5


@dataclass
class Node:
    point: np.ndarray | None = None  # vantage point with its extra coordinate
    inner: tuple[float, float] = (0.0, 0.0)  # least and largest distance of the near half
    outer: tuple[float, float] = (0.0, 0.0)
    near: Node | None = None
    far: Node | None = None
    rows: np.ndarray | None = None  # leaf: row numbers
    number: int = -1  # from 0, of leaves and of inner nodes


def lift(vectors: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0.0))
    return np.hstack([vectors, rest[:, None]])


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Points (n x d) to one point."""
    return np.sqrt(np.maximum((points * points).sum(axis=1) + (to * to).sum() - 2.0 * (points @ to), 0.0))


def build(points: np.ndarray, leaf_rows: int, seed: int = 1) -> tuple[Node, list[Node]]:
    """A vantage-point tree with median cuts, and its leaves in order."""
    rng = np.random.default_rng(seed)
    leaves: list[Node] = []

    def grow(rows: np.ndarray) -> Node:
        if len(rows) <= leaf_rows:
            leaf = Node(rows=rows, number=len(leaves))
            leaves.append(leaf)
            return leaf
        # of a few candidates, the vantage point whose distances spread most
        tried = rng.choice(rows, size=min(5, len(rows)), replace=False)
        probe = rng.choice(rows, size=min(100, len(rows)), replace=False)
        best = max(tried, key=lambda r: distances(points[probe], points[r]).std())
        d = distances(points[rows], points[best])
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        return Node(points[best], (float(d[near[0]]), float(d[near[-1]])), (float(d[far[0]]), float(d[far[-1]])),
                    grow(rows[near]), grow(rows[far]))

    return grow(np.arange(len(points))), leaves


def home(root: Node, points: np.ndarray) -> np.ndarray:
    """Leaf number each point falls into."""
    out = np.zeros(len(points), dtype=np.int64)

    def go(node: Node, at: np.ndarray) -> None:
        if node.rows is not None or len(at) == 0:
            out[at] = node.number
            return
        near = distances(points[at], node.point) < node.outer[0]
        go(node.near, at[near])
        go(node.far, at[~near])

    go(root, np.arange(len(points)))
    return out


def reach(root: Node, points: np.ndarray, radius: np.ndarray, factor: float) -> list[list[int]]:
    """Leaves each point has to visit in a top tree, whose halves are known by their cut only."""
    out: list[list[int]] = [[] for _ in points]

    def go(node: Node, at: np.ndarray) -> None:
        if len(at) == 0:
            return
        if node.rows is not None:
            for i in at:
                out[i].append(node.number)
            return
        d, cut = distances(points[at], node.point), node.outer[0]
        go(node.near, at[factor * (d - cut) <= radius[at]])
        go(node.far, at[factor * (cut - d) <= radius[at]])

    go(root, np.arange(len(points)))
    return out


def radius(queries: np.ndarray, score: np.ndarray, norm: float) -> np.ndarray:
    """Distance within which lifted vectors have at least that score (-inf: any distance).

    Distances come from squares, so those of near copies are off by up to the root of the rounding of a square.
    """
    squares = norm ** 2 + (queries * queries).sum(axis=1)
    return np.sqrt(np.maximum(squares - 2.0 * score, 0.0)) + 1e-6 * np.sqrt(squares)


class Shard:
    """All vectors of a shard, leaf after leaf of their own tree; ``ids`` has up to k + 1 ids of each vector."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], norm: float, leaf_rows: int = LEAF_ROWS):
        self.norm = norm
        self.root, leaves = build(lift(vectors.astype(float), norm), leaf_rows)
        order = np.concatenate([leaf.rows for leaf in leaves])
        self.vectors = vectors[order]
        self.n_ids = np.array([len(ids[r]) for r in order])
        self.ids = np.concatenate([ids[r] for r in order]).astype(np.int64)
        self.first = np.cumsum(self.n_ids) - self.n_ids  # place of each vector's first id
        self.ends = np.cumsum([len(leaf.rows) for leaf in leaves])
        self.inner: list[Node] = []

        def number(node: Node) -> None:
            if node.rows is None:
                node.number = len(self.inner)
                self.inner.append(node)
                number(node.near)
                number(node.far)

        number(self.root)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The least distance (leaves x queries) the triangle inequality leaves between a query and a leaf's vectors."""
        out = np.zeros((len(self.ends), len(queries)))
        if not self.inner:
            return out
        points = np.stack([node.point for node in self.inner])
        squares = (points * points).sum(axis=1)[:, None] + (queries * queries).sum(axis=1)
        d = np.sqrt(np.maximum(squares - 2.0 * (points[:, :-1] @ queries.T), 0.0))

        def go(node: Node, least: np.ndarray) -> None:
            if node.rows is not None:
                out[node.number] = least
                return
            for child, (lo, hi) in ((node.near, node.inner), (node.far, node.outer)):
                go(child, np.maximum(least, np.maximum(lo - d[node.number], d[node.number] - hi)))

        go(self.root, np.zeros(len(queries)))
        return out

    def blocks(self) -> list[tuple[int, int]]:
        """Runs of neighbouring leaves (first, after the last) with about BLOCK_ROWS vectors."""
        cuts = np.flatnonzero(np.diff((self.ends - 1) // BLOCK_ROWS, prepend=-1)).tolist()
        return list(zip(cuts, cuts[1:] + [len(self.ends)]))


class Search:
    """The k best vectors of each query under other ids than its own, shard by shard: best score first, ties by id.

    ``floor`` is a score that k vectors are known to reach (-inf: none known), so that lower ones are of no use.
    Blocks are scored in single precision, scaled so that no vector is longer than 1; what reaches the floor within
    the error of that is scored again in double precision. ``largest``: of all components of vectors.
    """

    def __init__(self, own: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, largest: float, factor: float):
        self.own, self.queries, self.floor, self.k, self.factor = own, queries, floor.copy(), k, factor
        root = np.sqrt(queries.shape[1])
        mine = np.abs(queries).max(axis=1) * root
        self.scale, self.unit = largest * root, largest * root * mine
        self.fits = np.isfinite(self.unit) & (self.unit > 1e-290)  # else the floor cannot be scaled
        self.small = (queries / mine[:, None]).astype(np.float32)
        self.error = (queries.shape[1] + 8) * 2.0 ** -24
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]  # query numbers, ids, scores

    def visit(self, shard: Shard, asking: np.ndarray) -> None:
        """Search a shard for the queries with the numbers ``asking``."""
        small = (shard.vectors / self.scale).astype(np.float32)
        least = self.factor * shard.bounds(self.queries[asking])
        # queries without a floor take one from the block of their nearest leaf
        home, new = np.full(len(asking), -1), np.isneginf(self.floor[asking])
        home[new] = least[:, new].argmin(axis=0)
        seen = [(a, b, (home >= a) & (home < b)) for a, b in shard.blocks()]
        if new.any():
            self._keep(shard, [self._hits(shard, small, a, b, asking[here]) for a, b, here in seen])
            self.best()
        reach_to = radius(self.queries[asking], self.floor[asking], shard.norm)
        self._keep(shard, [self._hits(shard, small, a, b, asking[(least[a:b] <= reach_to).any(axis=0) & ~here])
                           for a, b, here in seen])
        if sum(len(query) for query, _, _ in self.found) > 2 * self.k * len(self.queries):
            self.best()

    def _hits(self, shard: Shard, small: np.ndarray, a: int, b: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries of ``at`` and rows of the leaves from a to before b that may reach the floor."""
        start, end = shard.ends[a - 1] if a else 0, shard.ends[b - 1]
        scores = self.small[at] @ small[start:end].T
        floor = np.divide(self.floor[at], self.unit[at], out=np.full(len(at), -np.inf), where=self.fits[at])
        new = np.flatnonzero(np.isneginf(floor))
        if len(new) and end - start >= self.k:
            mine = (shard.n_ids[start:end] == 1) & (shard.ids[shard.first[start:end]] == self.own[at[new], None])
            floor[new] = np.partition(np.where(mine, -np.inf, scores[new]), -self.k, axis=1)[:, -self.k] - self.error
        i, row = np.divmod(np.flatnonzero(scores >= (floor - 2 * self.error).astype(np.float32)[:, None]), end - start)
        return at[i], row + start

    def _keep(self, shard: Shard, hits: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Note the ids of hits that reach the floor."""
        query, row = (np.concatenate(x) for x in zip(*hits))
        score = _exact(self.queries, query, shard.vectors, row)
        use = score >= self.floor[query]
        query, row, score = query[use], row[use], score[use]
        n = shard.n_ids[row]  # every id of a vector counts
        ids = shard.ids[np.repeat(shard.first[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        query, score = np.repeat(query, n), np.repeat(score, n)
        other = ids != self.own[query]
        self.found.append((query[other], ids[other], score[other]))

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers in order, ids and scores of the k best found; raises the floor to the k-th."""
        query, ids, score = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best, last = place < self.k, place == self.k - 1
        self.floor[query[last]] = score[last]
        self.found = [(query[best], ids[best], score[best])]
        return self.found[0]


def _exact(queries: np.ndarray, query: np.ndarray, vectors: np.ndarray, row: np.ndarray, part: int = 20_000) -> np.ndarray:
    """Inner products of pairs, summed from first to last component in double precision."""
    out = np.empty(len(query))
    for a in range(0, len(query), part):
        products = queries[query[a:a + part]] * vectors[row[a:a + part]]
        out[a:a + part] = products.cumsum(axis=1)[:, -1]
    return out


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (array<float> as it is, else array<double>) and the hash h of v, once for each pair of them.

    Of rows with an id and a finite vector that is not zero, of the commonest length among them.
    """
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast(kind).alias("v"))
    # array_contains is null if there is a null; NaN is the largest number
    rows = rows.where("id is not null and size(v) > 0 and not array_contains(v, double('nan')) and array_max(v) < double('infinity')"
                      " and array_min(v) > double('-infinity') and (array_max(v) != 0 or array_min(v) != 0)")
    rows = stage(rows.groupBy("id", "v").agg(F.count("*").alias("c"))
                 .select("id", "v", "c", F.size("v").alias("n"), F.xxhash64(F.col("v").cast("array<double>")).alias("h")))
    lengths = rows.groupBy("n").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return rows.where(F.col("n") == (lengths[0].n if lengths else 0)).select("id", "v", "h")


def nearest(vectors: DataFrame, is_query, k: int = 20, factor: float = FACTOR, key: str = "vec_id",
            vector: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest by inner product, nearest first.

    ``is_query`` is a column expression on ``id``. Candidates are all rows but those with the query's own
    id; if there are fewer than k, all are returned. Ties go to the smaller vec_id. Rows whose vector is
    null, zero, of odd length, or holds null or non-finite components take no part, nor do null ids. A
    repeated row counts once. Other columns are ignored. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    few = Window.partitionBy("h", "v").orderBy("id")
    entries = rows.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    # the ids over the same window: grouping by a vector would shuffle it once more
    entries = entries.withColumn("ids", F.collect_list("id").over(few.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    entries = stage(entries.where(F.col("n") == 1).select("h", "v", "ids"))
    facts = entries.agg(
        F.count("*").alias("n"), F.max(F.expr("aggregate(cast(v as array<double>), 0D, (a, x) -> a + x * x)")).alias("m"),
        F.max(F.greatest(F.array_max("v"), -F.array_min("v")).cast("double")).alias("largest")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if facts.n == 0:
        return spark.createDataFrame([], schema)
    norm = float(np.sqrt(facts.m)) * (1 + 1e-12)

    sample = entries.where(F.pmod("h", F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, SAMPLE_ROWS / facts.n)))).select("v").toPandas()["v"]
    if len(sample) == 0:
        sample = entries.select("v").limit(1).toPandas()["v"]
    shards = max(1, -(-facts.n // shard_rows))
    top, leaves = build(lift(np.stack(sample.to_numpy()).astype(float), norm), max(1, -(-len(sample) // shards)))
    lane_shards = min(LANE_SHARDS, max(1, len(leaves) // 8))  # at least eight lanes, if there are as many shards

    @F.arrow_udf(T.LongType())
    def shard_of(v: pa.Array) -> pa.Array:
        flat = np.asarray(v.flatten(), dtype=float).reshape(len(v), -1)
        return pa.array(home(top, lift(flat, norm)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(np.stack(pdf["v"].to_numpy()), list(pdf["ids"]), norm)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "blob": [pickle.dumps(shard)]})

    index = stage(entries.withColumn("shard", shard_of("v")).groupBy("shard").applyInPandas(pack, "shard bigint, blob binary"))
    queries = stage(rows.where(is_query).withColumn("shard", shard_of("v")))

    found = "id bigint, h bigint, visit array<array<bigint>>, floor double, ids array<bigint>, scores array<double>"

    def search(first: bool):
        def run(asked: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
            shards = {number: pickle.loads(blob) for number, blob in zip(trees["shard"], trees["blob"])}
            tiles = [tile(asked.iloc[a:a + TILE_QUERIES], shards) for a in range(0, len(asked), TILE_QUERIES)]
            return pd.concat(tiles) if tiles else pd.DataFrame(columns=["id", "h", "visit", "floor", "ids", "scores"])

        def tile(asked: pd.DataFrame, shards: dict[int, Shard]) -> pd.DataFrame:
            q = np.stack(asked["v"].to_numpy()).astype(float)
            state = Search(asked["id"].to_numpy(), q, asked["floor"].to_numpy(), k, facts.largest, factor)
            visit = np.concatenate(asked["visit"].to_numpy())
            asking = np.repeat(np.arange(len(q)), [len(x) for x in asked["visit"]])
            for number in np.unique(visit):
                if number in shards:  # a shard of the sample may have no vectors
                    state.visit(shards[number], asking[visit == number])
            query, ids, scores = state.best()
            visits: list[list[list[int]]] = [[] for _ in q]
            if first:
                lifted = np.hstack([q, np.zeros((len(q), 1))])
                for i, leaves in enumerate(reach(top, lifted, radius(q, state.floor, norm), factor)):
                    lanes = defaultdict(list)
                    for leaf in leaves:
                        if leaf != visit[i]:
                            lanes[leaf // lane_shards].append(leaf)
                    visits[i] = list(lanes.values())
            cuts = np.searchsorted(query, np.arange(1, len(q)))
            return pd.DataFrame({"id": asked["id"].to_numpy(), "h": asked["h"].to_numpy(), "visit": visits, "floor": state.floor,
                                 "ids": np.split(ids, cuts), "scores": np.split(scores, cuts)})
        return run

    def ask(asked: DataFrame, shards: int, task_rows: int, first: bool) -> DataFrame:
        """Queries with the shards they visit in a lane of so many: tasks of about task_rows, each next to the lane's trees."""
        lane = F.expr(f"visit[0] div {shards}")
        load = stage(asked.groupBy(lane.alias("lane")).agg(F.ceil(F.count("*") / task_rows).alias("blocks")))
        asked = asked.withColumn("lane", lane).join(load, "lane").withColumn("block", F.pmod(F.xxhash64("id", "h"), "blocks"))
        trees = (index.withColumn("lane", F.expr(f"shard div {shards}")).join(load, "lane")
                 .select("lane", "shard", "blob", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")))
        return (asked.select("id", "h", "v", "floor", "visit", "lane", "block").groupBy("lane", "block")
                .cogroup(trees.groupBy("lane", "block")).applyInPandas(search(first), found))

    near = stage(ask(queries.withColumn("floor", F.lit(float("-inf"))).withColumn("visit", F.array("shard")), 1, query_rows, True))
    onward = (near.select("id", "h", "floor", "visit").join(queries.select("id", "h", "v"), ["id", "h"])
              .select("id", "h", "v", "floor", F.explode("visit").alias("visit")))
    answers = near.select("id", "h", "ids", "scores").unionByName(ask(onward, lane_shards, query_rows * LANE_BLOCKS, False).select("id", "h", "ids", "scores"))
    pairs = answers.select("id", "h", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select(
        F.col("id").alias("query_id"), "h", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
