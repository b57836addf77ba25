"""Approximate nearest neighbours: one navigable small-world graph per shard.

Vectors are dealt to shards by hash, each shard builds a
hierarchical graph whose links are flat integer arrays, and the index is a table with one
row per shard and kind of array.  A search sends blocks of query vectors to every shard and
merges the shards' answers by exact distance in double precision.

A shard has about ``SHARD_SIZE`` vectors while there are at most ``MOST_SHARDS`` shards, and
up to ``LARGEST_SHARD`` after that, so that few rows and many send a query to about as many shards.
A search keeps more nodes in a larger graph, by the root of its size, for the same recall.

Rows with equal vectors share one graph node, which keeps the ``k + 1`` smallest ids: no
further copy can be among the ``k`` nearest of any query.  Vectors that are null, empty,
zero or hold null or non-finite values take no part.  Vectors of different lengths are
never compared.  Rows repeated in id and vector count once.  Shards no larger than
``EXHAUSTIVE`` are scanned whole.
"""

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from voxloom.llm.common import kept
from voxloom.scratch import spread

SHARD_SIZE = 4096
MOST_SHARDS, LARGEST_SHARD = 32, 65536
QUERY_BLOCK = 1024
EXHAUSTIVE = 256
LINKS = 16  # per node and upper layer; twice as many on the ground layer
WIDTH_BUILD, WIDTH_SEARCH = 80, 96
SEED = 8


class Graph:
    """Layers of links: ``links[l]`` is a matrix of neighbours, padded with -1; its rows are
    the first ``len(links[l])`` nodes, which are the nodes that reach layer ``l``."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.links = vectors, links

    def distances(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        d = self.vectors[nodes] - q
        return np.einsum("ij,ij->i", d, d)

    def search_layer(self, q, entry: list[tuple[float, int]], width: int, layer: int):
        """The ``width`` nearest found from ``entry`` on, as sorted (distance, node)."""
        links = self.links[layer]
        seen = np.zeros(len(links), bool)
        seen[[n for _, n in entry]] = True
        todo, best = list(entry), [(-d, n) for d, n in entry]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, node = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            near = links[node]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            found = self.distances(q, near)
            if len(best) >= width:
                close = found < -best[0][0]
                near, found = near[close], found[close]
            for x, n in zip(found.tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-x, n))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, n))
                else:
                    continue
                heapq.heappush(todo, (x, n))
        return sorted((-d, n) for d, n in best)

    def descend(self, q, layer: int):
        entry = [(float(self.distances(q, np.array([0]))[0]), 0)]
        for upper in range(len(self.links) - 1, layer, -1):
            entry = self.search_layer(q, entry, 1, upper)
        return entry

    def search(self, q: np.ndarray, k: int, width: int | None = None) -> list[tuple[float, int]]:
        width = width or int(WIDTH_SEARCH * max(1.0, math.sqrt(len(self.vectors) / SHARD_SIZE)))
        if len(self.vectors) <= EXHAUSTIVE:
            d = self.distances(q, np.arange(len(self.vectors)))
            order = np.argsort(d, kind="stable")[:k]
            return list(zip(d[order].tolist(), order.tolist()))
        return self.search_layer(q, self.descend(q, 0), max(width, k), 0)[:k]

    def choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Spread links out: take a node unless one taken before is nearer to it."""
        nodes = np.array([n for _, n in found])
        v = self.vectors[nodes]
        norms = np.einsum("ij,ij->i", v, v)
        apart = norms[:, None] + norms[None, :] - 2 * (v @ v.T)
        nearest = np.full(len(nodes), np.inf)
        taken: list[int] = []
        for i, (d, _) in enumerate(found):
            if d <= nearest[i]:
                taken.append(i)
                if len(taken) == most:
                    break
                np.minimum(nearest, apart[i], out=nearest)
        if len(taken) < most:
            own = set(taken)
            taken += [i for i in range(len(found)) if i not in own][: most - len(taken)]
        return nodes[taken].tolist()


def build_graph(vectors: np.ndarray, seed: int = SEED) -> Graph:
    """Insert nodes one by one.  Layers are drawn first and nodes numbered from the top, so
    that a layer's nodes are a prefix and node 0 is the entry."""
    n = len(vectors)
    draws = np.random.default_rng(seed).random(n)
    levels = np.sort((-np.log(1 - draws) / math.log(LINKS)).astype(int))[::-1]
    sizes = [int((levels >= layer).sum()) for layer in range(int(levels[0]) + 1)]
    graph = Graph(vectors, [np.full((s, LINKS * (2 if i == 0 else 1)), -1, np.int32) for i, s in enumerate(sizes)])
    if n <= EXHAUSTIVE:
        return graph
    used = [np.zeros(s, np.int32) for s in sizes]
    for node in range(1, n):
        q, level = vectors[node], int(levels[node])
        entry = graph.descend(q, level)
        for layer in range(min(level, len(sizes) - 1), -1, -1):
            entry = graph.search_layer(q, entry, WIDTH_BUILD, layer)
            links, count = graph.links[layer], used[layer]
            most = links.shape[1]
            mine = graph.choose(entry, LINKS)
            links[node, : len(mine)], count[node] = mine, len(mine)
            for other in mine:
                if count[other] < most:
                    links[other, count[other]] = node
                    count[other] += 1
                else:
                    near = np.append(links[other], node)
                    d = graph.distances(vectors[other], near)
                    order = np.argsort(d, kind="stable")
                    kept_links = graph.choose(list(zip(d[order].tolist(), near[order].tolist())), most)
                    links[other] = -1
                    links[other, : len(kept_links)] = kept_links
                    count[other] = len(kept_links)
    return graph


def _valid(vector: str):
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """node (the smallest id), v, ids: one row per distinct vector with its k + 1 smallest ids."""
    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    # -0.0 and 0.0 are one value
    usable = usable.where(F.col("id").isNotNull() & _valid("v")).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    order = Window.partitionBy("v").orderBy("id")
    return (
        usable.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.element_at("ids", 1).alias("node"), "v", "ids")
    )


def shard_count(count: int, shard_size: int = SHARD_SIZE) -> int:
    size = max(shard_size, min(-(-count // MOST_SHARDS), LARGEST_SHARD))
    return max(1, -(-count // size))


def build_index(distinct: DataFrame, shard_size: int = SHARD_SIZE) -> tuple[DataFrame, int]:
    """Rows (dim, shard, nodes, ids, vectors, links): the arrays as bytes; and the shard count."""
    shards = shard_count(distinct.count(), shard_size)

    def build(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        order = np.random.default_rng(SEED).permutation(len(frame))
        frame = frame.iloc[order]
        graph = build_graph(np.array(frame["v"].tolist(), np.float64))
        return pd.DataFrame(
            {
                "dim": [key[0]], "shard": [key[1]], "size": [len(frame)],
                "ids": [[list(map(int, x)) for x in frame["ids"]]],
                "vectors": [graph.vectors.tobytes()], "links": [[x.tobytes() for x in graph.links]],
            }
        )

    dealt = distinct.select(
        F.size("v").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "v", "ids"
    )
    built = spread(dealt, "dim", "shard").groupBy("dim", "shard").applyInPandas(  # a shard is long work on few bytes
        build, "dim int, shard int, size int, ids array<array<long>>, vectors binary, links array<binary>"
    )
    return kept(built, "hnsw-index"), shards


def _open(row) -> Graph:
    vectors = np.frombuffer(row.vectors, np.float64).reshape(row.size_, row.dim)
    links = [np.frombuffer(x, np.int32).reshape(-1, LINKS * (2 if i == 0 else 1)) for i, x in enumerate(row.links)]
    return Graph(vectors, links)


def search_index(index: DataFrame, shards: int, queries: DataFrame, k: int) -> DataFrame:
    """node, id, score: the ids of the nearest vectors each shard finds for ``queries(node, v)``."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(blocks))
    sent = (
        queries.groupBy(F.size("v").alias("dim"), block.alias("block"))
        .agg(F.collect_list("node").alias("nodes"), F.collect_list("v").alias("vs"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )

    def search(frames):
        for frame in frames:
            for row in frame.rename(columns={"size": "size_"}).itertuples(index=False):
                graph, out = _open(row), []
                for node, v in zip(row.nodes, row.vs):
                    # ties of the last place may stand behind it: ask for some more
                    for _, at in graph.search(np.asarray(v, np.float64), 2 * (k + 1)):
                        d = float(np.sqrt(np.square(graph.vectors[at] - v).sum()))
                        out += [(node, i, d) for i in row.ids[at]]
                yield pd.DataFrame(out, columns=["node", "id", "score"])

    met = spread(index, "dim", "shard").join(spread(sent, "dim", "shard"), ["dim", "shard"])
    return met.mapInPandas(search, "node long, id long, score double")


def nearest(rows: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for all queries, the rows whose id ``every`` divides."""
    distinct = kept(distinct_vectors(rows, id_col, vector, k), "vectors")
    index, shards = build_index(distinct)
    asked = (
        rows.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
        .where((F.col("query_id") % every == 0) & _valid("v")).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
        .distinct().join(distinct.select("v", "node"), "v")
    )
    asked = kept(asked.select("query_id", "node"), "queries")
    queries = distinct.select("node", "v").join(asked.select("node").distinct(), "node")
    found = search_index(index, shards, queries, k)
    best = Window.partitionBy("node").orderBy("score", "id")
    short = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    mine = Window.partitionBy("query_id").orderBy("score", "id")
    return (
        asked.join(short, "node").where("id <> query_id")
        .withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    )
