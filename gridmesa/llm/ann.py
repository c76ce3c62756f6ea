"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Equal vectors form one class, so a graph holds each vector once and no group of copies can crowd out its edges. Classes are
dealt into shards of bounded size. In a shard, points are inserted in batches: a greedy search from the medoid proposes
neighbours, relaxed pruning keeps an edge only if no kept one is nearer to its target by the factor ALPHA, and reverse edges are
pruned alike. Every block of queries beam-searches every shard; the shards' nearest classes merge by exact distance, and
classes expand to their members with the smallest ids.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components take no part, as query or
candidate; of the rest, only vectors of equal length are compared. Ties go to the smaller id. Rows that repeat an id are one candidate if
their vectors are equal. An empty table gives an empty result. Only named columns are returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmesa.llm.common import written

DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, BATCH = 32, 64, 96, 1.2, 256
#: Vectors in a shard and queries in a block, about.
SHARD, BLOCK = 32_768, 32_768


class Graph:
    """A robust-pruned graph over points (n x d, float64)."""

    def __init__(self, points: np.ndarray, seed: int = 5):
        self.points = points
        self.norms = (points**2).sum(1)
        #: Points whose distance some search has computed, each counted once a search.
        self.visited = 0
        n = len(points)
        rng = np.random.default_rng(seed)
        self.neighbours = np.full((n, DEGREE), -1, np.int64)
        if n > 1:
            start = (np.arange(n)[:, None] + rng.integers(1, n, (n, min(DEGREE // 2, n - 1)))) % n
            self.neighbours[:, : start.shape[1]] = start
        self.entry = int(((points - points.mean(0)) ** 2).sum(1).argmin()) if n else 0
        for alpha in (1.0, ALPHA):
            order = rng.permutation(n)
            for at in range(0, n, BATCH):
                self._insert(order[at : at + BATCH], alpha)

    def _squared(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances from queries (b x d) to points ids (b x m)."""
        return np.maximum(0, (queries**2).sum(1)[:, None] + self.norms[ids] - 2 * np.einsum("bd,bmd->bm", queries, self.points[ids]))

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query, nearest first, as ids (-1: none) and squared distances."""
        b, n = len(queries), len(self.points)
        rows = np.arange(b)
        ids, dist, done = np.full((b, beam), -1), np.full((b, beam), np.inf), np.ones((b, beam), bool)
        ids[:, 0], done[:, 0] = self.entry, False
        dist[:, 0] = self._squared(queries, ids[:, :1])[:, 0]
        seen = np.zeros((b, n), bool)
        seen[:, self.entry] = True
        while True:
            open_ = np.where(done, np.inf, dist)
            pick = open_.argmin(1)
            active = np.flatnonzero(np.isfinite(open_[rows, pick]))
            if not len(active):
                self.visited += int(seen.sum())
                return ids, dist
            done[active, pick[active]] = True
            near = self.neighbours[ids[active, pick[active]]]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            near = np.where(near >= 0, near, 0)
            d = np.where(fresh, self._squared(queries[active], near), np.inf)
            where = np.nonzero(fresh)
            seen[active[where[0]], near[where]] = True
            all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], 1)
            all_dist = np.concatenate([dist[active], d], 1)
            all_done = np.concatenate([done[active], ~fresh], 1)
            best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            ids[active], dist[active], done[active] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_dist, all_done))

    def _prune(self, owners: np.ndarray, ids: np.ndarray, alpha: float) -> np.ndarray:
        """Of each owner's candidates (b x m, -1: none), at most DEGREE, none made needless by a kept nearer one."""
        ids = np.where(ids == owners[:, None], -1, ids)
        ranked = np.sort(ids, axis=1)
        ids = np.where(np.concatenate([np.zeros((len(ids), 1), bool), ranked[:, 1:] == ranked[:, :-1]], 1), -1, ranked)
        dist = np.where(ids >= 0, self._squared(self.points[owners], np.maximum(ids, 0)), np.inf)
        order = np.argsort(dist, axis=1, kind="stable")[:, : 4 * DEGREE]
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        own = self.points[np.maximum(ids, 0)]
        size = (own**2).sum(2)
        between = np.maximum(0, size[:, :, None] + size[:, None, :] - 2 * own @ own.transpose(0, 2, 1))
        alive = np.isfinite(dist)
        out, rows = np.full((len(ids), DEGREE), -1, np.int64), np.arange(len(ids))
        for slot in range(DEGREE):
            pick = alive.argmax(1)
            some = alive[rows, pick]
            if not some.any():
                break
            out[some, slot] = ids[rows, pick][some]
            alive &= (alpha * alpha * between[rows, pick] > dist) | ~some[:, None]
            alive[rows, pick] = False
        return out

    def _insert(self, batch: np.ndarray, alpha: float) -> None:
        ids, _ = self.search(self.points[batch], BUILD_BEAM)
        self.neighbours[batch] = self._prune(batch, np.concatenate([ids, self.neighbours[batch]], 1), alpha)
        source = np.repeat(batch, DEGREE)
        target = self.neighbours[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        to, head, count = np.unique(target, return_index=True, return_counts=True)
        if not len(to):
            return
        extra = np.full((len(to), count.max()), -1, np.int64)
        extra[np.repeat(np.arange(len(to)), count), np.arange(len(target)) - np.repeat(head, count)] = source
        for at in range(0, len(to), BATCH):
            part = slice(at, at + BATCH)
            self.neighbours[to[part]] = self._prune(to[part], np.concatenate([self.neighbours[to[part]], extra[part]], 1), alpha)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _packed(schema_key: str):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        return pd.DataFrame({schema_key: [pdf[schema_key].iloc[0]], "dim": [pdf.dim.iloc[0]], "ids": [pdf.rep.to_numpy(np.int64).tobytes()], "vectors": [np.stack(pdf.vector.to_list()).astype(np.float64).tobytes()]})

    return pack


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    out = _packed("shard")(pdf)
    graph = Graph(np.frombuffer(out.vectors[0]).reshape(-1, out.dim[0]))
    return out.assign(entry=graph.entry, neighbours=[graph.neighbours.astype(np.int32).tobytes()])


def build(classes: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """One row per shard: its classes' ids and vectors, and the graph over them. classes: rep, vector, dim."""
    shards = max(1, -(-classes.count() // shard_size))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)))
    return dealt.groupBy("shard", "dim").applyInPandas(_index, "shard long, dim int, ids binary, vectors binary, entry int, neighbours binary")


def _search(batches, k: int, beam: int):
    for batch in batches:
        for r in batch.itertuples():
            graph = Graph.__new__(Graph)
            graph.points = np.frombuffer(r.vectors).reshape(-1, r.dim)
            graph.norms, graph.entry, graph.visited = (graph.points**2).sum(1), r.entry, 0
            graph.neighbours = np.frombuffer(r.neighbours, np.int32).reshape(-1, DEGREE).astype(np.int64)
            ids, queries, of = np.frombuffer(r.ids, np.int64), np.frombuffer(r.query_vectors).reshape(-1, r.dim), np.frombuffer(r.query_ids, np.int64)
            for at in range(0, len(queries), BATCH):
                own = queries[at : at + BATCH]
                found, _ = graph.search(own, max(beam, k))
                exact = np.where(found >= 0, np.sqrt(((own[:, None] - graph.points[np.maximum(found, 0)]) ** 2).sum(2)), np.inf)
                named = np.where(found >= 0, ids[np.maximum(found, 0)], np.iinfo(np.int64).max)
                best = np.lexsort((named, exact))[:, :k]
                q = np.repeat(of[at : at + BATCH], best.shape[1])
                d = np.take_along_axis(exact, best, 1).ravel()
                keep = np.isfinite(d)
                yield pd.DataFrame({"query_rep": q[keep], "rep": np.take_along_axis(named, best, 1).ravel()[keep], "score": d[keep]})


def search(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, beam: int = SEARCH_BEAM, shard_size: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for each row for which `queries` holds."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asked")).where(usable(F.col("vector")) & F.col("id").isNotNull())
    classes = written(rows.groupBy("vector").agg(F.min("id").alias("rep")).withColumn("dim", F.size("vector")), "classes")
    named = rows.join(classes, "vector")
    # Each class needs its k + 1 smallest members, one of which may be the query; the limit holds before the shuffle too.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    first = rows.select("vector", "id").distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    members = written(first.join(classes, "vector").select("rep", F.col("id").alias("vec_id")), "members")
    asked = written(named.where("asked").select(F.col("id").alias("query_id"), F.col("rep").alias("query_rep")).distinct(), "queries")
    wanted = classes.join(asked.select(F.col("query_rep").alias("rep")).distinct(), "rep", "left_semi")
    blocks = max(1, -(-wanted.count() // BLOCK))
    packed = wanted.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks))).groupBy("block", "dim").applyInPandas(_packed("block"), "block long, dim int, ids binary, vectors binary")
    packed = packed.select("block", F.col("dim").alias("query_dim"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    graphs = written(build(classes, shard_size), "graphs").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    tasks = graphs.join(packed, "block").where("dim = query_dim").repartition("shard", "block")
    found = tasks.mapInPandas(lambda it: _search(it, k + 1, beam), "query_rep long, rep long, score double")
    near = Window.partitionBy("query_rep").orderBy("score", "rep")
    merged = found.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1).drop("n")
    of_query = merged.join(asked, "query_rep").join(members, "rep").where("vec_id != query_id")
    last = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return of_query.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
