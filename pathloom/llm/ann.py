"""Approximate nearest neighbours by largest inner product: a robust-pruned directed graph per shard.

Rows with equal vectors are one point that stands for its ``TOP`` + 1 smallest ids, so a vector that a third of the
rows share is one node and ties are answered exactly. Points are dealt to shards by hash, ``SHARD`` points each on
average, whatever the input's size. A shard's graph is built in two passes: greedy beam searches, many points at a
time, propose neighbours; robust pruning keeps, nearest first, those that no kept one is nearer to by the factor
``RELAX``; edges are made mutual and pruned again. Inner products become distances by one more coordinate, the root of
the largest squared norm minus the point's own. A search walks a beam of ``BEAM`` points through every shard;
the shards' best are merged by exact scores in double precision on the original vectors.

Queries meet shards in blocks of ``BLOCK``, so a shard's search is spread over tasks. Recall against brute force is
measured in the tests.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; neither do rows without
vec_id; repeated rows count once; vectors of another length than the most frequent are left out; with fewer candidates
than ``TOP`` all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.session import cut

TOP = 20
SHARD = 4000
DEGREE, RELAX, BUILD_BEAM, BEAM = 32, 1.2, 48, 96
BLOCK = 512
SALT = 64


def points(embeddings: DataFrame) -> DataFrame:
    """(vec, ids): distinct usable vectors with their TOP + 1 smallest ids."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL").where(fine)
    size = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    rows = rows.where(F.size("vec") == (size[0]["size"] if size else 0)).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    # two levels: the smallest ids in each of SALT parts first, so a vector that very many rows share is no hot group
    few = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, TOP + 1)
    parts = rows.select("vec", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(SALT)).alias("part")).distinct()
    ranked = parts.withColumn("i", F.row_number().over(Window.partitionBy("vec", "part").orderBy("vec_id"))).where(F.col("i") <= TOP + 1)
    return ranked.groupBy("vec").agg(few(F.collect_list("vec_id")).alias("ids"))


def _norm2(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


class Graph:
    def __init__(self, x: np.ndarray, top: float):
        """x: points x coordinates; top: the largest squared norm of all points of all shards."""
        self.x = np.concatenate([x, np.sqrt(np.maximum(top - _norm2(x), 0))[:, None]], 1).astype(np.float32)
        self.sq = _norm2(self.x)
        n = len(x)
        self.entry = int(np.argmin(_norm2(self.x - self.x.mean(0))))
        rng = np.random.default_rng(n)
        self.edges = np.full((n, DEGREE), -1, np.int32)
        if n > 1:
            self.edges[:, : min(DEGREE, n - 1)] = (np.arange(n)[:, None] + 1 + rng.integers(0, n - 1, (n, min(DEGREE, n - 1)))) % n
        for relax in (1.0, RELAX):
            for block in np.array_split(rng.permutation(n), -(-n // 1000)):
                found, _ = self.search(self.x[block], BUILD_BEAM)
                pool = np.concatenate([found, self.edges[block]], 1)
                self.edges[block] = self.prune(block, pool, relax)
                self.mutual(block, relax)

    def dist(self, q: np.ndarray, qs: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its row of ids; absent ones are infinite."""
        out = qs[:, None] + self.sq[ids] - 2 * np.einsum("qd,qkd->qk", q, self.x[ids])
        out[ids < 0] = np.inf
        return out

    def prune(self, p: np.ndarray, pool: np.ndarray, relax: float) -> np.ndarray:
        """Robust pruning of each point's candidates."""
        pool = np.where(pool == p[:, None], -1, pool)
        pool = np.sort(pool, 1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
        d = self.dist(self.x[p], self.sq[p], pool)
        order = np.argsort(d, 1, kind="stable")
        pool, d = np.take_along_axis(pool, order, 1), np.take_along_axis(d, order, 1)
        width = min(pool.shape[1], 96)
        pool, d = pool[:, :width], d[:, :width]
        vec = self.x[pool]
        alive, out, count = pool >= 0, np.full((len(p), DEGREE), -1, np.int32), np.zeros(len(p), np.int64)
        rows = np.arange(len(p))
        while True:
            open_ = alive.any(1) & (count < DEGREE)
            if not open_.any():
                return out
            at = alive.argmax(1)
            pick, r = pool[rows, at], rows[open_]
            out[r, count[open_]] = pick[open_]
            count[open_] += 1
            chosen = vec[r, at[open_]]
            between = self.sq[pick[open_]][:, None] + self.sq[pool[r]] - 2 * np.einsum("qd,qkd->qk", chosen, vec[r])
            alive[r] &= relax * relax * between > d[r]
            alive[r, at[open_]] = False

    def mutual(self, block: np.ndarray, relax: float) -> None:
        """The block's edges the other way round as well; full rows are pruned again."""
        source = np.repeat(block, DEGREE)
        target = self.edges[block].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        each, first, count = np.unique(target, return_index=True, return_counts=True)
        width = min(int(count.max(initial=0)), 2 * DEGREE)
        extra = np.full((len(each), width), -1, np.int32)
        for j in range(width):
            has = count > j
            extra[has, j] = source[first[has] + j]
        for part in np.array_split(np.arange(len(each)), -(-max(len(each), 1) // 1000)):
            if len(part):
                self.edges[each[part]] = self.prune(each[part], np.concatenate([self.edges[each[part]], extra[part]], 1), relax)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query after no member is left to expand: ids (-1: none) and squared distances."""
        n, rows = len(self.x), np.arange(len(q))
        beam = min(beam, n)
        qs = _norm2(q)
        ids = np.full((len(q), beam), -1, np.int32)
        d = np.full((len(q), beam), np.inf, np.float32)
        done = np.zeros((len(q), beam), bool)
        seen = np.zeros((len(q), n), bool)
        ids[:, 0] = self.entry
        d[:, 0] = self.dist(q, qs, ids[:, :1])[:, 0]
        seen[:, self.entry] = True
        live = rows
        while len(live):
            wait = np.where(done[live] | (ids[live] < 0), np.inf, d[live])
            at = wait.argmin(1)
            go = wait[np.arange(len(live)), at] < np.inf
            live, at = live[go], at[go]
            if not len(live):
                break
            done[live, at] = True
            near = self.edges[ids[live, at]]
            near = np.where((near < 0) | seen[live[:, None], near], -1, near)
            r, c = np.nonzero(near >= 0)
            seen[live[r], near[r, c]] = True
            far = self.dist(q[live], qs[live], near)
            all_d = np.concatenate([d[live], far], 1)
            keep = np.argpartition(all_d, beam - 1, 1)[:, :beam]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), keep, 1)
            d[live] = np.take_along_axis(all_d, keep, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros_like(near, bool)], 1), keep, 1)
        return np.where(np.isfinite(d), ids, -1), d


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def build_rows(top: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("first")
        x = _matrix(group["vec"].combine_chunks())
        g = Graph(x, top)
        blob = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.table({"shard": [key[0].as_py()], "n": [len(x)], "entry": [g.entry], "x": blob(x), "edges": blob(g.edges), "point": [group["first"].to_pylist()]})

    return run


def search_rows(top: float, beam: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "point": [], "score": []}
        if left.num_rows and right.num_rows:
            n = right["n"][0].as_py()
            x = np.frombuffer(right["x"][0].as_buffer(), np.float64).reshape(n, -1)
            g = Graph.__new__(Graph)
            g.x = np.concatenate([x, np.sqrt(np.maximum(top - _norm2(x), 0))[:, None]], 1).astype(np.float32)
            g.sq, g.entry = _norm2(g.x), right["entry"][0].as_py()
            g.edges = np.frombuffer(right["edges"][0].as_buffer(), np.int32).reshape(n, DEGREE)
            q = _matrix(left["vec"].combine_chunks())
            point, who = np.array(right["point"][0].as_py()), left["query_id"].to_numpy()
            for a in range(0, len(q), BLOCK):
                part = q[a : a + BLOCK]
                unit = np.concatenate([part * np.sqrt(top) / np.sqrt(_norm2(part))[:, None], np.zeros((len(part), 1))], 1).astype(np.float32)
                ids, _ = g.search(unit, beam)
                exact = np.where(ids >= 0, np.einsum("qd,qkd->qk", part, x[ids]), -np.inf)
                order = np.argsort(-exact, 1, kind="stable")[:, : TOP + 1]
                for i, row in enumerate(order):
                    row = row[ids[i, row] >= 0]
                    out["query_id"] += [int(who[a + i])] * len(row)
                    out["point"] += point[ids[i, row]].tolist()
                    out["score"] += exact[i, row].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "point": pa.array(out["point"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


def nearest(embeddings: DataFrame, every: int = 20, beam: int = BEAM) -> DataFrame:
    """Per query (vec_id divisible by every): query_id, rank, vec_id, score of its TOP nearest other rows."""
    found = cut(points(embeddings))
    n, top = found.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).first()
    shards = max(1, -(-n // SHARD))
    first = F.element_at("ids", 1)
    dealt = found.select(F.pmod(F.xxhash64(first), F.lit(shards)).alias("shard"), first.alias("first"), "vec")
    built = cut(dealt.groupBy("shard").applyInArrow(build_rows(float(top or 0)), "shard long, n long, entry long, x binary, edges binary, point array<bigint>"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vec")).where(F.col("query_id") % every == 0)
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0))).dropDuplicates(["query_id", "vec"])
    asked = rows.join(found.select("vec"), "vec", "left_semi")
    # every block of queries goes to every shard: shards are few, and each pair is a task of its own
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // (every * BLOCK)))))
    spread = asked.select("query_id", "vec", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).withColumn("shard", F.col("shard").cast("long"))
    pairs = spread.select(F.col("block").alias("b"), F.col("shard").alias("s")).distinct()
    copies = built.join(pairs, F.col("shard") == F.col("s")).drop("shard")
    hits = spread.groupBy("block", "shard").cogroup(copies.groupBy("b", "s")).applyInArrow(search_rows(float(top or 0), beam), "query_id long, point long, score double")
    best = hits.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point"))).where(F.col("i") <= TOP + 1)
    ids = found.select(first.alias("point"), F.explode("ids").alias("vec_id"))
    named = best.join(ids, "point").where("vec_id <> query_id")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= TOP)
    return ranked.select("query_id", "rank", "vec_id", "score")
