"""Nearest neighbours by cosine with vantage-point trees.

A top tree, fitted on a bounded sample, deals every row into cells by distance to vantage
points; a cell is cut into shards of bounded size, and each shard builds its own tree.
Chord distance between unit vectors is a metric that orders as cosine does, so the triangle
inequality prunes both levels.  ``factor`` scales the search radius in these tests: below
one it prunes harder and may miss neighbours; one restores exact search.

A query first searches its home cell, which gives its radius, then the other cells the
radius reaches.  Queries travel to shards in blocks; rows never meet rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticeflow.llm.common import staged
from latticeflow.llm.vectors import cosine, matrix, unit, usable

SAMPLE_ROWS = 4096
SHARD_ROWS = 4096
CELL_SAMPLE = 4  # sampled rows that a cell of the top tree has at least
LEAF = 64
QUERY_BLOCK = 256
PAIRS = 1 << 15  # pairs whose exact cosines are computed at once
SLACK = 1e-9


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


class Tree:
    """A vantage-point tree over unit rows; leaves hold index arrays."""

    def __init__(self, units: np.ndarray, leaf: int, depth: int = 64):
        self.vantage, self.radius, self.child, self.leaves = [], [], [], []
        self.units = units
        self.root = self._build(np.arange(len(units)), leaf, depth, 1)

    def _build(self, rows: np.ndarray, leaf: int, depth: int, seed: int) -> int:
        if len(rows) > leaf and depth:
            v = self.units[rows[(seed * 2654435761) % len(rows)]]
            d = _chord(self.units[rows] @ v)
            r = float(np.median(d))
            inner = d <= r
            if inner.all():  # a median shared by the farthest rows
                inner = d < r
            if inner.any() and not inner.all():
                at = len(self.vantage)
                self.vantage.append(v)
                self.radius.append(float(d[inner].max()) if inner.any() else r)
                self.child.append(None)
                self.child[at] = (self._build(rows[inner], leaf, depth - 1, seed * 2), self._build(rows[~inner], leaf, depth - 1, seed * 2 + 1), float(d[~inner].min()))
                return at
        self.leaves.append(rows)
        return -len(self.leaves)

    def arrays(self):
        return self.root, self.vantage, self.radius, self.child, len(self.leaves)


def search(tree: Tree, ids: np.ndarray, given: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``k`` best rows, by :func:`cosine` of the vectors ``given``, ties to the smaller id: ``(query, row, score)``.

    Products of unit vectors lead the way; every row whose product is within ``SLACK`` of the
    ``k``-th is then scored exactly, however many there are.
    """
    units = unit(queries)
    best = np.full((len(units), k), -np.inf)
    tau = radius.copy()
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def visit(node: int, q: np.ndarray) -> None:
        if not len(q):
            return
        if node < 0:
            rows = tree.leaves[-node - 1]
            for s in range(0, len(rows), 4096):
                part = rows[s : s + 4096]
                found = units[q] @ tree.units[part].T
                found[ids[part] == query_ids[q][:, None]] = -np.inf
                near = np.nonzero(found >= best[q, k - 1][:, None] - SLACK)
                kept.append((q[near[0]], part[near[1]], found[near]))
                best[q] = -np.partition(-np.concatenate([best[q], found], 1), k - 1, axis=1)[:, :k]
                best[q] = -np.sort(-best[q], axis=1)
            tau[q] = np.minimum(tau[q], np.where(best[q, k - 1] > -2, _chord(best[q, k - 1]) + 1e-6, np.inf))
            return
        d = _chord(units[q] @ tree.vantage[node])
        inner, outer, beyond = tree.child[node]
        r = tree.radius[node]
        near = d <= (r + beyond) / 2
        visit(inner, q[near])
        visit(outer, q[~near])
        reach = tau[q] * factor
        visit(outer, q[near & (d + reach >= beyond)])
        visit(inner, q[~near & (d - reach <= r)])

    visit(tree.root, np.arange(len(units)))
    who, row, value = (np.concatenate([part[i] for part in kept] or [np.empty(0, (np.int64, np.int64, float)[i])]) for i in range(3))
    fine = (value > -2) & (value >= best[who, k - 1] - SLACK) if len(who) else np.zeros(0, bool)
    who, row = who[fine], row[fine]
    score = np.concatenate([cosine(queries[who[s : s + PAIRS]], given[row[s : s + PAIRS]]) for s in range(0, len(who), PAIRS)] or [np.empty(0)])
    order = np.lexsort((ids[row], -score, who))
    who, row, score = who[order], row[order], score[order]
    first = np.searchsorted(who, who)
    top = np.arange(len(who)) - first < k
    return who[top], row[top], score[top]


def _route(top, dim: int):
    """Home cell of each row."""

    def run(batches):
        root, vantage, radius, child, _ = top
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            cell = -dims.astype(np.int64)
            own = np.flatnonzero(dims == dim)
            if len(own):
                m = unit(matrix(batch.column("vector").take(pa.array(own)), dim))
                at = np.full(len(own), root)
                while (inside := np.flatnonzero(at >= 0)).size:
                    for node in np.unique(at[inside]):
                        g = inside[at[inside] == node]
                        inner, outer, beyond = child[node]
                        d = _chord(m[g] @ vantage[node])
                        at[g] = np.where(d <= (radius[node] + beyond) / 2, inner, outer)
                cell[own] = -at - 1
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), batch.column("dim"), pa.array(cell)], names=["id", "vector", "dim", "cell"])

    return run


def _reached(top, dim: int, factor: float):
    """The cells, other than its own, that a query's radius reaches."""

    def run(batches):
        root, vantage, radius, child, _ = top
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            own = np.flatnonzero(dims == dim)
            part = batch.take(pa.array(own))
            if not len(own):
                continue
            m = unit(matrix(part.column("vector"), dim))
            home = part.column("cell").to_numpy(zero_copy_only=False)
            reach = part.column("radius").to_numpy(zero_copy_only=False) * factor
            stack, rows, cells = [(root, np.arange(len(own)))], [], []
            while stack:
                node, q = stack.pop()
                if not len(q):
                    continue
                if node < 0:
                    q = q[home[q] != -node - 1]
                    rows.append(q)
                    cells.append(np.full(len(q), -node - 1, np.int64))
                    continue
                inner, outer, beyond = child[node]
                cut = (radius[node] + beyond) / 2
                d = _chord(m[q] @ vantage[node])
                stack.append((inner, q[d - reach[q] <= cut]))
                stack.append((outer, q[d + reach[q] >= cut]))
            at = np.concatenate(rows) if rows else np.empty(0, np.int64)
            took = part.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([took.column("id"), took.column("vector"), took.column("dim"), pa.array(np.concatenate(cells) if cells else at), took.column("radius")], names=["id", "vector", "dim", "cell", "radius"])

    return run


def _searched(k: int, factor: float, leaf: int):
    """Streams of (shard, rows first, then queries): each shard's tree answers its queries block by block."""
    names = ["query_id", "vec_id", "score"]

    def run(batches):
        shard, rows, tree, ids, given, pending, held = None, [], None, None, None, [], 0

        def answer():
            nonlocal tree, ids, given, pending, held
            if not pending or (tree is None and not rows):
                pending, held = [], 0
                return
            if tree is None:
                ids, given = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
                tree = Tree(unit(given), leaf)
            q_ids, q, radius = (np.concatenate([p[i] for p in pending]) for i in range(3))
            pending, held = [], 0
            for s in range(0, len(q), QUERY_BLOCK):
                block = slice(s, s + QUERY_BLOCK)
                at, row, score = search(tree, ids, given, q[block], q_ids[block], k, factor, radius[block])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[block][at]), pa.array(ids[row]), pa.array(score)], names=names)

        for batch in batches:
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            if not len(shards):
                continue
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            heads = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            heads = np.concatenate([[0], heads, [len(shards)]])
            for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
                if shards[a] != shard:
                    yield from answer()
                    shard, rows, tree = int(shards[a]), [], None
                part = batch.slice(a, b - a)
                m = matrix(part.column("vector"), part.column("dim")[0].as_py())
                own = part.column("id").to_numpy(zero_copy_only=False)
                if asks[a]:
                    pending.append((own, m, part.column("radius").to_numpy(zero_copy_only=False)))
                    held += len(own)
                    if held >= 16 * QUERY_BLOCK:
                        yield from answer()
                else:
                    rows.append((own, m))
        yield from answer()

    return run


def nearest(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows nearest to each query, not counting rows of its own id.

    Nearness is cosine in double precision; ties go to the smaller id.  Rows without an id
    and vectors that are null, zero or hold null or non-finite components take no part, and
    vectors of another length are not compared.  Of identical vectors the ``k + 1`` smallest
    ids are kept, which loses no result.  An id that asks with several vectors asks with the
    smallest.  The top tree is fitted on ``SAMPLE_ROWS`` rows (those with the smallest
    hashes), so that it has ``SAMPLE_ROWS / CELL_SAMPLE`` cells at most; every row is indexed,
    and a cell of many rows is cut into as many shards as it needs.
    """
    spark = rows.sparkSession
    data = usable(rows, id_col, vector_col).dropDuplicates(["id", "vector"])
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    data = staged(data.withColumn("n", first).where(F.col("n") <= k + 1).drop("n"), "vectors")
    asked = usable(queries, id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    total = data.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = data.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()["dim"]
    sample = data.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vector").toArrow()
    units = unit(matrix(sample.column("vector"), dim))
    cells = max(1, min(total // shard_rows, len(units) // CELL_SAMPLE))
    top = Tree(units, max(1, len(units) // cells)).arrays()
    schema = "id long, vector array<double>, dim int, cell long"
    homed = staged(data.mapInArrow(_route(top, dim), schema), "homed")
    salts = homed.groupBy("cell").agg((F.floor(F.count("*") / shard_rows) + 1).alias("salts"))
    dealt = homed.join(salts, "cell").select("id", "vector", "dim", F.xxhash64("cell", F.pmod(F.xxhash64("id"), "salts")).alias("shard"))

    def ask(q: DataFrame) -> DataFrame:
        spread = q.join(salts, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        asks = spread.select("id", "vector", "dim", F.xxhash64("cell", "salt").alias("shard"), "radius", F.lit(True).alias("asks"))
        both = dealt.select("id", "vector", "dim", "shard", F.lit(0.0).alias("radius"), F.lit(False).alias("asks")).unionByName(asks)
        return both.repartition("shard").sortWithinPartitions("shard", "asks", "id").mapInArrow(_searched(k, factor, LEAF), "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    homes = asked.mapInArrow(_route(top, dim), schema)
    near = staged(ask(homes.withColumn("radius", F.lit(float("inf")))), "near")
    kth = best(near).groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("least")).select(
        F.col("query_id").alias("id"), F.when(F.col("c") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))) + F.lit(1e-6)).alias("radius")
    )
    wide = homes.join(kth, "id", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
    far = ask(wide.mapInArrow(_reached(top, dim, factor), f"{schema}, radius double"))
    found = best(near.unionByName(far))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
