"""Exact near-duplicate links between embeddings of one label, by PCA-ordered tiles.

Vectors are rotated so that leading dimensions carry most of the variance (any rotation
gives the same cosines; this one is fitted on a bounded sample) and packed, per label, into
tiles of bounded size: by the leaves of a tree of halves along the leading dimensions, fitted
on the same sample, and within a leaf by the first one.  Tiles whose boxes lie too far apart
are never compared.  A pair of tiles accumulates leading dimensions first: what is left of a
product is at most the product of the suffix norms, and a pair of rows is dropped as soon as
it cannot reach the threshold.  Equal vectors of a label are one row with a count.

A tile pair returns link counts and a root for each linked row, never the pairs themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.llm.common import connected_components, discard, staged
from latticeflow.llm.vectors import lists, matrix, unit

THRESHOLD = 0.93
TILE = 512
SAMPLE_ROWS = 4096
BOX_DIMS = 16
LEAF_SAMPLE = 8  # sampled rows of a leaf at least
STEPS = (8, 24)
SLACK = 1e-12


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns, in falling order of the sample's second moment along them."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(vectors[:, ::-1])


def halves(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Splits ``(dimension, value)`` of a full binary tree in heap order, along the widest of the leading dimensions."""
    out, level = [], [np.arange(len(sample))]
    for _ in range(depth):
        below = []
        for rows in level:
            lead = sample[rows, :BOX_DIMS]
            d = int(lead.var(0).argmax())
            cut = float(np.median(lead[:, d]))
            out.append((d, cut))
            below += [rows[lead[:, d] <= cut], rows[lead[:, d] > cut]]
        level = [r if len(r) else level[0][:1] for r in below]
    return out


def leaves(m: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(m), np.int64)
    dims, cuts = np.array([d for d, _ in splits], np.int64), np.array([c for _, c in splits])
    while len(splits) and len(m) and at[0] < len(splits):  # all rows are on one level
        at = 2 * at + 1 + (m[np.arange(len(m)), dims[at]] > cuts[at])
    return at - len(splits)


def _rotated(turn: np.ndarray, splits: list[tuple[int, float]]):
    dim = len(turn)

    def run(batches):
        for batch in batches:
            m = unit(matrix(batch.column("vector"), batch.column("dim")[0].as_py())) if batch.num_rows and len(set(batch.column("dim").to_pylist())) == 1 else None
            if m is None:
                rows = [unit(np.array([v], np.float64))[0] for v in batch.column("vector").to_pylist()]
                rows = [v @ turn if len(v) == dim else v for v in rows]
                vectors = pa.array(rows, pa.list_(pa.float64()))
                leaf = pa.array([int(leaves(v[None], splits)[0]) if len(v) == dim else 0 for v in rows], pa.int64())
                lead = pa.array([float(v[0]) for v in rows], pa.float64())
            else:
                m = m @ turn if m.shape[1] == dim else m
                leaf = pa.array(leaves(m, splits) if m.shape[1] == dim else np.zeros(len(m), np.int64))
                vectors, lead = lists(m), pa.array(m[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("dim"), batch.column("key"), batch.column("n"), leaf, lead, vectors], names=["label", "dim", "key", "n", "leaf", "lead", "vector"])

    return run


def _tiles(size: int):
    """Rows sorted by (label, dim, leaf, lead) packed into tiles."""
    names = ["label", "dim", "tile", "low", "high", "keys", "counts", "vectors"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]

    def run(batches):
        group, keys, counts, parts, held = None, [], [], [], 0

        def close():
            nonlocal keys, counts, parts, held
            if not held:
                return
            k, c, m = np.concatenate(keys), np.concatenate(counts), np.concatenate(parts)
            keys, counts, parts, held = [], [], [], 0
            for s in range(0, len(k), size):
                block = m[s : s + size]
                lead = block[:, :BOX_DIMS]
                row = (group[0], group[1], int(k[s]), lead.min(0), lead.max(0), k[s : s + size], c[s : s + size], block.reshape(-1))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            dim = batch.column("dim").to_numpy(zero_copy_only=False)
            heads = np.concatenate([[0], np.flatnonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1])) + 1, [len(label)]])
            for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
                if a == b:
                    continue
                if group != (int(label[a]), int(dim[a])) or held >= size:
                    yield from close()
                    group = (int(label[a]), int(dim[a]))
                part = batch.slice(a, b - a)
                keys.append(part.column("key").to_numpy(zero_copy_only=False))
                counts.append(part.column("n").to_numpy(zero_copy_only=False))
                parts.append(matrix(part.column("vector"), group[1]))
                held += b - a
        yield from close()

    return run


def links(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have a product of at least ``threshold``."""
    dim, at, total = a.shape[1], 0, np.zeros((len(a), len(b)))
    for step in (*(s for s in STEPS if s < dim), dim):
        total += a[:, at:step] @ b[:, at:step].T
        at = step
        if at == dim:
            break
        rest_a, rest_b = np.sqrt((a[:, at:] ** 2).sum(1)), np.sqrt((b[:, at:] ** 2).sum(1))
        alive = total + rest_a[:, None] * rest_b >= threshold - SLACK
        x, y = np.nonzero(alive)
        if not len(x):
            return alive
        if len(x) * 8 < alive.size:  # few enough to finish one by one, a slice at a time
            out = np.zeros_like(alive)
            for s in range(0, len(x), 1 << 16):
                i, j = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
                out[i, j] = total[i, j] + (a[i, at:] * b[j, at:]).sum(1) >= threshold
            return out
    return total >= threshold


def _compared(threshold: float):
    names = ["key", "n", "root"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c).slice(i, 1) for c in batch.schema.names}
                dim = row["dim"][0].as_py()
                keys, counts, m = ([row[c + s].flatten().to_numpy(zero_copy_only=False) for s in ("_a", "_b")] for c in ("keys", "counts", "vectors"))
                a, b = (v.reshape(-1, dim) for v in m)
                same = row["tile_a"][0].as_py() == row["tile_b"][0].as_py()
                link = links(a, b, threshold)
                if same:
                    np.fill_diagonal(link, False)
                of_a, of_b = link @ counts[1], counts[0] @ link
                root_a, root_b = keys[0].copy(), keys[1].copy()
                most = np.iinfo(np.int64).max
                while link.any():  # the smallest key spreads along the tile pair's links
                    new_b = np.minimum(root_b, np.where(link, root_a[:, None], most).min(0))
                    new_a = np.minimum(root_a, np.where(link, new_b, most).min(1))
                    if same:
                        new_a = new_b = np.minimum(new_a, new_b)
                    if (new_a == root_a).all() and (new_b == root_b).all():
                        break
                    root_a, root_b = new_a, new_b
                hit_a, hit_b = of_a > 0, (of_b > 0) & (not same)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in ((keys[0][hit_a], keys[1][hit_b]), (of_a[hit_a], of_b[hit_b]), (root_a[hit_a], root_b[hit_b]))], names=names
                )

    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for each row of ``rows``.

    Labels are whole numbers.  Vectors link when their labels are equal and not null and
    their cosine is at least ``threshold``.  Vectors that are null, zero, or hold null or non-finite components, and
    rows without an id, link with nothing; vectors of different lengths do not link.  Equal
    rows are vectors of their own that link with each other.  Other columns are not read.
    """
    spark = rows.sparkSession
    labelled = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("long").alias("label"))
    vector = F.col("v").cast("array<double>")
    ok = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    parts = F.col("id").isNotNull() & F.col("label").isNotNull() & ok & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    marked = labelled.select("id", "label", F.when(parts, vector).alias("vector"))
    seed = 0
    while True:  # keys name the distinct vectors: another seed, should two of them share one
        name = F.xxhash64("label", "vector", F.lit(seed)) if seed else F.xxhash64("label", "vector")
        classes = staged(
            marked.where("vector is not null").groupBy("label", "vector").agg(F.count("*").alias("n")).withColumn("key", name).withColumn("dim", F.size("vector")), "classes"
        )
        if not classes.groupBy("key").count().where("count > 1").limit(1).count():
            break
        discard(classes)
        seed += 1
    keyed = staged(marked.select("id", F.when(F.col("vector").isNotNull(), name).alias("key")), "keyed")
    dims = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        linked = spark.createDataFrame([], "key long, n long, root long")
    else:
        sample = classes.where(F.col("dim") == dims["dim"]).orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS).select("vector").toArrow()
        some = unit(matrix(sample.column("vector"), dims["dim"]))
        turn = rotation(some)
        tiles_wanted = min(dims["count"] // tile, len(some) // LEAF_SAMPLE)
        splits = halves(some @ turn, max(0, tiles_wanted.bit_length() - 1))
        turned = staged(classes.select("label", "dim", "key", "n", "vector").mapInArrow(_rotated(turn, splits), "label long, dim int, key long, n long, leaf long, lead double, vector array<double>"), "turned")
        tiles = staged(
            turned.repartitionByRange("label", "dim", "leaf", "lead", "key")
            .sortWithinPartitions("label", "dim", "leaf", "lead", "key")
            .mapInArrow(_tiles(tile), "label long, dim int, tile long, low array<double>, high array<double>, keys array<long>, counts array<long>, vectors array<double>"),
            "tiles",
        )
        boxes = tiles.select("label", "dim", "tile", "low", "high")
        x, y = boxes.alias("x"), boxes.alias("y")
        gap = "aggregate(sequence(0, size(x.low) - 1), 0D, (t, i) -> t + pow(greatest(0D, y.low[i] - x.high[i], x.low[i] - y.high[i]), 2))"
        pairs = x.join(y, F.expr(f"x.label = y.label and x.dim = y.dim and x.tile <= y.tile and {gap} <= {2 - 2 * threshold + 1e-9!r}D")).select(F.col("x.tile").alias("tile_a"), F.col("y.tile").alias("tile_b"), F.col("x.dim").alias("dim"))
        loads = {s: tiles.select(F.col("tile").alias(f"tile_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("keys", "counts", "vectors"))) for s in "ab"}
        loaded = pairs.repartition("tile_a", "tile_b").join(loads["a"], "tile_a").join(loads["b"], "tile_b")
        linked = staged(loaded.mapInArrow(_compared(threshold), "key long, n long, root long"), "linked")
    components = connected_components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())
    counts = linked.groupBy("key").agg(F.sum("n").alias("links"))
    smallest = keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    placed = smallest.join(components.withColumnRenamed("node", "key"), "key", "left").join(counts, "key", "left").select("key", "least", "copies", F.coalesce("component", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    roots = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(roots, "root").select("key", "component_id", (F.col("links") + F.col("copies") - 1).alias("links"))
    out = keyed.select("id", "key").join(named, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
