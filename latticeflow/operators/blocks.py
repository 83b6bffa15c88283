"""Watershed of nodes that carry their neighbours, block by block.

Nodes are dealt to blocks of equal size along a space-filling curve, so that few edges leave a
block.  Each block descends on its own: a node's label is the root it reaches, or the first node
of another block on its way.  What is left of the graph are labels, the ends of edges between
blocks, and for each pair of touching labels their lowest crossing; paths between blocks are
followed among those only.  Results do not depend on the blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.operators import graph as G
from latticeflow.operators.stage import kept

BLOCK_NODES = 1 << 16
BITS = 10  # of each coordinate, in the order along the curve

#: Rows of nodes, ``nxt`` their label; and of links between labels ``(id, nxt)``, whose ``border`` is null and ``dens`` their level.
CONTRACTED = "id long, nxt long, border boolean, dens double, vol double, x double, y double, z double"


def curve(length: float) -> Column:
    """Place along a Z-order curve through the box."""
    out = F.lit(0).cast("long")
    for a, axis in enumerate("xyz"):
        cell = F.least(F.greatest(F.floor(F.col(axis) / length * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")
        for bit in range(BITS):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1)), 3 * bit + a))
    return out


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _leaving(batches):
    """Edges whose other end is not in the same partition."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    known = np.sort(np.concatenate([b.column("id").to_numpy() for b in batches]))
    for batch in batches:
        lists = batch.column("neighbours")
        src = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        dst = lists.flatten().to_numpy()
        away = known[np.minimum(np.searchsorted(known, dst), len(known) - 1)] != dst
        src, dst = src[away], dst[away]
        yield pa.RecordBatch.from_arrays([batch.column("block").take(pa.array(src)), batch.column("id").take(pa.array(src)), batch.column("dens").take(pa.array(src)), pa.array(dst, pa.int64())], names=["block", "src", "d", "dst"])


def _contract(nodes: pa.Table, halo: pa.Table) -> pa.Table:
    """Rows of ``CONTRACTED`` of a block; ``halo (own, far, d)`` has the edges to other blocks from their end here."""
    nodes = nodes.sort_by("id")
    ids, dens = _numbers(nodes, "id"), _numbers(nodes, "dens")
    m = len(ids)
    if not m:
        return pa.table({n: pa.array([], t) for n, t in zip(("id", "nxt", "border", "dens", "vol", "x", "y", "z"), [pa.int64()] * 2 + [pa.bool_()] + [pa.float64()] * 5)})

    def place(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(ids, of), m - 1)
        return at, ids[at] == of

    lists = nodes["neighbours"].combine_chunks()
    src = np.repeat(np.arange(m), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    dst, inside = place(lists.flatten().to_numpy())
    src, dst = src[inside], dst[inside]
    pairs = np.unique(np.minimum(src, dst) * m + np.maximum(src, dst))  # an edge seen from one side only counts for both
    a, b = pairs // m, pairs % m
    own, far, beyond = place(_numbers(halo, "own"))[0], _numbers(halo, "far"), _numbers(halo, "d")

    src, to, level = np.concatenate([a, b, own]), np.concatenate([ids[b], ids[a], far]), np.concatenate([dens[b], dens[a], beyond])
    down = level < dens[src]
    src, to, level = src[down], to[down], level[down]
    order = np.lexsort((to, level, src))
    src, to = src[order], to[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(src)), bool), src[1:] != src[:-1]]))
    nxt = ids.copy()
    nxt[src[first]] = to[first]
    at, here = place(nxt)
    path = np.where(here, at, np.arange(m))
    while not np.array_equal(path, further := path[path]):
        path = further
    label = nxt[path]
    border = np.zeros(m, bool)
    border[own] = True

    once = ids[own] < far  # the other block has the same edge
    own, far, beyond = own[once], far[once], beyond[once]
    u, v = np.concatenate([label[a], label[own]]), np.concatenate([label[b], far])
    level = np.concatenate([np.maximum(dens[a], dens[b]), np.maximum(dens[own], beyond)])
    apart = u != v
    u, v, level = np.minimum(u, v)[apart], np.maximum(u, v)[apart], level[apart]
    order = np.lexsort((level, v, u))
    u, v, level = u[order], v[order], level[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(u)), bool), (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))
    links = [pa.array(u[first]), pa.array(v[first]), pa.nulls(len(first), pa.bool_()), pa.array(level[first]), *(pa.nulls(len(first), pa.float64()) for _ in range(4))]
    names = ["id", "nxt", "border", "dens", "vol", "x", "y", "z"]
    return pa.concat_tables([pa.table([pa.array(ids), pa.array(label), pa.array(border), *(nodes[c].cast(pa.float64()).combine_chunks() for c in names[3:])], names=names), pa.table(links, names=names)])


def blocks_of(nodes: DataFrame, count: int) -> int:
    return 1 + max(count // BLOCK_NODES, min(count // 4096, 2 * nodes.sparkSession.sparkContext.defaultParallelism))


def watershed(nodes: DataFrame, length: float, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, root, zone, dens, vol, x, y, z)`` and saddles ``(h, h2, slv)`` of ``nodes (id, dens, vol, neighbours, x, y, z)``.

    The same as ``jumpers``, ``roots``, ``zones`` and ``saddles`` of :mod:`graph` give on the
    symmetric edges, but only edges between blocks are ever rows.
    """
    if blocks is None:
        blocks = blocks_of(nodes, nodes.count())
    own = nodes.select("id", "dens", "vol", "neighbours", "x", "y", "z")
    own = kept(own.repartitionByRange(blocks, curve(length)).withColumn("block", F.spark_partition_id()))
    crossing = own.select("block", "id", "dens", "neighbours").mapInArrow(_leaving, "block int, src long, d double, dst long")
    ends = own.select(F.col("id").alias("dst"), F.col("dens").alias("dn"), F.col("block").alias("to"))
    both = F.array(*(F.struct(F.col(b).alias("block"), F.col(o).alias("own"), F.col(f).alias("far"), F.col(d).alias("d")) for b, o, f, d in (("block", "src", "dst", "dn"), ("to", "dst", "src", "d"))))
    halo = crossing.join(ends.hint("merge"), "dst").where("block <> to").select(F.explode(both).alias("e")).select("e.*")
    met = own.repartition(blocks, "block").groupBy("block").cogroup(halo.repartition(blocks, "block").groupBy("block"))
    out = kept(met.applyInArrow(_contract, CONTRACTED))
    state, links = out.where("border is not null"), out.where("border is null")
    # a label is a root or the end of an edge between blocks
    labels = kept(G.zones(G.roots(state.where("border or nxt = id").select("id", "nxt"))))
    named = labels.withColumnRenamed("id", "nxt")
    members = kept(state.drop("border").join(named.hint("merge"), "nxt").select("id", "root", "zone", "dens", "vol", "x", "y", "z"))
    a, b = (labels.select(F.col("id").alias(n), F.col("zone").alias(h)).hint("merge") for n, h in (("id", "h"), ("nxt", "h2")))
    touching = links.select("id", "nxt", "dens").join(a, "id").join(b, "nxt").where("h <> h2")
    once = touching.groupBy(F.least("h", "h2").alias("a"), F.greatest("h", "h2").alias("b")).agg(F.min("dens").alias("slv"))
    sides = F.array(F.struct(F.col("a").alias("h"), F.col("b").alias("h2"), "slv"), F.struct(F.col("b").alias("h"), F.col("a").alias("h2"), "slv"))
    return members, once.select(F.explode(sides).alias("s")).select("s.*")
