"""Flood hierarchies of any number of zones.

What water from a zone reaches at a level is the component of that level, whatever the zone, so
one pass over the links in their order gives a list of all zones in which every component is a
run, and the levels between neighbours in that list.  A zone absorbs such a run; each member's
level is the highest one on the way to it.  The pass is one task, to which Spark sorts the links
and streams them: it holds a few numbers a zone, no more than the row of the deepest zone, which
names all others.  Rows are made block by block of the list, longer runs from several blocks; no
part of it passes through the driver.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.operators.stage import kept

BLOCK = 1 << 14
ROWS = 1 << 16
#: Zones named by the rows of one Arrow batch, about.
NAMED = 1 << 18

ORDERED = "h long, pos long, gap double, core double, start long, many long, leak double"
GROUPS = "h long, groups array<struct<ratio: double, zones: array<bigint>>>, leak double, final_ratio double"


class Rising:
    """Components of zones while water rises; ``h`` in order, cores of the same places."""

    def __init__(self, h: np.ndarray, core: np.ndarray, tolerance: float):
        n = len(h)
        self.h, self.core, self.tolerance = h, core, tolerance
        self.up, self.head, self.tail, self.first, self.last = (array("q", range(n)) for _ in range(5))
        self.size, self.twin, self.after, self.start, self.many = (array("q", [k]) * n for k in (1, -1, -1, 0, 0))
        self.lowest, self.gap, self.leak = array("d", core.tolist()), array("d", [np.inf]) * n, array("d", [0.0]) * n
        self.tops = np.frombuffer(self.up, np.int64) if n else np.empty(0, np.int64)
        self.level, self.parts = -np.inf, {}

    def places(self, zones: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.h, zones), max(0, len(self.h) - 1))
        if len(zones) and (not len(self.h) or (self.h[at] != zones).any()):
            raise KeyError("a link to a zone that is not in the table")
        return at

    def _top(self, of: np.ndarray) -> np.ndarray:
        top = self.tops[of]
        while not np.array_equal(top, further := self.tops[top]):
            top = further
        self.tops[of] = top
        return top

    def links(self, a: np.ndarray, b: np.ndarray, level: np.ndarray) -> None:
        """Further links, by places, no lower than those before."""
        a, b = self._top(a), self._top(b)
        apart = a != b
        a, b, level = a[apart], b[apart], level[apart]
        if not len(a):
            return
        up, size = self.up, self.size
        heads = np.concatenate([[0], np.flatnonzero(level[1:] != level[:-1]) + 1, [len(level)]]).tolist()
        for s, e in zip(heads[:-1], heads[1:]):
            if (now := float(level[s])) != self.level:
                self.close()
                self.level = now
            parts = self.parts
            for x, y in zip(a[s:e].tolist(), b[s:e].tolist()):
                while up[x] != x:
                    up[x] = x = up[up[x]]
                while up[y] != y:
                    up[y] = y = up[up[y]]
                if x == y:
                    continue
                if now > self.tolerance:
                    self._settle(x, now)
                    self._settle(y, now)
                    continue
                px, py = parts.pop(x, None) or [x], parts.pop(y, None) or [y]
                if len(px) < len(py):
                    px, py = py, px
                px += py
                if size[x] < size[y]:
                    x, y = y, x
                up[y] = x
                parts[x] = px

    def _settle(self, c: int, leak: float) -> None:
        """Zones of component ``c`` that no core has beaten stop with all of it."""
        z, start, many = self.first[c], self.head[c], self.size[c]
        while z >= 0:
            self.start[z], self.many[z], self.leak[z] = start, many, leak
            z = self.twin[z]
        self.first[c] = -1

    def close(self) -> None:
        """Joins what met at the level: as components were below it, all at once."""
        for top, old in self.parts.items():
            low = min([self.lowest[c] for c in old])
            first = last = tail = -1
            size, head = 0, self.head[old[0]]
            for c in old:
                if self.lowest[c] > low:
                    self._settle(c, self.level)
                elif first < 0:
                    first, last = self.first[c], self.last[c]
                else:
                    self.twin[last], last = self.first[c], self.last[c]
                if tail >= 0:
                    self.after[tail], self.gap[tail] = self.head[c], self.level
                tail = self.tail[c]
                size += self.size[c]
            self.lowest[top], self.first[top], self.last[top], self.head[top], self.tail[top], self.size[top] = low, first, last, head, tail, size
        self.parts = {}

    def ordered(self, max_dens: float):
        """Batches of ``ORDERED``."""
        self.close()
        n, up, after = len(self.h), self.up, self.after
        order = array("q", bytes(8 * n))
        k = 0
        for c in range(n):
            if up[c] == c:
                self._settle(c, max_dens)
                z = self.head[c]
                while z >= 0:
                    order[k] = z
                    k += 1
                    z = after[z]
        order = np.frombuffer(order, np.int64) if n else np.empty(0, np.int64)
        pos = np.empty(n, np.int64)
        pos[order] = np.arange(n)
        start, many, gap, leak = (np.frombuffer(c, t) if n else np.empty(0, t) for c, t in ((self.start, np.int64), (self.many, np.int64), (self.gap, float), (self.leak, float)))
        for s in range(0, n, ROWS):
            z = order[s : s + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (self.h[z], np.arange(s, s + len(z)), gap[z], self.core[z], pos[start[z]], many[z], leak[z])], names=[c.split()[0] for c in ORDERED.split(", ")])


def _rise(max_dens: float, tolerance: float):
    def run(batches):
        zones, rising = [], None
        for batch in batches:
            a, b, level = batch.column("a").to_numpy(), batch.column("b"), batch.column("level").to_numpy()
            own = len(a) if rising is None and b.null_count == len(b) else int(b.null_count)
            if own:
                zones.append((a[:own].copy(), level[:own].copy()))
            if own < len(a):
                if rising is None:
                    rising = _begun(zones, tolerance)
                rising.links(rising.places(a[own:]), rising.places(b[own:].to_numpy(zero_copy_only=False).astype(np.int64)), level[own:])
        yield from (rising or _begun(zones, tolerance)).ordered(max_dens)

    return run


def _begun(zones: list[tuple[np.ndarray, np.ndarray]], tolerance: float) -> Rising:
    h, core = (np.concatenate([z[i] for z in zones] or [np.empty(0, t)]) for i, t in enumerate((np.int64, float)))
    order = np.argsort(h)
    return Rising(h[order], core[order], tolerance)


class Rows:
    """Rows of ``GROUPS`` to come, gathered to batches."""

    def __init__(self):
        self.h, self.leak, self.core, self.zones, self.ratios, self.ends, self.groups = [], [], [], [], [], [], []
        self.named = 0

    def add(self, h: int, leak: float, core: float, gap: np.ndarray, zones: np.ndarray, p: int) -> None:
        """The zone at place ``p`` of the run ``zones``, which it absorbs."""
        self.h.append(h)
        self.leak.append(leak)
        self.core.append(core)
        if len(zones) < 2:
            self.groups.append(0)
            return
        level = np.concatenate([np.maximum.accumulate(gap[p : len(zones) - 1]), np.maximum.accumulate(gap[:p][::-1])])
        named = np.concatenate([zones[p + 1 :], zones[:p][::-1]])
        order = np.lexsort((named, level))
        level = level[order]
        ends = np.append(np.flatnonzero(level[1:] != level[:-1]) + 1, len(level))
        self.zones.append(named[order])
        self.ends.append(ends + self.named)
        self.ratios.append(level[ends - 1] / core if core else np.full(len(ends), np.inf))
        self.groups.append(len(ends))
        self.named += len(named)

    def full(self) -> bool:
        return self.named >= NAMED or len(self.h) >= ROWS

    def batch(self) -> pa.RecordBatch:
        def whole(parts: list[np.ndarray], kind) -> np.ndarray:
            return np.concatenate([np.empty(0, kind), *parts]).astype(kind, copy=False)

        zones = pa.ListArray.from_arrays(pa.array(np.append(0, whole(self.ends, np.int64)).astype(np.int32)), pa.array(whole(self.zones, np.int64)))
        groups = pa.StructArray.from_arrays([pa.array(whole(self.ratios, float)), zones], names=["ratio", "zones"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *self.groups]).astype(np.int32)), groups)
        leak, core = np.array(self.leak, float), np.array(self.core, float)
        with np.errstate(divide="ignore", invalid="ignore"):
            final = np.where(core == 0, np.inf, leak / core)
        out = pa.RecordBatch.from_arrays([pa.array(self.h, pa.int64()), lists, pa.array(leak), pa.array(final)], names=["h", "groups", "leak", "final_ratio"])
        self.__init__()
        return out


def _within(block: int):
    """Rows of zones that absorb nothing beyond their block."""

    def of_block(part: dict[str, np.ndarray], rows: Rows):
        low = int(part["pos"][0])
        start, many = part["start"], part["many"]
        for p in np.flatnonzero(start // block == (start + many - 1) // block).tolist():
            s = int(start[p]) - low
            e = s + int(many[p])
            rows.add(int(part["h"][p]), float(part["leak"][p]), float(part["core"][p]), part["gap"][s:e], part["h"][s:e], p - s)
            if rows.full():
                yield rows.batch()

    def run(batches):
        held, rows = None, Rows()
        for batch in batches:
            part = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            if not len(part["pos"]):
                continue
            if held is not None:
                part = {c: np.concatenate([held[c], part[c]]) for c in part}
            of = part["pos"] // block
            cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1]).tolist()
            for s, e in zip(cuts[:-1], cuts[1:]):
                yield from of_block({c: v[s:e] for c, v in part.items()}, rows)
            held = {c: v[cuts[-1] :] for c, v in part.items()}
        if held is not None:
            yield from of_block(held, rows)
        yield rows.batch()

    return run


def _across(block: int):
    """Rows of zones whose runs come as rows of blocks, in order."""

    def run(batches):
        rows, owner, zones, gaps = Rows(), None, [], []

        def done():
            h, pos, core, start, many, leak, first = owner
            s = start - first * block
            rows.add(h, leak, core, np.concatenate(gaps)[s : s + many], np.concatenate(zones)[s : s + many], pos - start)

        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("h", "pos", "core", "start", "many", "leak", "block")]
            for i, key in enumerate(zip(*keys)):
                if owner is None or key[0] != owner[0]:
                    if owner is not None:
                        done()
                        if rows.full():
                            yield rows.batch()
                    owner, zones, gaps = key, [], []
                zones.append(batch.column("zones")[i].values.to_numpy())
                gaps.append(batch.column("gaps")[i].values.to_numpy())
        if owner is not None:
            done()
        yield rows.batch()

    return run


def hierarchy(table: DataFrame, links: DataFrame, max_dens: float, tolerance: float, block: int = BLOCK) -> DataFrame:
    """``GROUPS`` of ``table (h, core_dens)`` and ``links (h, h2, slv)``, which has both directions of each link."""
    zones = table.select(F.lit(0).alias("kind"), F.col("h").alias("a"), F.lit(None).cast("long").alias("b"), F.col("core_dens").alias("level"))
    pairs = links.where("h < h2").select(F.lit(1).alias("kind"), F.col("h").alias("a"), F.col("h2").alias("b"), F.col("slv").alias("level"))
    rows = zones.unionByName(pairs).repartition(1).sortWithinPartitions("kind", "level").select("a", "b", "level")
    ordered = kept(rows.mapInArrow(_rise(max_dens, tolerance), ORDERED))
    at = F.floor(F.col("pos") / block).alias("block")
    near = ordered.repartition(at).sortWithinPartitions("pos").mapInArrow(_within(block), GROUPS)
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("many") - 1) / block)
    long = ordered.where(first != last)
    if not long.limit(1).count():
        return near
    lists = ordered.groupBy(at).agg(F.sort_array(F.collect_list(F.struct("pos", "h", "gap"))).alias("l")).select("block", F.col("l.h").alias("zones"), F.col("l.gap").alias("gaps"))
    wanted = long.select("h", "pos", "core", "start", "many", "leak", F.explode(F.sequence(first, last)).alias("block"))
    met = wanted.join(lists.hint("merge"), "block").repartition("h").sortWithinPartitions("h", "block")
    return near.unionByName(met.mapInArrow(_across(block), GROUPS))
