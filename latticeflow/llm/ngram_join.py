"""Exact Jaccard self-join of documents on word n-gram sets, by signature trees.

1.  One pass over the texts gives each document's set size, a set key (equal sets, equal
    key), a token bitmap of a few bits a token, and the *prefix*: the
    ``n - ceil(t n) + 1`` smallest tokens in one global order.  Two sets at or above the
    threshold share a prefix token whatever the order, so lists of classes by prefix token
    hold every link.  The order puts tokens that many documents share last, which keeps
    lists short; it never decides a result.
2.  Copies (equal sets) become one class, before anything is shuffled by token.
3.  Lists are bundled by their first member, since the lists of one family share it: a
    document meets its family once, not once a token.  Every bundle becomes a signature
    tree: nodes hold the OR of their members' bitmaps, size range, largest bit excess and
    (if common) provisional component.  A dual traversal drops node pairs whose largest
    possible overlap misses the threshold or that lie in one component.  Bundles longer
    than a block are cut by size into blocks and traversed by those pairs of blocks whose
    sizes are within reach of each other.
4.  Every class is traversed in its largest bundle first.  That yields a spanning forest of
    the candidates, likeliest first; verified on the sets themselves, it gives provisional
    components.  The same over all bundles joins what is left, and a last traversal of the
    bundles with more candidates than a forest holds verifies every one that lies between
    different components.

Joins are merge joins: the driver builds no hash tables, and Spark splits their hot keys.

Nothing is capped: a hot class, token or group costs blocks, never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.llm.common import connected_components, frugal, small_batches, staged
from latticeflow.llm.kernels import chunks, mix, shingles

WIDTH = 5
PERCENT = 80
BLOCK = 1024
FANOUT = 4
FILTER_BITS = 25
QUANTILES = 64
SALT = np.uint64(0xA0761D6478BD642F)


def _need(n: np.ndarray | int, percent: int):
    """Smallest overlap of a set of ``n`` with any partner at or above ``percent``."""
    return -(-n * percent // 100)


def bitmap_bytes(n: int) -> int:
    """Bytes of a bitmap of at least three bits a token: a power of two, 16 at least."""
    return max(16, 1 << (max(n, 1) * 3 - 1).bit_length() >> 3)


def bitmap(tokens: np.ndarray) -> bytes:
    bits = np.zeros(bitmap_bytes(len(tokens)) * 8, np.uint8)
    bits[(tokens >> np.uint64(17)) & np.uint64(len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap as bytes, its halves OR-ed until ``size`` bytes are left."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _sets(batch: pa.RecordBatch, width: int):
    """``(row, sorted distinct tokens)`` of each document with a set."""
    for chunk in chunks(batch.column("text")):
        tokens, bounds = shingles(chunk.lower(), width)
        for k in range(len(chunk)):
            own = tokens[bounds[k] : bounds[k + 1]]
            yield chunk.first + k, np.unique(own)


def _key(tokens: np.ndarray) -> int:
    return int(mix(mix(tokens ^ SALT).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens)))[0].astype(np.int64)) if len(tokens) else 0


def _prefix(tokens: np.ndarray, percent: int, common: np.ndarray) -> tuple[np.ndarray, bool]:
    """The prefix in the order (is common, hash), and whether that differs from plain hash order."""
    length = len(tokens) - _need(len(tokens), percent) + 1
    plain = tokens[:length]
    if not len(common) or not len(plain):
        return plain, False
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    late = common[at] == tokens
    if not late[:length].any():
        return plain, False
    return np.concatenate([tokens[~late], tokens[late]])[:length], True


def _describe(width: int, percent: int):
    def run(batches):
        counts: dict[int, int] = {}
        seen, docs = set(), 0
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("bits", pa.binary()), ("prefix", pa.list_(pa.int64())), ("heavy", pa.list_(pa.int64()))])
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out: dict[str, list] = {f: [] for f in schema.names}
            for row, tokens in _sets(batch, width):
                key = _key(tokens)
                prefix = tokens[: len(tokens) - _need(len(tokens), percent) + 1] if len(tokens) else tokens
                if key not in seen and len(tokens):
                    docs += 1
                    if len(seen) < 100_000:
                        seen.add(key)
                    for t in prefix.tolist():
                        counts[t] = counts.get(t, 0) + 1
                    if len(counts) > 400_000:  # a lossy count: only the order of tokens hangs on it
                        counts = {t: c for t, c in counts.items() if c > 1 and c * 200 > docs}
                out["doc_id"].append(ids[row])
                out["n"].append(len(tokens))
                out["key"].append(key)
                out["bits"].append(bitmap(tokens))
                out["prefix"].append(prefix.view(np.int64))
                out["heavy"].append(None)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        heavy = [x for t, c in counts.items() if c >= 4 and c * 200 >= docs for x in (t, c)]
        flat = np.array(heavy, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([None], schema.field(f).type) for f in schema.names[:-1]] + [pa.array([flat], pa.list_(pa.int64()))], schema=schema)

    return run


DESCRIBED = "doc_id long, n long, key long, bits binary, prefix array<long>, heavy array<long>"


def _reordered(width: int, percent: int, common):
    def run(batches):
        late = common.value
        for batch in batches:
            keys, out = [], []
            for _, tokens in _sets(batch, width):
                prefix, moved = _prefix(tokens, percent, late)
                if moved:
                    keys.append(_key(tokens))
                    out.append(prefix.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["key", "moved"])

    return run


def _lists(block: int, percent: int):
    """Runs of equal tokens of a sorted stream, in rows of at most ``block`` members; runs of one are left out.

    Members are in the order of their sizes, and a run is cut where the next size is out of
    reach.  ``hub`` is the first member of what is left.  Lists of one family of documents
    tend to share it, so that bundling lists by hub brings a family together once rather
    than once a token.
    """

    def frame(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["hub", "members"])

    def run(batches):
        token, size, hub, keys, long = None, 0, None, np.empty(0, np.int64), False
        for batch in batches:
            t, k, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "key", "n"))
            rows: list = []
            if len(t):
                heads = np.concatenate([[0], np.flatnonzero((t[1:] != t[:-1]) | (n[:-1] * 100 < n[1:] * percent)) + 1, [len(t)]])
                spans = np.diff(heads)
                busy = np.flatnonzero((spans > 1) | (heads[:-1] == 0) | (heads[1:] == len(t)))
                for i in busy.tolist():
                    a, b = int(heads[i]), int(heads[i + 1])
                    if token is None or a or int(t[a]) != token or size * 100 < int(n[a]) * percent:
                        if len(keys) > 1 or long and len(keys):
                            rows.append((hub, keys))
                        token, hub, keys, long = int(t[a]), int(k[a]), k[a:b], False
                    else:
                        keys = np.concatenate([keys, k[a:b]])
                    size = int(n[b - 1])
                    while len(keys) > block:
                        rows.append((hub, keys[:block]))
                        keys, long = keys[block:], True
            yield frame(rows)
        yield frame([(hub, keys)] if len(keys) > 1 or long and len(keys) else [])

    return run


class _Tree:
    """A signature tree over members sorted by size: levels of nodes, leaves first."""

    def __init__(self, sizes, maps, comps):
        width = min(len(m) for m in maps)
        bits = np.stack([folded(m, width) for m in maps])
        ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.width = width
        level = (bits, sizes, sizes, sizes - ones, comps)
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), FANOUT)
            low, high = np.minimum.reduceat(level[4], at), np.maximum.reduceat(level[4], at)
            level = (np.bitwise_or.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at), np.where(low == high, low, -1))
            self.levels.append(level)


def _pairs(left: _Tree, right: _Tree, percent: int, same: bool):
    """Dual traversal: index pairs of members that may reach the threshold, and their room above it."""
    width = min(left.width, right.width)

    def fold(bits):
        while bits.shape[1] > width:
            half = bits.shape[1] // 2
            bits = bits[:, :half] | bits[:, half:]
        return bits

    excess_more = (left.width > width, right.width > width)
    depth = max(len(left.levels), len(right.levels)) - 1
    a, b, room = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0)
    for d in range(depth, -1, -1):
        la, lb = min(d, len(left.levels) - 1), min(d, len(right.levels) - 1)
        A, B = left.levels[la], right.levels[lb]
        bits_a, bits_b = fold(A[0]), fold(B[0])
        kept_a, kept_b, kept_room = [], [], []
        step = max(1, (1 << 22) // width)
        for s in range(0, len(a), step):
            x, y = a[s : s + step], b[s : s + step]
            fits = (A[2][x] * 100 >= B[1][y] * percent) & (B[2][y] * 100 >= A[1][x] * percent) & ((A[4][x] != B[4][y]) | (A[4][x] < 0))
            if same:
                fits &= x <= y if la or lb else x < y
            x, y = x[fits], y[fits]
            both = np.bitwise_count(bits_a[x] & bits_b[y]).sum(1, dtype=np.int64)
            if la == 0 and lb == 0:
                ones_a, ones_b = np.bitwise_count(bits_a[x]).sum(1, dtype=np.int64), np.bitwise_count(bits_b[y]).sum(1, dtype=np.int64)
                most = np.minimum(A[1][x] - ones_a + both, B[1][y] - ones_b + both)
                least = A[1][x] + B[1][y]
            else:
                more_a = A[2][x] if excess_more[0] else A[3][x]  # folding adds collisions: fall back on the size
                more_b = B[2][y] if excess_more[1] else B[3][y]
                most = np.minimum(np.minimum(both + np.minimum(more_a, more_b), A[2][x]), B[2][y])
                least = A[1][x] + B[1][y]
            fits = most * (100 + percent) >= least * percent
            kept_room.append(most[fits] / least[fits])
            kept_a.append(x[fits])
            kept_b.append(y[fits])
        a, b = np.concatenate(kept_a), np.concatenate(kept_b)
        room = np.concatenate(kept_room or [room])
        if d == 0 or not len(a):
            break
        na, nb = min(d - 1, len(left.levels) - 1), min(d - 1, len(right.levels) - 1)
        fan_a = np.arange(FANOUT) if na < la else np.zeros(1, np.int64)
        fan_b = np.arange(FANOUT) if nb < lb else np.zeros(1, np.int64)
        base_a = a * FANOUT if na < la else a
        base_b = b * FANOUT if nb < lb else b
        a = np.repeat(base_a, len(fan_a) * len(fan_b)) + np.tile(np.repeat(fan_a, len(fan_b)), len(base_a))
        b = np.repeat(base_b, len(fan_a) * len(fan_b)) + np.tile(fan_b, len(base_b) * len(fan_a))
        inside = (a < len(left.levels[na][0])) & (b < len(right.levels[nb][0]))
        a, b = a[inside], b[inside]
    return a, b, room


def _tree(keys, sizes, maps, comps):
    order = np.lexsort((comps, sizes))
    return keys[order], _Tree(sizes[order], [maps[i] for i in order], comps[order])


def _bands(sizes: np.ndarray) -> list[np.ndarray]:
    """Members by bitmap size, so that a tree folds nothing away."""
    return [np.flatnonzero(sizes == s) for s in np.unique(sizes)]


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs join two trees, taken in turn."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            keep[i] = True
    return keep


def _traverse(percent: int, forest: bool):
    """Candidates ``(a, b, job)`` of the block pairs of a partition; rows of a block pair come together.

    With ``forest``, only a spanning forest of them, and a row without ``a`` and ``b`` for
    each block pair that had more.
    """

    def of(side, keys, sizes, maps, comps):
        found = []
        forests = []
        comps = np.unique(comps, return_inverse=True)[1]
        for s in (0, 1):
            own = np.flatnonzero(side == s)
            widths = np.array([len(maps[i]) for i in own])
            forests.append([_tree(keys[own[g]], sizes[own[g]], [maps[i] for i in own[g]], comps[own[g]]) for g in _bands(widths)] if len(own) else [])
        if forests[1]:
            pairs = [(x, y, False) for x in forests[0] for y in forests[1]]
        else:
            pairs = [(x, y, i == j) for i, x in enumerate(forests[0]) for j, y in enumerate(forests[0]) if i <= j]
        for (kx, x), (ky, y), same in pairs:
            a, b, room = _pairs(x, y, percent, same)
            found.append((kx[a], ky[b], room))
        return found

    def run(batches):
        job, held = None, []

        def close():
            if job is None:
                return None
            side, keys, sizes, comps = (np.concatenate([h[i] for h in held]) for i in range(4))
            maps = [m for h in held for m in h[4]]
            found = of(side, keys, sizes, maps, comps)
            a = np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)])
            b = np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)])
            extra = 0
            if forest:
                order = np.argsort(-np.concatenate([f[2] for f in found] or [np.empty(0)]), kind="stable")
                a, b = a[order], b[order]
                keep = _forest(a, b)
                extra = int(keep.sum() < len(a))
                a, b = a[keep], b[keep]
            ends = [pa.array(f(a, b).tolist() + [None] * extra, pa.int64()) for f in (np.minimum, np.maximum)]
            return pa.RecordBatch.from_arrays([*ends, pa.array([job] * (len(a) + extra), pa.int64())], names=["a", "b", "job"])

        for batch in batches:
            jobs = batch.column("job").to_numpy(zero_copy_only=False)
            if not len(jobs):
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("side", "key", "n", "comp")]
            maps = batch.column("bits").to_pylist()
            heads = np.concatenate([[0], np.flatnonzero(jobs[1:] != jobs[:-1]) + 1, [len(jobs)]])
            for s, e in zip(heads[:-1].tolist(), heads[1:].tolist()):
                if jobs[s] != job:
                    done = close()
                    if done is not None and len(done):
                        yield done
                    job, held = int(jobs[s]), []
                held.append((*(c[s:e] for c in cols), [np.frombuffer(m, np.uint8) for m in maps[s:e]]))
        done = close()
        if done is not None:
            yield done

    return run


def _spot(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ mix(ids.view(np.uint64))) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _ids(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.ascontiguousarray(batch.column(name).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64))


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(key, tokens)`` of the classes in ``wanted (key, rep)``, read from the texts again.

    A bitmap of fixed size (4 MB) lets a scan pass over nearly every other text; the
    join that follows is exact.
    """
    spark = docs.sparkSession

    def spots(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_spot(_ids(batch, "key"), _ids(batch, "rep")) + 1)], names=["x"])

    parts = wanted.mapInArrow(spots, "x long").groupBy(F.expr("bitmap_bucket_number(x)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits")).collect()
    whole = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for p in parts:
        at = (p["k"] - 1) * 4096
        own = np.frombuffer(bytes(p["bits"]), np.uint8)
        whole[at : at + len(own)] = own[: len(whole) - at]
    shared = spark.sparkContext.broadcast(whole)

    def scan(batches):
        bits = shared.value
        for batch in batches:
            ids = _ids(batch, "doc_id")
            keys, out = [], []
            for row, tokens in _sets(batch, width):
                if not len(tokens):
                    continue
                key = _key(tokens)
                x = int(_spot(np.array([key], np.int64), ids[row : row + 1])[0])
                if bits[x >> 3] >> (x & 7) & 1:
                    keys.append(key)
                    out.append(tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["key", "tokens"])

    found = docs.mapInArrow(frugal(scan), "key long, tokens array<long>")
    return found.join(wanted.select("key").hint("merge"), "key", "left_semi").dropDuplicates(["key"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b, na, nb)`` that reach the threshold, by their sets."""
    met = (
        pairs.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("ta")).hint("merge"), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("tb")).hint("merge"), "b")
        .withColumn("both", F.size(F.array_intersect("ta", "tb")).cast("long"))
    )
    return met.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def ngram_classes(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, n, key)`` of all documents, and ``(node, component)`` of the linked classes.

    ``documents`` needs ``doc_id`` (whole number) and ``text``; other columns, whatever
    their names, are not read.  Null and blank texts have the empty set: size 0, key 0,
    linked with nothing.  Repeated rows are members of one class.  An empty table gives
    empty results.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(docs.mapInArrow(frugal(_describe(width, percent)), DESCRIBED), "described")
    total = rows.where("heavy is null").count()
    described = rows.where("heavy is null and n > 0")
    common = np.empty(0, np.uint64)
    if total:
        heavy = rows.where("size(heavy) > 0").select(F.explode(F.expr("transform(sequence(0, cast(size(heavy) / 2 as int) - 1, 1), i -> struct(heavy[2 * i] as token, heavy[2 * i + 1] as c))")).alias("h"))
        found = heavy.groupBy("h.token").agg(F.sum("h.c").alias("c")).where(F.col("c") >= max(8, total // 1000)).select("token").toPandas()["token"].to_numpy(np.int64)
        common = np.sort(found.view(np.uint64)) if len(found) else common
    classes = described.groupBy("key").agg(F.min(F.struct("doc_id", "n", "bits", "prefix")).alias("r")).select("key", F.col("r.doc_id").alias("rep"), "r.n", "r.bits", "r.prefix")
    classes = staged(classes, "classes")
    narrow = classes.select("key", "n", "bits")

    posted = classes.select("key", "n", "prefix")
    if len(common):
        moved = docs.mapInArrow(frugal(_reordered(width, percent, spark.sparkContext.broadcast(common))), "key long, moved array<long>").dropDuplicates(["key"])
        posted = posted.join(moved.hint("merge"), "key", "left").select("key", "n", F.coalesce("moved", "prefix").alias("prefix"))
    sorted_posts = posted.select("key", "n", F.explode("prefix").alias("token")).repartition("token").sortWithinPartitions("token", "n", "key")
    lists = staged(sorted_posts.mapInArrow(frugal(_lists(block, percent)), "hub long, members array<long>"), "lists")
    bundled = staged(lists.select("hub", F.explode("members").alias("key")).distinct(), "bundled")
    # blocks of a bundle by size: quantiles of the sizes, cut again by hash where one holds several blocks
    wide = bundled.join(narrow.select("key", "n").hint("merge"), "key")
    cuts = F.percentile_approx("n", [(i + 1) / QUANTILES for i in range(QUANTILES - 1)], 1000)
    blocks = wide.groupBy("hub").agg((F.floor(F.count("*") / block) + 1).alias("blocks"), cuts.alias("cuts"))
    blocks = blocks.select("hub", "blocks", F.when(F.col("blocks") > 1, F.col("cuts")).alias("cuts"))
    below = F.expr("size(filter(cuts, c -> c < n))")  # equal sizes may lie in any of the quantiles that end with them
    level = below + F.pmod(F.xxhash64("key"), F.expr("size(filter(cuts, c -> c = n)) + 1"))
    each = F.ceil(F.col("blocks") / QUANTILES)
    dealt = F.floor(level * F.least("blocks", F.lit(QUANTILES)) / QUANTILES) * each + F.pmod(F.xxhash64("key", F.lit(1)), each)
    members = wide.join(blocks.hint("merge"), "hub").select("hub", "key", F.when(F.col("blocks") > 1, dealt).otherwise(0).cast("int").alias("part"), "n")
    members = staged(members, "members")

    largest = bundled.join(bundled.groupBy("hub").agg(F.count("*").alias("c")).hint("merge"), "hub").groupBy("key").agg(F.max(F.struct("c", "hub")).alias("m")).select("key", F.col("m.hub").alias("hub"))
    primary = members.join(largest.hint("merge"), ["hub", "key"])

    def candidates(of: DataFrame, comps: DataFrame | None, forest: bool, only: DataFrame | None = None) -> DataFrame:
        """Pairs of members of different components that the trees leave: ``(a, b, job)``, see :func:`_traverse`."""
        own = of.withColumn("comp", F.col("key"))
        if comps is not None:
            own = of.join(comps.select(F.col("node").alias("key"), "component").hint("merge"), "key", "left").select("hub", "key", "part", "n", F.coalesce("component", "key").alias("comp"))
        mixed = own.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("hub")
        parts = own.join(mixed.hint("merge"), "hub", "left_semi").groupBy("hub", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        x, y = parts.alias("x"), parts.alias("y")
        jobs = x.join(
            y.hint("merge"),
            F.expr(f"x.hub = y.hub and x.part <= y.part and x.most * 100 >= y.least * {percent} and y.most * 100 >= x.least * {percent} and not (x.lo = x.hi and y.lo = y.hi and x.lo = y.lo)"),
        ).select(F.col("x.hub").alias("hub"), F.col("x.part").alias("p"), F.col("y.part").alias("q"), F.xxhash64("x.hub", "x.part", "y.part").alias("job"))
        if only is not None:
            jobs = jobs.join(only.hint("merge"), "job", "left_semi")
        sides = jobs.select("hub", "job", F.explode(F.expr("if(p = q, array(struct(p as part, 0 as side)), array(struct(p as part, 0 as side), struct(q as part, 1 as side)))")).alias("s")).select("hub", "job", "s.part", "s.side")
        loaded = sides.join(own.hint("merge"), ["hub", "part"]).join(narrow.select("key", "bits").hint("merge"), "key").select("job", "side", "key", "n", "comp", "bits")
        return staged(loaded.repartition("job").sortWithinPartitions("job").mapInArrow(frugal(_traverse(percent, forest)), "a long, b long, job long"), "found")

    def sized(found: DataFrame) -> DataFrame:
        pairs = found.where("a is not null").select("a", "b").distinct()
        return pairs.join(narrow.select(F.col("key").alias("a"), F.col("n").alias("na")).hint("merge"), "a").join(narrow.select(F.col("key").alias("b"), F.col("n").alias("nb")).hint("merge"), "b").select("a", "b", "na", "nb")

    def sets_for(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(classes.select("key", "rep").hint("merge"), "key")
        return staged(_sets_of(docs, wanted, width), "sets")

    def some(df: DataFrame) -> bool:
        return df.limit(1).count() > 0

    tried = staged(sized(candidates(primary, None, True)), "pairs")
    links = staged(_verified(tried, sets_for(tried), percent), "links")
    components = staged(connected_components(links), "components")
    again = candidates(members, components, True)
    for forest in (True, False):
        if forest:
            found = again
        elif some(again.where("a is null")):
            found = candidates(members, components, False, again.where("a is null").select("job").distinct())
        else:
            break
        if not some(found.where("a is not null")):
            continue
        more = staged(sized(found).join(tried.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), "pairs")
        if not some(more):
            continue
        new = staged(_verified(more, sets_for(more), percent), "links")
        tried = tried.unionByName(more)
        if some(new):
            links = links.unionByName(new)
            components = staged(connected_components(links), "components")
    return described_rows(rows), components


def described_rows(rows: DataFrame) -> DataFrame:
    return rows.where("heavy is null").select("doc_id", "n", "key")


def ngram_components(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row for each row of ``documents``.

    Sets are the distinct ``width``-word shingles of the text with A-Z lower-cased (the
    whole sequence if it has fewer words).  Two documents link when
    ``100 * intersection >= percent * union``.  ``component_id`` is the smallest doc_id
    reachable by links; for the empty set it is the document's own.  A row whose doc_id is
    null takes its class's component.
    """
    rows, components = ngram_classes(documents, width, percent, block)
    of_class = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    placed = of_class.join(components.withColumnRenamed("node", "key").hint("merge"), "key", "left").select("key", "least", F.coalesce("component", "key").alias("root"))
    roots = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(roots.hint("merge"), "root").select("key", "component_id")
    return rows.join(named.where("key <> 0").hint("merge"), "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
