"""Packing tokenised documents into fixed-length sequences by bin completion.

Documents are tokenised where they lie; only piece lengths travel.  A length is a whole
number up to the capacity, so all pieces of one length are interchangeable and the packing
problem is its histogram: at most ``capacity`` rows, whatever the input.  The driver solves
that by branch and bound over whole bins (:func:`plan`); pieces then look up their place by
(length, rank within the length), where ranks come from counts per (length, bucket) so that a
hot length is spread over all buckets.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticeflow.llm.common import frugal, small_batches, staged

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
BUCKET_ROWS = 1 << 13
#: Nodes of the search over bins, fillings that a node tries, and steps that it looks for them; beyond
#: these the incumbent stands.
NODES = 1000
FILLINGS = 32
STEPS = 1000
_LOADED: dict = {}
#: What the faster encoder is not given: odd characters, strings of special tokens, and runs
#: without a break that its pattern would have to track back over or its merges to sort out.
_ODD = re.compile(r"[^\t-\r\x20-\x7e¡-ɏ]|<\||[\t-\r ]{512}|[^\t-\r ]{512}")


class Encoder:
    """Ids of a ``tokenizers`` file; plain Latin text takes the same vocabulary's faster encoder.

    The two agree wherever their character classes and white space agree, which the guard
    confines the fast path to: no code point beyond U+024F, no unusual white space or
    control, nothing that could be a special token's string, and no run of 512 characters
    with or without white space (the faster encoder gives up on very long ones).
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer_path)
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and not _ODD.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def public_encoder_paths(name: str = TOKENIZER) -> tuple[str, str | None, str | None]:
    """Paths of a public tokenizer and, if it is there, of its ranks with their pattern."""
    import os

    import public_tokenizers

    ranks = os.path.splitext(public_tokenizers.path(name))[0] + ".tiktoken"
    return (public_tokenizers.path(name), ranks, public_tokenizers.PATTERN) if os.path.exists(ranks) else (public_tokenizers.path(name), None, None)


def _encoder(paths: tuple) -> Encoder:
    if paths not in _LOADED:
        _LOADED.clear()
        _LOADED[paths] = Encoder(*paths)
    return _LOADED[paths]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: whole capacities after a shorter first one."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def _pieces(paths: tuple | None, name: str, capacity: int, end_id: int):
    def run(batches):
        encode = _encoder(paths or public_encoder_paths(name))
        for batch in batches:
            step = max(1, min(512, batch.num_rows))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.array(encode(text or "") + [end_id], "<u4")
                    for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                        for column, value in zip(out, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


Plan = list[tuple[tuple[int, ...], int]]  # fillings, largest piece first, and how many sequences have them


def _reach(counts: list[int], room: int) -> list[int]:
    """Bit s of entry x: some pieces of length x at most, as many as there are, sum to s."""
    whole = (1 << (room + 1)) - 1
    sums, out = 1, [1]
    for x in range(1, room + 1):
        left, step = min(counts[x], room // x), 1
        while left > 0:  # doubling: any number of copies up to the count
            take = min(step, left)
            sums |= (sums << (take * x)) & whole
            left -= take
            step *= 2
        out.append(sums)
    return out


def completion(counts: list[int], room: int) -> list[int]:
    """Lengths that fill ``room`` best, largest first, and of those with as many large pieces as can be."""
    reach = _reach(counts, room)
    goal = reach[room].bit_length() - 1
    best: list[int] = []
    for x in range(min(room, len(counts) - 1), 0, -1):
        if not goal:
            break
        k = min(counts[x], goal // x)
        while not reach[x - 1] >> (goal - k * x) & 1:
            k -= 1
        best += [x] * k
        goal -= k * x
    return best


def _dominated(filling: list[int], counts: list[int], room: int) -> bool:
    """Whether a longer piece could stand in for some of the filling's (or for nothing), and they go elsewhere."""
    slack = room - sum(filling)
    one, more = 1, 0  # sums of no piece or one, and of two pieces or more
    for x in filling:
        more |= (more | one & ~1) << x
        one |= 1 << x
    for x in range(1, room + 1):
        if counts[x] > filling.count(x):
            low = max(0, x - slack)
            if (one >> low & ((1 << (x - low)) - 1)) or (more >> low & ((1 << (x - low + 1)) - 1)):
                return True
    return False


def fillings(counts: list[int], room: int, most_waste: int, steps: int = STEPS) -> Iterator[list[int]]:
    """Undominated fillings of ``room`` that leave at most ``most_waste``, those with large pieces first.

    A branch whose attainable sum (from the subset sums of what may still be chosen) leaves
    more is cut; after ``steps`` branches none is begun.
    """
    reach = _reach(counts, room)
    stack: list[int] = []

    def branch(space: int, top: int) -> Iterator[list[int]]:
        nonlocal steps
        steps -= 1
        if space <= most_waste and not _dominated(stack, counts, room):
            yield list(stack)
        for x in range(min(space, top), 0, -1):
            if space - (reach[x] & ((1 << (space + 1)) - 1)).bit_length() + 1 > most_waste:
                return  # nor do shorter pieces attain more
            if steps <= 0:
                return
            if counts[x] > stack.count(x):
                stack.append(x)
                yield from branch(space - x, x)
                stack.pop()

    return branch(room, room)


def best_fit_decreasing(counts: list[int], capacity: int) -> Plan:
    """Pieces from long to short, each into the fullest open sequence that has room, bins alike together."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room left
    for x in range(capacity, 0, -1):
        left = counts[x]
        while left:
            room = min((r for r in open_bins if r >= x), default=None)
            if room is None:
                filling, bins = (), -(-left // (capacity // x))
                room = capacity
            else:
                filling, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            each = room // x
            full = min(bins, left // each)
            rest = left - full * each if full < bins else 0
            if full:
                open_bins.setdefault(room - each * x, []).append(((*filling, *[x] * each), full))
            if rest:
                open_bins.setdefault(room - rest * x, []).append(((*filling, *[x] * rest), 1))
            if filling and bins > full + (rest > 0):
                open_bins.setdefault(room, []).append((filling, bins - full - (rest > 0)))
            left -= full * each + rest
    return [b for bins in open_bins.values() for b in bins]


def _sequences(found: Plan) -> int:
    return sum(times for _, times in found)


def _one_by_one(counts: list[int], capacity: int) -> Plan:
    """Around the longest piece left, the best completion, repeated while its pieces last."""
    counts, out, top = list(counts), [], capacity
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return out
        counts[top] -= 1
        filling = [top, *completion(counts, capacity - top)]
        counts[top] += 1
        times = min(counts[x] // filling.count(x) for x in set(filling))
        for x in filling:
            counts[x] -= times
        out.append((tuple(filling), times))


def least_sequences(counts: list[int], capacity: int) -> int:
    """A lower bound: for every limit, pieces too long to share with those above it, and the rest by volume."""
    total = sum(x * n for x, n in enumerate(counts))
    best = -(-total // capacity)
    for low in range(1, capacity // 2 + 1):
        alone = sum(counts[capacity - low + 1 :])
        big = sum(counts[capacity // 2 + 1 : capacity - low + 1])
        room = big * capacity - sum(x * counts[x] for x in range(capacity // 2 + 1, capacity - low + 1))
        small = sum(x * counts[x] for x in range(low, capacity // 2 + 1))
        best = max(best, alone + big + max(0, -(-(small - room) // capacity)))
    return best


def fillings_plan(counts: list[int], capacity: int, nodes: int = NODES, width: int = FILLINGS) -> Plan:
    """Bin completion: a plan of as few sequences as the search finds.

    The incumbent is the better of best fit decreasing and the best completion bin by bin.
    A node takes the longest piece left and branches over the undominated fillings around it,
    those of least waste first, each repeated as often as its pieces last and, failing that,
    once.  A branch is cut when its closed sequences waste so much that no plan of fewer
    sequences than the incumbent can come of it.  The search ends at the lower bound, when
    nothing is left to try, or after ``nodes`` nodes.
    """
    best = min(_one_by_one(counts, capacity), best_fit_decreasing(counts, capacity), key=_sequences)
    floor, total = least_sequences(counts, capacity), sum(x * n for x, n in enumerate(counts))

    def tries(left: list[int], waste: int) -> Iterator[tuple[tuple[int, ...], int]]:
        top = max(x for x, n in enumerate(left) if n)
        spare = (_sequences(best) - 1) * capacity - total - waste
        if spare < 0:
            return
        left[top] -= 1
        try:
            found = []
            for filling in fillings(left, capacity - top, min(spare, capacity - top)):
                found.append((top, *filling))
                if len(found) == width:
                    break
        finally:
            left[top] += 1
        found.sort(key=sum, reverse=True)
        most = [min(left[x] // f.count(x) for x in set(f)) for f in found]
        yield from zip(found, most)
        yield from ((f, 1) for f, n in zip(found, most) if n > 1)

    left, done, waste = list(counts), [], 0
    levels = [tries(left, 0)] if total else []
    while levels and nodes and _sequences(best) > floor:
        nodes -= 1
        step = next(levels[-1], None)
        if step is not None:
            filling, times = step
            lost = (capacity - sum(filling)) * times
            if waste + lost > (_sequences(best) - 1) * capacity - total:
                continue
            for x in filling:
                left[x] -= times
            done.append(step)
            waste += lost
            if any(left):
                levels.append(tries(left, waste))
                continue
            if _sequences(done) < _sequences(best):
                best = list(done)
        else:
            levels.pop()
        if done:
            filling, times = done.pop()
            for x in filling:
                left[x] += times
            waste -= (capacity - sum(filling)) * times
    return best


def plan(histogram: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[int, int, int, int, int, int]]:
    """Slots ``(length, first rank, ranks, first sequence, copies, offset)`` for all pieces of :func:`fillings_plan`."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    taken = [0] * (capacity + 1)
    slots, sequence = [], 0
    for filling, times in fillings_plan(counts, capacity, nodes):
        offset = 0
        for x in dict.fromkeys(filling):
            k = filling.count(x)
            slots.append((x, taken[x], times * k, sequence, k, offset))
            taken[x] += times * k
            offset += x * k
        sequence += times
    return slots


def _placed(slots: np.ndarray):
    starts = slots[:, 0] << 48 | slots[:, 1]
    order = np.argsort(starts)
    slots, starts = slots[order], starts[order]

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            s = slots[np.searchsorted(starts, length << 48 | rank, "right") - 1]
            k = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(s[:, 3] + k // s[:, 4]), pa.array(s[:, 5] + k % s[:, 4] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(documents: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER, paths: tuple | None = None) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and ``end_id``; only longer ones than ``capacity`` are cut.  Null
    texts are empty documents (one piece of length 1); null and repeated doc_ids keep their
    rows; other columns are not read; an empty table gives no rows.  ``paths`` are the
    tokenizer file, and optionally its ranks and pattern, as each worker sees them.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = staged(docs.mapInArrow(frugal(_pieces(paths, tokenizer, capacity, end_id)), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = np.array(plan(histogram, capacity) or [(0, 0, 0, 0, 1, 0)], np.int64)
    buckets = max(1, sum(histogram.values()) // BUCKET_ROWS + 1)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("within") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(
        _placed(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
