"""Vectorised text kernels over Arrow string columns.

Everything works on whole texts.  Batches are cut into chunks of whole documents so
that the work arrays stay small whatever the batch size; a document longer than a
chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Letters: A-Z, a-z and every byte of a character beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words beyond so many bytes are hashed one by one, others eight bytes at a time, all together.
LANE_BYTES = 64
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class Chunk:
    """Whole documents ``first .. last`` of a batch: their bytes and byte offsets."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Chunk:
        """A-Z in lower case; every other byte as it is."""
        return Chunk(self.first, _LOWER[self.data], self.offsets)

    def words(self, inside: np.ndarray = ~_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and, per document, bounds of the runs of bytes that are ``inside`` a word.

        By default those are the runs of ``[^\\x20\\x09-\\x0D]``.
        """
        solid = inside[self.data]
        n = len(solid)
        before = np.empty(n, bool)
        before[1:] = solid[:-1]
        heads = self.offsets[:-1][self.offsets[:-1] < n]
        before[heads] = False
        after = np.empty(n, bool)
        after[:-1] = solid[1:]
        tails = self.offsets[1:]
        after[tails[tails > 0] - 1] = False
        starts = np.flatnonzero(solid & ~before)
        ends = np.flatnonzero(solid & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span: its length and eight bytes at a time, each mixed in before the next.

        Every step is a bijection of what came before, so only chance makes spans collide
        (a sum of powers modulo 2^64 would have fixed strings that do, whatever the base).
        """
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        lanes = np.ndarray(len(self.data) + 1, "<u8", padded.data, 0, (1,))
        size = ends - starts
        out = mix((size + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        todo = np.flatnonzero((size > 0) & (size <= LANE_BYTES))
        at = 0
        while len(todo):
            lane = lanes[starts[todo] + at] & _MASK[np.minimum(size[todo] - at, 8)]
            out[todo] = mix(out[todo] ^ lane)
            at += 8
            todo = todo[size[todo] > at]
        for i in np.flatnonzero(size > LANE_BYTES).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[starts[i] : ends[i]].data)
        return out


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of an Arrow string column; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield Chunk(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def shingles(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's runs of ``width`` words (with repeats), and bounds per document.

    A document of fewer words, but at least one, has one shingle: its whole sequence.
    """
    starts, ends, bounds = chunk.words()
    words = chunk.hashes(starts, ends)
    counts = np.diff(bounds)
    n = np.maximum(counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(n, out=out_bounds[1:])
    place = np.repeat(bounds[:-1] - out_bounds[:-1], n) + np.arange(out_bounds[-1])
    room = np.repeat(bounds[1:], n)
    total = np.zeros(len(place), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        total += np.where(place + k < room, padded[place + k] * _PLACE[k], _PLACE[32 + k])
    return mix(total), out_bounds
