"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie over bytes.  A node that cannot go on fails to the node of the
longest suffix that is still open, having *popped* a known number of whole pieces; both the
link and the count are computed once.  Counting a word follows goto and failure links and
adds up the popped counts: each byte is looked at a bounded number of times and no piece is
ever built.  All distinct words of a chunk step through the automaton together; words beyond
``LONG_BYTES`` go through it one by one.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.llm.common import frugal, small_batches
from latticeflow.llm.kernels import Chunk, chunks

CACHED_WORDS = 1 << 20
LONG_BYTES = 256
VOCABULARY = "byte_bpe_50k.tiktoken"


class Automaton:
    """Trie, failure links and popped-piece counts of a vocabulary of byte strings."""

    def __init__(self, vocabulary: list[bytes]):
        goto: list[dict[int, int]] = [{}]
        word = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                if byte not in goto[node]:
                    goto[node][byte] = len(goto)
                    goto.append({})
                    word.append(False)
                node = goto[node][byte]
            word[node] = bool(piece)
        n = len(goto)
        # fail -1: no link, the word cannot be split there
        fail, popped = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, child in goto[node].items():
                queue.append(child)
                if word[child]:
                    fail[child], popped[child] = 0, 1
                    continue
                up, count = int(fail[node]), int(popped[node])
                while up >= 0 and byte not in goto[up]:
                    count += int(popped[up])
                    up = int(fail[up])
                if up >= 0:
                    fail[child], popped[child] = goto[up][byte], count
        keys = np.array([node << 8 | byte for node, out in enumerate(goto) for byte in out], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.targets = np.array([c for out in goto for c in out.values()], np.int64)[order]
        self.fail, self.popped = fail, popped
        self.first = np.full(256, -1, np.int64)
        for byte, child in goto[0].items():
            self.first[byte] = child
        self.goto: dict[int, int] | None = None

    def length(self, word: bytes) -> int:
        """Pieces of one word, byte by byte."""
        if self.goto is None:
            self.goto = dict(zip(self.keys.tolist(), self.targets.tolist()))
            self.steps = list(zip(self.fail.tolist(), self.popped.tolist()))
        goto, steps, node, total = self.goto, self.steps, 0, 0
        for byte in word:
            while (to := goto.get(node << 8 | byte)) is None:
                node, popped = steps[node]
                total += popped
                if node < 0:
                    return 1
            node = to
        while node:  # the end of the word closes what is open
            node, popped = steps[node]
            total += popped
            if node < 0:
                return 1
        return total

    def _next(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(nodes), -1, np.int64)
        key = nodes << 8 | data
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], -1)

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each span; a span that cannot be split is one unknown piece."""
        total = np.zeros(len(starts), np.int64)
        node = np.zeros(len(starts), np.int64)
        lost = np.zeros(len(starts), bool)
        place = starts.copy()
        long = np.flatnonzero(ends - starts > LONG_BYTES)
        active = np.flatnonzero((starts < ends) & (ends - starts <= LONG_BYTES))
        while len(active):
            here, at = node[active], data[place[active]].astype(np.int64)
            to = np.where(here == 0, self.first[at], self._next(here, at))
            ok = to >= 0
            node[active[ok]] = to[ok]
            place[active[ok]] += 1
            stuck = active[~ok]
            total[stuck] += self.popped[node[stuck]]
            node[stuck] = self.fail[node[stuck]]
            dead = node[stuck] < 0
            lost[stuck[dead]] = True
            active = active[(place[active] < ends[active]) & ~lost[active]]
        rest = np.flatnonzero(~lost & (node != 0))
        while len(rest):  # the end of the word closes what is open
            total[rest] += self.popped[node[rest]]
            node[rest] = self.fail[node[rest]]
            lost[rest[node[rest] < 0]] = True
            rest = rest[node[rest] > 0]
        total[lost] = 1
        for i in long.tolist():
            total[i] = self.length(data[starts[i] : ends[i]].tobytes())
        return total


_LOADED: dict = {}


def public_vocabulary(name: str = VOCABULARY) -> list[bytes]:
    """Byte strings of a public vocabulary of ranks."""
    import base64

    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Counter:
    """Pieces per document with a bounded cache of words."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.known = automaton, {}

    def __call__(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Words and pieces of each document of the chunk."""
        starts, ends, bounds = chunk.words()
        hashes = chunk.hashes(starts, ends)
        unique, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        got = [self.known.get(h, -1) for h in unique.tolist()]
        pieces = np.array(got, np.int64)
        new = np.flatnonzero(pieces < 0)
        if len(new):
            pieces[new] = self.automaton.lengths(chunk.data, starts[at[new]], ends[at[new]])
            if len(self.known) + len(new) > CACHED_WORDS:
                self.known.clear()
            self.known.update(zip(unique[new].tolist(), pieces[new].tolist()))
        run = np.concatenate([[0], np.cumsum(pieces[back])])
        return np.diff(bounds), run[bounds[1:]] - run[bounds[:-1]]


def token_counts(documents: DataFrame, name: str = VOCABULARY, vocabulary: list[bytes] | None = None) -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` of all rows, over whole texts.

    Words are runs of ``[^\\x20\\x09-\\x0D]``; each is split greedily into the longest
    vocabulary pieces, or counts one if it cannot be.  Null and blank texts have 0 of both;
    null and repeated doc_ids keep their rows; other columns are not read.
    """
    given = tuple(vocabulary) if vocabulary is not None else None

    def run(batches):
        key = (name, given)
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Counter(Automaton(list(given) if given is not None else public_vocabulary(name)))
        count = _LOADED[key]
        for batch in batches:
            words, tokens = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for chunk in chunks(batch.column("text")):
                w, t = count(chunk)
                words.append(w)
                tokens.append(t)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(words)), pa.array(np.concatenate(tokens))], names=["doc_id", "n_words", "n_tokens"])

    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, n_words long, n_tokens long")
