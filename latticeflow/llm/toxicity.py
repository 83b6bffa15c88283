"""Toxicity by the nearest labelled examples.

A bounded, stratified sample of labelled documents is the index (``EXAMPLES`` a class, those
with the smallest hashes).  Terms are runs of letters, A-Z lower-cased, and the stems of
longer ones: every term of every example counts, and a document's cosine with an example is
over all of the document's terms that any example has.  Document frequencies for the IDF
count every document.

The inverted index is block-max: alike examples stand in one block, and each term knows its
largest weight in every block.  Short lists are added up whole; with what they give, a
query's bound for a block is its best example so far and the largest weights of the terms
still out.  The query is compared with the block of its largest bound, and then only with
blocks whose bound reaches its ``k``-th cosine, so the neighbours are exact.  No document is
its own neighbour.

A score is a logistic fit of two votes: that of the neighbours by all terms (the
``evidence``), and, as an extra, that of the neighbours by the ``TERMS`` terms whose
association with the label is beyond its sampling error.  The fit is on votes that know
nothing of the example they are for: without itself among its neighbours, and, for the
extra, with terms and neighbours from the other folds of the examples.  Votes are
distance-weighted and corrected for the sampling rates.

The index is bounded by the examples, so broadcasting it is safe at any size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.llm.common import frugal, release, small_batches, staged
from latticeflow.llm.kernels import LETTERS, Chunk, chunks

EXAMPLES = 1536
TERMS = 1024
NEIGHBOURS = 15
COMMON = 512  # terms of the most examples, as a dense matrix
SHORT = 128  # examples of a term whose list is short
BLOCK = 256  # examples of a block
AXES = 8  # principal axes that alike examples are found by
FOLDS = 5
QUERIES = 64  # documents compared at once
BLUR = 1e-5  # more than single precision can be off in a cosine
POSTINGS = 1 << 17  # added up at once
SPARE = 9  # candidates beyond ``k`` that are settled together
SLICE = 512  # terms whose frequencies travel as a row
CONFIDENCE = 3.0
LEAST_DOCS = 4
STEMS = (4, 5, 7)  # bytes of a stem


def held_out(doc_id: str = "doc_id"):
    """True for documents whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _terms(low: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words and of the stems of longer ones (0: no such stem), a row a word."""
    columns = [low.hashes(starts, ends)]
    for n in STEMS:
        stem = low.hashes(starts, np.minimum(ends, starts + n)) ^ np.uint64(n)
        columns.append(np.where(ends - starts > n, stem, np.uint64(0)))
    return np.stack(columns, 1)


def _places(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of hashes in the sorted ``known``; -1 for others."""
    if not len(known):
        return np.full(hashes.shape, -1, np.int32)
    flat = hashes.reshape(-1)
    order = np.argsort(flat)  # a search in order stays in the cache
    sought = flat[order]
    at = np.minimum(np.searchsorted(known, sought), len(known) - 1)
    out = np.empty(len(flat), np.int32)
    out[order] = np.where((known[at] == sought) & (sought != 0), at, -1)
    return out.reshape(hashes.shape)


def _document_terms(batch: pa.RecordBatch, known: np.ndarray | None):
    """Per document: distinct term hashes (or places in the sorted ``known``) and counts."""
    for chunk in chunks(batch.column("text")):
        low = chunk.lower()
        starts, ends, bounds = low.words(LETTERS)
        _, first, word = np.unique(low.hashes(starts, ends), return_index=True, return_inverse=True)
        terms = _terms(low, starts[first], ends[first])
        none = np.uint64(0)
        if known is not None:
            terms, none = _places(known, terms), np.int32(-1)
        for k in range(len(chunk)):
            own = terms[word[bounds[k] : bounds[k + 1]]].reshape(-1)
            own = np.sort(own[own != none])
            heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
            yield chunk.first + k, own[heads], np.diff(heads, append=len(own))


def _term_lists(batches):
    for batch in batches:
        rows = [(t.view(np.int64), c) for _, t, c in _document_terms(batch, None)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms", "counts"])


def _slices(total: np.ndarray):
    """Rows ``(slice, docs)`` of the slices of ``total`` that are not all zero."""
    rows = [(b, total[b * SLICE : (b + 1) * SLICE]) for b in range(-(-len(total) // SLICE))]
    rows = [r for r in rows if r[1].any()]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["slice", "docs"])


def _frequencies(known):
    def run(batches):
        terms = known.value
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for _, at, _ in _document_terms(batch, terms):
                total[at] += 1
        yield _slices(total)

    return run


def _added(n: int):
    def run(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            for b, docs in zip(batch.column("slice").to_pylist(), batch.column("docs")):
                total[b * SLICE : (b + 1) * SLICE] += docs.values.to_numpy()
        yield _slices(total)

    return run


def _dense(places: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int, common: np.ndarray) -> np.ndarray:
    """Weights of the ``common`` terms, a row a term and a column an example."""
    out = np.zeros((len(common), n))
    if len(common):
        at = np.minimum(np.searchsorted(common, terms), len(common) - 1)
        hit = common[at] == terms
        out[at[hit], places[hit]] = values[hit]
    return out


def _arranged(dense: np.ndarray) -> np.ndarray:
    """An order of the columns of ``dense`` in which runs of ``BLOCK`` are alike: halves along principal axes."""
    n = dense.shape[1]
    if n <= BLOCK:
        return np.arange(n)
    centred = dense - dense.mean(1, keepdims=True)
    axes = np.linalg.eigh(centred @ centred.T)[1][:, -AXES:]
    at = centred.T @ axes

    def halves(rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= BLOCK:
            return [rows]
        rows = rows[np.argsort(at[rows, at[rows].var(0).argmax()], kind="stable")]
        cut = -(-len(rows) // (2 * BLOCK)) * BLOCK
        return halves(rows[:cut]) + halves(rows[cut:])

    return np.concatenate(halves(np.arange(n)))


class Index:
    """Block-max inverted index of weighted examples; the terms of the most examples as a dense matrix."""

    def __init__(self, known: np.ndarray, idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, ids: np.ndarray, k: int):
        self.known, self.idf, self.k, self.n = known, idf, k, len(vectors)
        self.blocks = max(1, -(-self.n // BLOCK))
        places = np.repeat(np.arange(self.n, dtype=np.int32), [len(at) for at, _ in vectors])
        terms = np.concatenate([np.empty(0, np.int32), *(at.astype(np.int32) for at, _ in vectors)])
        values = np.concatenate([np.empty(0), *(w for _, w in vectors)])
        sizes = np.bincount(terms, minlength=len(known))
        self.common = np.sort(np.argsort(-sizes, kind="stable")[: COMMON if len(known) > TERMS else TERMS])
        order = _arranged(_dense(places, terms, values, self.n, self.common)) if self.n else np.empty(0, np.int64)
        self.place = np.empty(self.n, np.int32)  # of the i-th vector given
        self.place[order] = np.arange(self.n, dtype=np.int32)
        self.labels, self.weights, self.ids = labels[order], weights[order], ids[order]
        places = self.place[places]
        order = np.lexsort((places, terms))
        self.places, self.values = places[order].astype(np.int64), values[order]
        self.lists = np.concatenate([[0], np.cumsum(sizes)])  # where each term's postings begin
        self.turned = self.kept = None

    def __getstate__(self):
        return self.__dict__ | dict.fromkeys(("rough", "turned", "heads", "counts", "brief", "top", "slot", "row", "kept"))

    def _split(self) -> None:
        """What is looked up in postings and the dense rows, made where they are used.

        Only terms of long lists have their postings split by block (``heads``, ``counts``) and their largest
        weights there (``top``), a row a term by its ``slot``: the many short ones would take most of the memory.
        """
        sizes = np.diff(self.lists)
        terms = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.brief = sizes <= SHORT
        self.brief[self.common] = False
        long = np.flatnonzero(~self.brief)
        self.slot = np.full(len(self.known), -1, np.int32)
        self.slot[long] = np.arange(len(long))
        mine = ~self.brief[terms]
        cells = self.slot[terms[mine]].astype(np.int64) * self.blocks + self.places[mine] // BLOCK
        counts = np.bincount(cells, minlength=len(long) * self.blocks)
        self.top = np.zeros(len(counts))
        busy = np.flatnonzero(counts)
        if len(busy):
            self.top[busy] = np.maximum.reduceat(self.values[mine], (np.cumsum(counts) - counts)[busy])
        self.top = self.top.reshape(-1, self.blocks)
        within = counts.reshape(-1, self.blocks)
        self.heads = (self.lists[long, None] + np.cumsum(within, axis=1) - within).reshape(-1)
        self.counts = counts
        self.row = np.full(len(self.known), -1, np.int32)
        self.row[self.common] = np.arange(len(self.common))
        dense = _dense(self.places, terms, self.values, self.n, self.common)
        self.rough = dense.astype(np.float32)
        self.turned = np.ascontiguousarray(dense.T)

    def room(self, n: int) -> tuple[np.ndarray, ...]:
        """0, 1, ... below ``n``, and arrays of ``n`` places and of ``n`` values to write to: the same ones each time."""
        if self.kept is None or len(self.kept[0]) < n:
            size = max(n, 1 << 16)
            self.kept = np.arange(size), np.empty(size, np.int64), np.empty(size)
        return tuple(a[:n] for a in self.kept)

    def weigh(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1.0 + np.log(counts)) * self.idf[at]
        length = math.sqrt(float((w * w).sum()))
        return w / length if length else w

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], skips: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``k`` examples of largest positive cosine, ties to the smaller id.

        A row a query of cosines and places, -1 where there are fewer.  ``skips`` are places
        that are no neighbours of their query (-1: none).
        """
        cosines, places = np.full((len(queries), self.k), -1.0), np.full((len(queries), self.k), -1, np.int64)
        for first in range(0, len(queries) if self.n else 0, QUERIES):
            part = slice(first, first + QUERIES)
            scores, rare, common = self._cosines(queries[part], None if skips is None else skips[part])
            wide = min(self.n, self.k + SPARE)
            floors = np.maximum(np.partition(scores, self.n - self.k, axis=1)[:, self.n - self.k] - 2 * BLUR, 0.0) if self.n > self.k else np.zeros(len(scores))
            near = (scores > 0) & (scores >= floors[:, None])
            got = np.argpartition(-scores, wide - 1, axis=1)[:, :wide] if wide < self.n else np.broadcast_to(np.arange(self.n), scores.shape)
            exact = np.take_along_axis(rare, got, 1) + np.matmul(self.turned[got], common[:, :, None])[..., 0]
            exact = np.where(np.take_along_axis(near, got, 1), exact, -1.0)
            ties = self.ids[got]
            order = np.lexsort((ties, -np.round(exact, 12)), axis=1)[:, : self.k]
            cosines[part, : order.shape[1]] = np.take_along_axis(exact, order, 1)
            places[part, : order.shape[1]] = np.take_along_axis(got, order, 1)
            for q in np.flatnonzero(near.sum(1) > wide).tolist():  # more ties than are settled together
                hits = np.flatnonzero(near[q])
                exact = rare[q, hits] + self.turned[hits] @ common[q]
                order = np.lexsort((self.ids[hits], -np.round(exact, 12)))[: self.k]
                cosines[first + q], places[first + q] = exact[order], hits[order]
        places[cosines <= 0] = -1
        return cosines, places

    def _cosines(self, queries: list[tuple[np.ndarray, np.ndarray]], skips: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cosines with all examples that can be among the nearest ``k``, to within ``BLUR``; 0 for the others.

        Also the exact share of the rarer terms in them, and the queries' weights of the common ones.
        """
        if self.turned is None:
            self._split()
        m = len(queries)
        of = np.repeat(np.arange(m), [len(at) for at, _ in queries])
        at = np.concatenate([at for at, _ in queries]).astype(np.int64)
        w = np.concatenate([w for _, w in queries])
        scores, others = np.zeros((m, self.n), np.float32), np.zeros(m * self.n)

        def add(which: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
            """Adds runs of postings, ``which`` says of which queries' terms (query by query), some ``POSTINGS`` at a time."""
            busy = np.flatnonzero(sizes)
            if not len(busy):
                return
            which, sizes, starts = which[busy], sizes[busy], starts[busy]
            ends = np.cumsum(sizes)
            cuts = np.searchsorted(ends, np.arange(POSTINGS, ends[-1], POSTINGS)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(which)]):
                if low == high:
                    continue
                own, size = which[low:high], sizes[low:high]
                first, last = int(of[own[0]]), int(of[own[-1]]) + 1
                done = ends[low:high] - ends[low] + size[0]
                posts = np.repeat(starts[low:high] - done + size, size)
                steps, spots, values = self.room(len(posts))
                posts += steps
                # all are inside, so that clipping only saves the check
                self.values.take(posts, mode="clip", out=values)
                self.places.take(posts, mode="clip", out=spots)
                values *= np.repeat(w[own], size)
                spots += np.repeat((of[own] - first) * self.n, size)
                more = np.bincount(spots, values, (last - first) * self.n)
                part = others[first * self.n : last * self.n]
                np.add(part, more, out=part)
                np.add(scores[first:last], more.reshape(last - first, -1), out=scores[first:last], casting="same_kind")

        brief = np.flatnonzero(self.brief[at])
        add(brief, self.lists[at[brief]], self.lists[at[brief] + 1] - self.lists[at[brief]])
        long = np.flatnonzero(~self.brief[at])
        bounds = np.zeros((m, self.blocks))
        if len(long):
            heads = np.flatnonzero(np.concatenate([[True], of[long[1:]] != of[long[:-1]]]))
            bounds[of[long[heads]]] = np.add.reduceat(self.top[self.slot[at[long]]] * w[long, None], heads)
        bounds += np.maximum.reduceat(scores, np.arange(0, self.n, BLOCK), axis=1)
        row = self.row[at]
        own = row >= 0
        common = np.zeros((m, len(self.common)))
        common[of[own], row[own]] = w[own]
        rough = common.astype(np.float32)
        mid = long[row[long] < 0]

        def compare(pairs: np.ndarray) -> None:
            """Fills in the blocks of a query that ``pairs`` marks."""
            for b in np.flatnonzero(pairs.any(0)).tolist():
                some = np.flatnonzero(pairs[:, b])
                span = slice(b * BLOCK, (b + 1) * BLOCK)
                scores[some, span] += rough[some] @ self.rough[:, span]
            which, block = np.nonzero(pairs[of[mid]])
            cells = self.slot[at[mid[which]]].astype(np.int64) * self.blocks + block
            add(mid[which], self.heads[cells], self.counts[cells])
            if skips is not None:
                some = [(q, p) for q, p in enumerate(skips) if p >= 0]
                if some:
                    scores[tuple(zip(*some))] = 0.0

        first = np.zeros(bounds.shape, bool)
        first[np.arange(m), bounds.argmax(1)] = True
        compare(first)
        # scores only grow, so the k-th of unfinished ones is a bound from below as well
        least = np.partition(scores, self.n - self.k, axis=1)[:, self.n - self.k] if self.n > self.k else np.zeros(m)
        again = ~first & (bounds > 0) & (bounds >= least[:, None] - BLUR)
        compare(again)
        scores[~np.repeat(first | again, BLOCK, axis=1)[:, : self.n]] = 0.0
        return scores, others.reshape(m, -1), common

    def nearest(self, at: np.ndarray, w: np.ndarray, skip: int = -1) -> list[tuple[float, int]]:
        """:meth:`nearest_of` one query, as ``(cosine, place)``."""
        cosines, places = self.nearest_of([(at, w)], [skip])
        return [(c, p) for c, p in zip(cosines[0].tolist(), places[0].tolist()) if p >= 0]

    def votes(self, cosines: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours of each query, each by its weight and nearness; nan without any."""
        if not self.n:
            return np.full(len(cosines), np.nan)
        near = np.where(places >= 0, self.weights[places] / (1.05 - np.minimum(cosines, 1.0)), 0.0)
        with np.errstate(invalid="ignore"):
            return (near * self.labels[places]).sum(1) / near.sum(1)


class Model:
    """An index by all terms, one by the terms with a label, and what their votes say."""

    def __init__(self, whole: Index, marked: Index):
        self.whole, self.marked = whole, marked
        self.inner = np.full(len(whole.known), -1, np.int32)
        self.inner[np.searchsorted(whole.known, marked.known)] = np.arange(len(marked.known))
        self.empty, self.scale = (0.0, 0.0), (0.0, 0.0, 0.0)
        order = np.argsort(whole.ids, kind="stable")
        self.by_id = (whole.ids[order], order)

    def own_place(self, doc_id: int | None) -> int:
        """Place of the example that is this document, or -1."""
        ids, order = self.by_id
        at = int(np.searchsorted(ids, doc_id)) if doc_id is not None else len(ids)
        return int(order[at]) if at < len(ids) and ids[at] == doc_id else -1

    def neighbours(self, documents: list[tuple[np.ndarray, np.ndarray]], own: list[int]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Neighbours by all terms and by terms with a label; ``own``: the documents' places among the examples."""
        whole = self.whole.nearest_of([(at, self.whole.weigh(at, counts)) for at, counts in documents], own)
        inner = [_inside(at, counts, self.inner) for at, counts in documents]
        places = np.append(self.marked.place[np.argsort(self.whole.place)], -1)  # of the same example; -1 stays
        return whole, self.marked.nearest_of([(at, self.marked.weigh(at, counts)) for at, counts in inner], [int(places[p]) for p in own])

    def scores(self, votes: np.ndarray) -> np.ndarray:
        """Scores of rows of two votes (nan: no neighbours)."""
        z = self.scale[-1] + np.where(np.isnan(votes), np.array(self.empty), votes) @ np.array(self.scale[:-1])
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def _calibrated(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, ...]:
    """Weighted, lightly penalised logistic fit by Newton steps to a column a vote; no slope points down."""
    n = votes.shape[1]
    x = np.concatenate([votes, np.ones((len(votes), 1))], 1)
    w, beta = weights / weights.sum() * len(weights), np.array([4.0] * n + [-2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        slope = x.T @ (w * (labels - p)) - 0.01 * beta
        bend = (x * (w * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(n + 1)
        step = np.linalg.solve(bend, slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    if n > 1 and beta[:n].min() < 0:  # a vote that points down is left out, and the others fitted again
        kept = [k for k in range(n) if k != int(beta[:n].argmin())]
        rest = _calibrated(votes[:, kept], labels, weights)
        out = np.zeros(n + 1)
        out[[*kept, n]] = rest
        return tuple(out.tolist())
    return (*(max(float(v), 0.1 if n == 1 else 0.0) for v in beta[:n]), float(beta[n]))


def _inside(at: np.ndarray, counts: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's terms by their places in a smaller vocabulary."""
    to = inner[at]
    return to[to >= 0], counts[to >= 0]


def selected_terms(flat: np.ndarray, label: np.ndarray, n1: int, n0: int, terms: int) -> np.ndarray:
    """Terms whose log odds ratio between the classes is ``CONFIDENCE`` errors from nothing, strongest first.

    ``flat`` has each document's distinct terms, ``label`` the class of each of them.
    """
    names, place = np.unique(flat, return_inverse=True)
    c1 = np.bincount(place, weights=label, minlength=len(names))
    c0 = np.bincount(place, minlength=len(names)) - c1
    kept = np.flatnonzero(c0 + c1 >= LEAST_DOCS)
    names, c0, c1 = names[kept], c0[kept], c1[kept]
    ratio = np.abs(np.log((c1 + 0.5) / (n1 - c1 + 0.5)) - np.log((c0 + 0.5) / (n0 - c0 + 0.5)))
    error = np.sqrt(1 / (c1 + 0.5) + 1 / (n1 - c1 + 0.5) + 1 / (c0 + 0.5) + 1 / (n0 - c0 + 0.5))
    strong = np.flatnonzero(ratio > CONFIDENCE * error + 1.0)
    order = np.lexsort((names[strong], -ratio[strong] / error[strong]))
    return names[strong[order[:terms]]]


def fit(documents: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS, k: int = NEIGHBOURS) -> Model:
    """The model learned from labelled documents that are not held out."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = staged(marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).mapInArrow(frugal(_term_lists), "doc_id long, toxic int, terms array<long>, counts array<int>").toArrow().sort_by("doc_id").combine_chunks()
    y = rows.column("toxic").to_numpy().astype(np.int64)
    ids = rows.column("doc_id").to_numpy()
    flat, n_flat = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "counts"))
    lengths = np.array(pc.list_value_length(rows.column("terms")).to_numpy(), np.int64) if len(y) else np.empty(0, np.int64)
    del rows
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    got = np.bincount(y, minlength=2)
    rates = np.array([sizes.get(c, 0) / max(1, got[c]) for c in (0, 1)])
    weights = rates[y] if len(y) else np.empty(0)
    vocabulary = np.unique(flat.view(np.uint64))
    at = _places(vocabulary, flat.view(np.uint64))
    del flat
    flat_label = np.repeat(y, lengths)
    total = max(1, documents.count())
    freq = np.zeros(len(vocabulary))
    if len(vocabulary):
        shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
        parts = docs.select("text").mapInArrow(frugal(_frequencies(shared)), "slice long, docs array<long>").repartition("slice")
        for r in parts.mapInArrow(frugal(_added(len(vocabulary))), "slice long, docs array<long>").toArrow().to_batches():
            for b, seen in zip(r.column("slice").to_pylist(), r.column("docs")):
                freq[b * SLICE : (b + 1) * SLICE] = seen.values.to_numpy()
    idf = np.log((1.0 + total) / (1.0 + freq)) + 1.0
    release()
    own = [(at[s:e], n_flat[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def weighed(known: np.ndarray, weight: np.ndarray, documents: list[tuple[np.ndarray, np.ndarray]], chosen: np.ndarray) -> Index:
        out = Index(known, weight, [], np.empty(0), np.empty(0), np.empty(0, np.int64), k)
        return Index(known, weight, [(a, out.weigh(a, n)) for a, n in documents], y[chosen].astype(float), weights[chosen], ids[chosen], k)

    def by_label(chosen: np.ndarray) -> tuple[Index, np.ndarray]:
        """The index of some examples by the terms that go with their labels, and where it has the vocabulary's terms."""
        mask = np.zeros(len(y), bool)
        mask[chosen] = True
        kept = np.repeat(mask, lengths)
        strong = np.sort(selected_terms(at[kept], flat_label[kept], int(y[chosen].sum()), int((1 - y[chosen]).sum()), terms))
        inner = np.full(len(vocabulary), -1, np.int32)
        inner[strong] = np.arange(len(strong))
        return weighed(vocabulary[strong], idf[strong], [_inside(*own[i], inner) for i in chosen.tolist()], chosen), inner

    everyone = np.arange(len(y))
    model = Model(weighed(vocabulary, idf, own, everyone), by_label(everyone)[0])
    share = float(weights[y == 1].sum() / weights.sum()) if len(y) else 0.0
    votes = np.full((len(y), 2), np.nan)  # nan: no neighbours
    votes[:, 0] = model.whole.votes(*model.whole.nearest_of([(a, model.whole.weigh(a, n)) for a, n in own], model.whole.place.tolist()))
    for fold in range(min(FOLDS, len(y))):
        mine = everyone % FOLDS == fold
        index, inner = by_label(everyone[~mine])
        asked = [_inside(*own[i], inner) for i in everyone[mine].tolist()]
        votes[mine, 1] = index.votes(*index.nearest_of([(a, index.weigh(a, n)) for a, n in asked]))
    lone = np.isnan(votes)
    # the votes of examples without neighbours are their own share of label 1
    model.empty = tuple(float((weights[m] * y[m]).sum() + share) / (float(weights[m].sum()) + 1.0) for m in lone.T)
    votes = np.where(lone, np.array(model.empty), votes)
    if 0 < y.sum() < len(y):
        model.scale = _calibrated(votes, y.astype(float), weights)
    else:  # one class or none: the plain share
        model.scale = (0.0, 0.0, math.log((share + 1e-3) / (1 - share + 1e-3)))
    return model


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)`` of all rows; evidence lists neighbours ``(doc_id, cosine, label)``.

    Null and empty texts, and texts that share no term with any example, have null evidence.
    An example is no neighbour of the rows with its own doc_id.  Ties go to the smaller doc_id.
    Null and repeated doc_ids keep their rows; other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        own = shared.value
        whole = own.whole
        for batch in batches:
            n, ids = batch.num_rows, batch.column("doc_id").to_pylist()
            scores, cosines, places = np.full(n, own.scores(np.full((1, 2), np.nan))[0]), np.full((n, whole.k), -1.0), np.full((n, whole.k), -1, np.int64)
            rows, queries = [], []

            def settle():
                found, also = own.neighbours(queries, [own.own_place(ids[r]) for r in rows])
                scores[rows] = own.scores(np.stack([whole.votes(*found), own.marked.votes(*also)], 1))
                cosines[rows], places[rows] = found
                rows.clear()
                queries.clear()

            for row, at, counts in _document_terms(batch, whole.known):
                if len(at):
                    rows.append(row)
                    queries.append((at, counts))
                    if len(rows) == QUERIES:
                        settle()
            if rows:
                settle()
            some = places >= 0
            flat = places[some]
            bounds = np.concatenate([[0], np.cumsum(some.sum(1))]).astype(np.int32)
            parts = [pa.array(whole.ids[flat], pa.int64()), pa.array(cosines[some]), pa.array(whole.labels[flat].astype(np.int32))]
            evidence = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(parts, fields=list(kind.value_type)), mask=pa.array(~some.any(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), evidence], names=["doc_id", "held_out", "score", "predicted", "evidence"]
            )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return docs.mapInArrow(frugal(run), "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, label: int>>")


def toxicity(documents: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS, k: int = NEIGHBOURS) -> DataFrame:
    """:func:`scored` with the model of :func:`fit`; an empty label table scores all rows alike."""
    return scored(documents, fit(documents, labels, examples, terms, k))
