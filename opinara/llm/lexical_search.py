"""Ranked lexical search by best-first document intervals over range-maximum tables.

Two passes over the texts. The first counts documents, terms and the document frequency of the query
terms, aggregated per task. In the second every task builds index blocks: posting lists of the query
terms with the exact impact of each posting, and a sparse table per list that gives the posting of
maximum impact in any range. An interval of documents is bounded by the sum of its terms' range maxima.
The search keeps the most promising intervals first, splits each at the document where its strongest
term peaks, scores that document exactly, and drops intervals whose bound is below the k-th best score
found so far in the task. What is left of an interval at ``LEAF`` documents is scored at once.

A task returns k documents an item at most, so the final ranking moves k rows per task and item; it
is done in two steps, first within groups of tasks. Items are read in blocks of bounded size. Terms
compare by 64-bit hashes.

Null texts hold no term; documents without one count nowhere. Rows that repeat a doc_id are ranked
each on its own; a null doc_id comes last among equal scores. Rows that repeat an item_id are one
query with the terms of all of them; null ids are no query. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm import textvec as tv

TOP = 50
QUERY_CHARS = 8_000_000  # text of the items searched together
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 20
LEAF = 8  # documents of an interval that are scored without another split
WIDTH = (64, 1024)  # intervals split together, at first and at most
GROUPS = 64  # groups of tasks that are ranked on their own first
_NO_ID = np.iinfo(np.int64).max


@dataclass
class Queries:
    """Items of a block: their ids and, item by item, places in the sorted distinct terms."""

    ids: list[int]
    terms: np.ndarray
    begins: np.ndarray
    term: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Queries:
        ids = sorted({i for i, _ in rows})
        w = tv.words(pa.array([t for _, t in rows], pa.string()), tv.MARKS)
        owner = np.searchsorted(ids, [i for i, _ in rows])[w.row] if len(w) else w.row
        terms, term = np.unique(w.hash, return_inverse=True)
        pairs = np.unique(owner * max(len(terms), 1) + term)
        owner, term = np.divmod(pairs, max(len(terms), 1))
        return cls(ids, terms, np.searchsorted(owner, np.arange(len(ids) + 1)), term)


def query_blocks(items: DataFrame, chars: int = QUERY_CHARS) -> Iterator[Queries]:
    """All items in blocks of bounded size; rows of one id are in one block."""
    b = items.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna()
    total = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // chars + 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(n))
    for i in range(n):
        yield Queries.of([(r.item_id, r.text) for r in b.filter(part == i).collect()])


def _term_counts(column: pa.Array, terms: np.ndarray, sieve: np.ndarray):
    """Terms per row, and (row, term, count) of the query terms in it, by row and term."""
    w = tv.words(column, tv.MARKS)
    n = np.bincount(w.row, minlength=len(column)).astype(np.int64)
    at, term = tv.find(terms, w.hash, sieve)
    pairs, tf = np.unique(w.row[at] * max(len(terms), 1) + term, return_counts=True)
    row, term = np.divmod(pairs, max(len(terms), 1))
    return n, row, term, tf.astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], queries: Broadcast) -> Iterator[pa.RecordBatch]:
    """(key, n) of a task: document frequency by term; documents under -1, all terms under -2."""
    terms = queries.value.terms
    sieve = tv.sieve(terms)
    df, docs, words = np.zeros(len(terms), np.int64), 0, 0
    for whole in batches:
        for part in tv.slices(whole, "text"):
            n, _, term, _ = _term_counts(part.column(0), terms, sieve)
            df += np.bincount(term, minlength=len(terms))
            docs += int(np.count_nonzero(n))
            words += int(n.sum())
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([held, [-1, -2]])), pa.array(np.concatenate([df[held], [docs, words]]))],
        ["key", "n"],
    )


@dataclass
class Statistics:
    docs: int
    words: int
    weight: np.ndarray  # of each query term

    @classmethod
    def of(cls, texts: DataFrame, queries: Broadcast) -> Statistics:
        counts = texts.select("text").mapInArrow(lambda it: _count(it, queries), "key long, n long")
        found = {r.key: r.total for r in counts.groupBy("key").agg(F.sum("n").alias("total")).collect()}
        docs, words = found.pop(-1, 0), found.pop(-2, 0)
        weight = np.zeros(len(queries.value.terms), np.int64)
        for term, df in found.items():
            weight[term] = math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))
        return cls(docs, words, weight)


class Index:
    """Posting lists of one block of documents and a range-maximum table over each.

    Documents are laid out by the commonest query term they hold and by length, so that neighbours
    share terms and impacts and intervals are bounded tightly.
    """

    def __init__(self, ids, n, row, term, tf, stats: Statistics, layout: np.ndarray):
        self.docs = len(ids)
        lead = np.full(self.docs, len(layout), np.int64)
        np.minimum.at(lead, row, layout[term])
        order = np.lexsort((n, lead))
        place = np.empty(self.docs, np.int64)
        place[order] = np.arange(self.docs)
        self.ids = ids[order]
        length = [50 + 50 * x * stats.docs // stats.words if stats.words else 50 for x in n.tolist()]
        m = np.array(length, np.int64)
        impact = stats.weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
        keep = impact > 0
        doc, term, impact = place[row[keep]], term[keep], impact[keep]
        by = np.lexsort((doc, term))
        self.doc, self.impact = doc[by], impact[by]
        self.begin = np.searchsorted(term[by], np.arange(len(layout) + 1))
        self.peaks = self._tables()

    def _tables(self) -> np.ndarray:
        """Row j holds, per posting, the place of the maximum among it and its 2^j - 1 successors."""
        size = len(self.doc)
        longest = int(np.diff(self.begin).max(initial=1))
        rows = [np.arange(size, dtype=np.int32)]
        for j in range(1, max(longest, 1).bit_length()):
            last, half = rows[-1], 1 << (j - 1)
            # Entries that would reach into the next list are never asked for.
            other = np.concatenate([last[half:], np.full(min(half, size), size - 1, np.int32)])[:size]
            rows.append(np.where(self.impact[last] >= self.impact[other], last, other))
        return np.stack(rows)


class Best:
    """The k best (score, id) of an item so far; a smaller id wins among equal scores."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least
        score, ids = np.concatenate([self.score, score[good]]), np.concatenate([self.id, ids[good]])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


def search(index: Index, terms: np.ndarray, best: Best) -> int:
    """Add an item's best documents of a block; returns how many documents were scored."""
    terms = terms[index.begin[terms + 1] > index.begin[terms]]
    if not len(terms):
        return 0
    first, last = index.begin[terms], index.begin[terms + 1]
    # before[i, d]: postings of term i in documents before d.
    before = np.zeros((len(terms), index.docs + 1), np.int32)
    for i, (s, e) in enumerate(zip(first, last, strict=True)):
        before[i, index.doc[s:e] + 1] = 1
    np.cumsum(before, axis=1, out=before)
    start = first[:, None]

    def exact(doc: np.ndarray) -> np.ndarray:
        at = before[:, doc]
        held = before[:, doc + 1] > at
        where = np.where(held, start + at, 0)
        return np.where(held, index.impact[where], 0).sum(axis=0)

    def bound(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the range maxima of documents a to b, and where the strongest term peaks."""
        lo, hi = before[:, a], before[:, b]
        width = hi - lo
        some = width > 0
        level = np.frexp(np.maximum(width, 1))[1] - 1
        lo = np.where(some, start + lo, 0)
        left = index.peaks[level, lo]
        right = index.peaks[level, np.where(some, start + hi - (1 << level), 0)]
        peak = np.where(index.impact[left] >= index.impact[right], left, right)
        value = np.where(some, index.impact[peak], 0)
        strongest = np.argmax(value, axis=0)
        return value.sum(axis=0), index.doc[peak[strongest, np.arange(len(a))]]

    a, b = np.zeros(1, np.int64), np.full(1, index.docs, np.int64)
    most, split = bound(a, b)
    width, scored = WIDTH[0], 0
    while True:
        open_ = most >= best.least
        a, b, most, split = a[open_], b[open_], most[open_], split[open_]
        if not len(a):
            return scored
        now = np.ones(len(a), bool)
        if len(a) > width:
            now[:] = False
            now[np.argpartition(most, len(a) - width)[-width:]] = True
        width = min(2 * width, WIDTH[1])
        wide = now & (b - a > LEAF)
        small = np.flatnonzero(now & ~wide)
        inside = np.repeat(a[small], (b - a)[small])
        run = np.cumsum((b - a)[small])
        inside += np.arange(len(inside)) - np.repeat(run - (b - a)[small], (b - a)[small])
        doc = np.concatenate([split[wide], inside])
        best.add(exact(doc), index.ids[doc])
        scored += len(doc)
        left, right = np.concatenate([a[wide], split[wide] + 1]), np.concatenate([split[wide], b[wide]])
        some = left < right
        left, right = left[some], right[some]
        m, s = bound(left, right)
        rest = ~now
        a, b = np.concatenate([a[rest], left]), np.concatenate([b[rest], right])
        most, split = np.concatenate([most[rest], m]), np.concatenate([split[rest], s])


def _search(
    batches: Iterator[pa.RecordBatch], queries: Broadcast, stats: Statistics, k: int
) -> Iterator[pa.RecordBatch]:
    """(item, doc_id, score): the k best documents of a task for each item."""
    q = queries.value
    sieve = tv.sieve(q.terms)
    # Commonest terms first: a small weight is a common term.
    layout = np.empty(len(q.terms), np.int64)
    layout[np.lexsort((np.arange(len(q.terms)), stats.weight))] = np.arange(len(q.terms))
    best = [Best(k) for _ in q.ids]
    held: list[tuple[np.ndarray, ...]] = []
    docs = postings = 0

    def flush() -> None:
        nonlocal held, docs, postings
        if postings:
            ids, n, row, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            index = Index(ids, n, row, term, tf, stats, layout)
            for i in range(len(q.ids)):
                search(index, q.term[q.begins[i] : q.begins[i + 1]], best[i])
        held, docs, postings = [], 0, 0

    for whole in batches:
        for part in tv.slices(whole, "text"):
            n, row, term, tf = _term_counts(part.column(1), q.terms, sieve)
            ids = part.column(0).cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            # A slice may hold many short texts, so blocks end inside it too.
            for at in range(0, len(ids), BLOCK_DOCS):
                to = min(at + BLOCK_DOCS, len(ids))
                own = slice(*np.searchsorted(row, [at, to]))
                count = own.stop - own.start
                if docs and (docs + to - at > BLOCK_DOCS or postings + count > BLOCK_POSTINGS):
                    flush()
                held.append((ids[at:to], n[at:to], row[own] - at + docs, term[own], tf[own]))
                docs, postings = docs + to - at, postings + count
    flush()
    item = np.repeat(np.arange(len(best)), [len(x.id) for x in best])
    if len(item):
        ids = np.concatenate([x.id for x in best])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(q.ids, np.int64)[item]),
                pa.array(ids, mask=ids == _NO_ID),
                pa.array(np.concatenate([x.score for x in best])),
            ],
            ["item_id", "doc_id", "score"],
        )


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for block in query_blocks(items):
        queries = sc.broadcast(block)
        stats = Statistics.of(texts, queries)
        part = texts.mapInArrow(
            lambda it, q=queries, s=stats: _search(it, q, s, k), "item_id long, doc_id long, score long"
        )
        found = part if found is None else found.union(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    group = found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    first = Window.partitionBy("item_id", "group").orderBy(*order)
    group = group.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    last = Window.partitionBy("item_id").orderBy(*order)
    out = group.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
