"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of the words.

Words are runs without ASCII marks and blanks, A-Z folded. The benchmark is handled in blocks of at
most ``BLOCK_WORDS`` words, so what is broadcast has a bound whatever the benchmark's size. Per
block one pass over all texts looks for the seeds of the items: every ``N``-gram, and the pairs of
neighbouring words that are rare in the benchmark block (at most ``RARE`` places), which copies keep
that are edited every two words. Rarity is taken from the benchmark alone, so copies in the corpus
cannot hide their own seeds. An ``N``-gram that is met in a text proposes a stretch of words (a
diagonal), and so do two pairs on nearby diagonals, or one of an item of under ``LONG`` words. A stretch that holds too few of the item's words for the threshold is dropped, as no
alignment can reach it; each other one is aligned with the item, match +2, other word or gap -1. The
score is the best alignment's over that of a perfect one, so edited, reordered or partly quoted items
score by what they keep. No text is shuffled. A copy that keeps neither ``N`` words in a row nor so
many rare pairs is not met.

Items of fewer than ``N`` words are no test passage inside running text; they match a line that
consists of them. Items without words match nothing, as do null and empty texts.
Repeated item_ids with different texts are aligned one by one, the best counts, and so for repeated
doc_ids. Rows without an id are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import textvec as tv

N = 3
LONG = 8
RARE = 8  # places in a benchmark block up to which a pair of words is a seed
BLOCK_WORDS = 2_000_000  # 16 MB of word hashes and about 48 MB of seeds
THRESHOLD = 0.4
MATCH, MISS = 2, -1
PAIRS = 512  # alignments done together
SEEDS = 1 << 20  # seeds held together, or those of one text


@dataclass
class Items:
    """A block of the benchmark: word hashes, item by item, and its n-grams."""

    ids: np.ndarray
    words: np.ndarray
    begins: np.ndarray
    grams: np.ndarray  # sorted hashes
    item: np.ndarray  # of each gram
    place: np.ndarray  # of each gram in its item
    worth: np.ndarray  # of each gram: 2, or 1 of a pair in an item of LONG words or more
    short: np.ndarray  # sorted hashes of the items of fewer than N words
    short_item: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: list[str]) -> Items:
        w = tv.words(pa.array(texts, pa.string()), tv.MARKS)
        begins = np.searchsorted(w.row, np.arange(len(texts) + 1))
        at, h = tv.grams(w, N)
        at2, h2 = tv.grams(w, 2)
        _, which, places = np.unique(h2, return_inverse=True, return_counts=True)
        rare = (places[which] <= RARE) & (np.diff(begins)[w.row[at2]] >= N)
        worth = np.where(np.diff(begins)[w.row[at2]] < LONG, 2, 1)[rare]
        worth = np.concatenate([np.full(len(at), 2), worth])
        at, h = np.concatenate([at, at2[rare]]), np.concatenate([h, h2[rare]])
        order = np.argsort(h, kind="stable")
        at = at[order]
        item = w.row[at]
        short, short_item = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k in range(1, N):
            at_k, h_k = tv.grams(w, k)
            alone = np.diff(begins)[w.row[at_k]] == k
            short.append(h_k[alone])
            short_item.append(w.row[at_k][alone])
        short, short_item = np.concatenate(short), np.concatenate(short_item)
        by_hash = np.argsort(short, kind="stable")
        return cls(
            np.array(ids, np.int64), w.hash, begins, h[order], item, at - begins[item], worth[order],
            short[by_hash], short_item[by_hash],
        )


def align(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each row pair and the window place where it ends; 0 is no word."""
    n, width = windows.shape
    drift = np.arange(1, width + 1) * -MISS
    above = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        word = items[:, i, None]
        step = np.where((word == windows) & (word != 0), MATCH, MISS)
        h = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] + MISS), 0)
        h = np.maximum.accumulate(h + drift, axis=1) - drift
        above[:, 1:] = h
        top = h.max(1)
        better = top > best
        best[better], end[better] = top[better], h[better].argmax(1)
    return best, end


def hits(w: tv.Words, items: Items, keys: np.ndarray, sieve: np.ndarray):
    """(row, item, first word of the item's place in the row, worth) of every seed met, in parts of rows."""
    found = [tv.grams(w, k) for k in (2, N)]
    at, h = (np.concatenate(x) for x in zip(*found, strict=True))
    hit, key = tv.find(keys, h, sieve)
    order = np.argsort(at[hit], kind="stable")
    hit, key = hit[order], key[order]
    low = np.searchsorted(items.grams, keys[key])
    n = np.searchsorted(items.grams, keys[key], "right") - low
    rows, total = w.row[at[hit]], np.concatenate([[0], np.cumsum(n)])
    start = 0
    while start < len(hit):
        stop = max(int(np.searchsorted(total, total[start] + SEEDS, "right")) - 1, start + 1)
        if stop < len(hit):
            whole = int(np.searchsorted(rows, rows[stop]))
            stop = whole if whole > start else int(np.searchsorted(rows, rows[start], "right"))
        m = n[start:stop]
        which = np.repeat(np.arange(start, stop), m)
        seed = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m) + low[which]
        word = at[hit][which]
        begins = np.searchsorted(w.row, w.row[word])
        yield w.row[word], items.item[seed], word - begins - items.place[seed], items.worth[seed]
        start = stop


def short_lines(column: pa.Array, w: tv.Words, items: Items):
    """(row, item, last word in the row) of the lines that consist of an item of fewer than N words."""
    data, bounds = tv.buffers(column)
    line = np.searchsorted(np.flatnonzero(data == 10), bounds[w.row] + w.start) + w.row
    first = np.flatnonzero(np.diff(line, prepend=-1))
    count = np.diff(first, append=len(line))
    rows, which, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, N):
        at, h = tv.grams(w, k)
        alone = np.isin(at, first[count == k])
        at, h = at[alone], h[alone]
        low, high = (np.searchsorted(items.short, h, side) for side in ("left", "right"))
        n = high - low
        hit = np.repeat(np.arange(len(at)), n)
        own = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + low[hit]
        rows.append(w.row[at[hit]])
        which.append(items.short_item[own])
        last.append(at[hit] + k - 1 - np.searchsorted(w.row, w.row[at[hit]]))
    return np.concatenate(rows), np.concatenate(which), np.concatenate(last)


def reachable(held, place, items: Items, item, begin, end, threshold: float) -> np.ndarray:
    """Whether a stretch has enough of its item's words: a score is at most the share that match.

    ``held`` has (word number, position) of the texts as sorted sums, ``place`` the numbers of the
    items' words, both in units of ``held``.
    """
    n = items.begins[item + 1] - items.begins[item]
    which = np.repeat(np.arange(len(n)), n)
    own = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + items.begins[item][which]
    low = np.searchsorted(held, place[own] + begin[which])
    some = low < np.searchsorted(held, place[own] + end[which])
    return np.bincount(which, some, minlength=len(n)) / n >= threshold


def found_rows(ids: pa.Array, row, item_id, score, seeds, last) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(row)), pa.array(item_id), pa.array(score), pa.array(seeds), pa.array(last)],
        ["doc_id", "item_id", "score", "seeds", "last_word"],
    )


def _aligned(
    batches: Iterator[pa.RecordBatch], shared, threshold: float
) -> Iterator[pa.RecordBatch]:
    items = shared.value
    keys = np.unique(items.grams)
    sieve = tv.sieve(keys)
    vocabulary, number = np.unique(items.words, return_inverse=True)
    known = tv.sieve(vocabulary)
    size = np.diff(items.begins)
    for whole in batches:
        for part in tv.slices(whole, "text", 1 << 20):
            w = tv.words(part.column(1), tv.MARKS)
            ids = part.column(0).cast(pa.int64())
            held = None
            if len(items.short) and len(w):
                r, i, last = short_lines(part.column(1), w, items)
                yield found_rows(ids, r, items.ids[i], np.ones(len(r)), np.ones(len(r), np.int64), last)
            for row, item, diagonal, worth in hits(w, items, keys, sieve):
                # Seeds of one item on nearby diagonals share a window of one and a half item
                # lengths on either side; diagonals are grouped by half an item length.
                half = np.maximum(size[item] // 2, 4)
                cell = np.floor_divide(diagonal, half)
                order = np.lexsort((cell, item, row))
                row, item, cell = row[order], item[order], cell[order]
                new = np.ones(len(row), bool)
                new[1:] = (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(cell) != 0)
                at = np.flatnonzero(new)
                n = np.diff(at, append=len(row))
                enough = np.add.reduceat(worth[order], at) >= 2 if len(at) else np.zeros(0, bool)
                at, n = at[enough], n[enough]
                row, item, cell = row[at], item[at], cell[at]
                if not len(row):
                    continue
                if held is None:
                    at, word = tv.find(vocabulary, w.hash, known)
                    held = np.sort(word * (len(w) + 1) + at)
                    place = number * (len(w) + 1)
                first = np.searchsorted(w.row, row)
                stop = np.searchsorted(w.row, row, "right")
                half = np.maximum(size[item] // 2, 4)
                begin = np.maximum(first + (cell - 1) * half, first)
                end = np.minimum(first + (cell + 2) * half + size[item] + 1, stop)
                good = [np.zeros(0, bool)]
                for k in range(0, len(row), PAIRS):
                    own = slice(k, k + PAIRS)
                    x = item[own], begin[own], end[own]
                    good.append(reachable(held, place, items, *x, threshold))
                good = np.flatnonzero(np.concatenate(good))
                # Windows of like size are aligned together.
                order = good[np.lexsort(((end - begin)[good], size[item[good]]))]
                out: list[tuple[np.ndarray, ...]] = []
                for k in range(0, len(order), PAIRS):
                    own = order[k : k + PAIRS]
                    m, wide = int(size[item[own]].max()), int((end - begin)[own].max())
                    col = np.arange(m)
                    where = items.begins[item[own], None] + col
                    a = items.words[np.minimum(where, len(items.words) - 1)]
                    a = np.where(col < size[item[own], None], a, np.uint64(0))
                    where = begin[own, None] + np.arange(wide)
                    b = w.hash[np.minimum(where, len(w) - 1)]
                    b = np.where(where < end[own, None], b, np.uint64(1))
                    best, last = align(a, b)
                    score = best / (MATCH * size[item[own]])
                    good = score >= threshold
                    out.append(
                        (row[own][good], item[own][good], score[good], n[own][good],
                         (begin[own] + last - first[own])[good])
                    )
                if out:
                    r, i, s, seeds, last = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield found_rows(ids, r, items.ids[i], s, seeds, last)


def blocks(benchmark: DataFrame, size: int = BLOCK_WORDS) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, one in memory at a time."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna()
    total = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // (4 * size) + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        rows = sorted((r.item_id, r.text) for r in b.filter(part == i).collect())
        yield Items.of([r[0] for r in rows], [r[1] for r in rows])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, size: int = BLOCK_WORDS
) -> DataFrame:
    """(doc_id, item_id, score, seeds, last_word): documents that hold (most of) a test item.

    ``seeds`` counts the n-grams met on the stretch, ``last_word`` is where it ends.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select("doc_id", "text").dropna()
    found = None
    for items in blocks(benchmark, size):
        shared = sc.broadcast(items)
        part = texts.mapInArrow(
            lambda it, s=shared: tv.lean(_aligned(it, s, threshold)),
            "doc_id long, item_id long, score double, seeds long, last_word long",
        )
        found = part if found is None else found.union(part)
    best = F.max(F.struct("score", "seeds", "last_word")).alias("best")
    found = found.groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "best.score", "best.seeds", "best.last_word")
