"""Document quality by nearest-neighbour voting over labelled latent-semantic vectors.

A text is counted as hashed terms: the shapes of its words and of neighbouring pairs, words that
repeat the word before or the one before that, and the words themselves at a lower weight. Counts
are damped, weighted by idf and projected on the leading singular directions of the labelled rows.
The labelled vectors, at most ``LABELLED`` of ``DIMENSIONS`` numbers each (0.8 MB), are broadcast;
every document takes exact cosines with all of them, block by block, and the ``NEIGHBOURS`` nearest
vote, weighted by a power of their similarity.

Texts without words score 0: there is nothing to keep. Null texts count as empty. Repeated rows are
scored one by one. Without any labelled row every text with words scores 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import textvec as tv
from opinara.llm.sampling import fold, labelled_sample

LABELLED = 4096  # bound of the labelled rows that the model is fitted on
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 8
SHAPES, WORDS = 768, 256
TERMS = SHAPES + WORDS
WORD_WEIGHT = 0.25
BLOCK = 512
PART = 1 << 20  # bytes of text that are counted together

# Classes of bytes: small and non-ASCII letters, capitals, digits, sentence marks; others by byte.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = ord(".")


def _shapes(column: pa.Array) -> tuple[tv.Words, tv.Words]:
    """Words of a batch, and the same words as runs of byte classes."""
    data, bounds = tv.buffers(column)
    kind = _CLASS[data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    starts = bounds[:-1][bounds[:-1] < len(kind)]
    new[starts] = True
    kept = np.concatenate([[0], np.cumsum(new)])[bounds]
    return tv.words_of(data, bounds), tv.words_of(kind[new], kept, fold=False)


def counts(column: pa.Array) -> np.ndarray:
    """Damped term counts of each row (rows x TERMS)."""
    w, s = _shapes(column)
    rows = len(column)
    shape = s.hash % np.uint64(SHAPES - 2)
    terms = [w.row * TERMS + shape.astype(np.int64)]
    at, pair = tv.grams(s, 2)
    terms.append(s.row[at] * TERMS + (pair % np.uint64(SHAPES - 2)).astype(np.int64))
    for back in (1, 2):
        same = np.flatnonzero((w.hash[back:] == w.hash[:-back]) & (w.row[back:] == w.row[:-back]))
        terms.append(w.row[same + back] * TERMS + SHAPES - back)
    terms.append(w.row * TERMS + SHAPES + (w.hash % np.uint64(WORDS)).astype(np.int64))
    out = np.bincount(np.concatenate(terms), minlength=rows * TERMS).reshape(rows, TERMS)
    out = np.log1p(out).astype(np.float32)
    out[:, SHAPES:] *= WORD_WEIGHT
    return out


def block_counts(part: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """``part`` in blocks of ``BLOCK`` rows with their counts, 2 MB a block however short the texts are."""
    at = part.schema.get_field_index("text")
    for begin in range(0, part.num_rows, BLOCK):
        block = part.slice(begin, BLOCK)
        yield block, np.concatenate([counts(x.column(at)) for x in tv.slices(block, "text", PART)])


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(size > 0, size, 1)).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    label: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, label: np.ndarray) -> Model:
        """Singular directions of the weighted counts, and the labelled rows on them."""
        seen = (x > 0).sum(0)
        idf = (np.log((1 + len(x)) / (1 + seen)) + 1).astype(np.float32)
        rows = unit(x * idf)
        values, directions = np.linalg.eigh((rows.T @ rows).astype(np.float64))
        basis = directions[:, np.argsort(-values)[:DIMENSIONS]].astype(np.float32)
        return cls(idf, basis, unit(rows @ basis), label.astype(np.float32))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Weighted vote of the nearest labelled rows."""
        out = np.zeros(len(x))
        for at in range(0, len(x), BLOCK):
            own = x[at : at + BLOCK]
            if not len(self.label):
                out[at : at + BLOCK] = np.where(own.any(1), 0.5, 0.0)
                continue
            near = unit(unit(own * self.idf) @ self.basis) @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, 1), 1e-6) ** SHARPNESS
            vote = (weight * self.label[best]).sum(1) / weight.sum(1)
            out[at : at + BLOCK] = np.where(own.any(1), vote, 0.0)
        return np.clip(out, 0.0, 1.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in tv.slices(whole, "text"):
            for block, x in block_counts(part):
                terms = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [block.column(2).cast(pa.int32()), terms], ["label", "terms"]
                )


def fit(sample: DataFrame) -> Model:
    """Model of a bounded sample (doc_id, text, label). The counts come to the driver: 4 KB a row."""
    rows = sample.mapInArrow(lambda it: tv.lean(_counted(it)), "label int, terms binary").collect()
    x = np.frombuffer(b"".join(r.terms for r in rows), np.float32).reshape(len(rows), TERMS)
    keep = x.any(1)
    return Model.fit(x[keep], np.array([r.label for r in rows], np.float32)[keep])


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in tv.slices(whole, "text"):
            for block, x in block_counts(part):
                yield pa.RecordBatch.from_arrays(
                    [block.column(0).cast(pa.int64()), pa.array(model.value.score(x))],
                    ["doc_id", "score"],
                )


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select("doc_id", "text").mapInArrow(
        lambda it: tv.lean(_scored(it, shared)), "doc_id long, score double"
    )
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _kept(batches: Iterator[pa.RecordBatch], model, threshold: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in tv.slices(whole, "text"):
            for block, x in block_counts(part):
                yield block.filter(pa.array(model.value.score(x) >= threshold))


def kept(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents that reach the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: tv.lean(_kept(it, shared, threshold)), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, parts: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted); the held-out fold is never learned from."""
    model = fit(labelled_sample(docs, labels, "quality", LABELLED, parts, held_out))
    out = score(docs, model)
    is_held = F.coalesce(fold("doc_id", parts) == held_out, F.lit(False))
    return out.select("doc_id", is_held.alias("held_out"), "score", "predicted")
