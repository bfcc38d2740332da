"""Words of Arrow text columns as numpy arrays: positions and 64-bit hashes, no Python strings.

Words are cut and hashed on the UTF-8 bytes of a whole batch at once. Texts are walked in pieces of
about ``PIECE`` bytes that end at a word boundary, so scratch memory stays flat however long a text
is; what remains per word is a few integers. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 16
TRIM = 16  # batches after which a worker gives free memory back
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, dtype=_U) + _U((seed * _BASE + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_CODE = mix(np.arange(256)) | _U(1)
_FOLDED = _CODE.copy()
_FOLDED[65:91] = _CODE[97:123]

BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
# Everything in ASCII that is neither a letter nor a digit.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for the worker's life."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 2 * PIECE)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base & _MASK, dtype=_U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=_U)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """One entry per word: row in the batch, byte bounds in the row's text, hash."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    extra: dict[str, np.ndarray] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.row)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    raw = column.buffers()
    if not len(column) or raw[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def _pieces(data, bounds, cuts) -> Iterator[tuple[int, int]]:
    """Cut points at a separator or a row bound, about PIECE bytes apart."""
    at, n = 0, len(data)
    while at < n:
        to, reach = min(at + PIECE, n), PIECE
        while to < n:
            row = bounds[np.searchsorted(bounds, to, "right") - 1]
            near = max(at, to - 512)
            seps = np.flatnonzero(cuts[data[near:to]])
            if not len(seps):
                near, seps = at, np.flatnonzero(cuts[data[at:to]])
            best = max(int(row), near + int(seps[-1]) + 1 if len(seps) else 0)
            if best > at:
                to = best
                break
            reach *= 2
            to = min(at + reach, n)
        yield at, to
        at = to


def words(column: pa.Array, cuts: np.ndarray = BLANKS, fold: bool = True, heads=(), tails=()):
    """All words of a batch. ``cuts`` marks the separating bytes, ``fold`` lower-cases A-Z.

    ``heads`` and ``tails`` name byte lengths; the hash of each word's first or last so many bytes
    is returned under ``extra`` (0 where the word is not longer than that).
    """
    return words_of(*buffers(column), cuts, fold, heads, tails)


def words_of(data, bounds, cuts=BLANKS, fold=True, heads=(), tails=()) -> Words:
    """`words` of bytes and row bounds."""
    code = _FOLDED if fold else _CODE
    parts: list[tuple[np.ndarray, ...]] = []
    for at, to in _pieces(data, bounds, cuts):
        v = data[at:to]
        inside = ~cuts[v]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, to)] - at
        edges = edges[edges < len(v)]
        first[edges] = inside[edges]
        edges = edges[edges > 0]
        last[edges - 1] = inside[edges - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(s):
            continue
        up, down = _power(len(v) + 1)
        total = np.zeros(len(v) + 1, _U)
        np.cumsum(code[v] * up[: len(v)], out=total[1:])

        def span(a, b, total=total, down=down):
            return mix((total[b] - total[a]) * down[a] + (b - a).astype(_U))

        more = [np.where(e - s > k, span(s, np.minimum(s + k, e)), _U(0)) for k in heads]
        more += [np.where(e - s > k, span(np.maximum(e - k, s), e), _U(0)) for k in tails]
        parts.append((s + at, e + at, span(s, e), *more))
    width = 3 + len(heads) + len(tails)
    if parts:
        got = [np.concatenate(x) for x in zip(*parts, strict=True)]
    else:
        got = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, _U)] * (width - 2)
    row = np.searchsorted(bounds, got[0], "right") - 1
    # Empty rows share an offset with the next row; searchsorted picks the last of them.
    names = [f"head{k}" for k in heads] + [f"tail{k}" for k in tails]
    base = bounds[row] if len(row) else np.zeros(0, np.int64)
    return Words(row, got[0] - base, got[1] - base, got[2], dict(zip(names, got[3:], strict=True)))


def find(keys: np.ndarray, x: np.ndarray, filter_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into x, index into the sorted keys) of the values that are keys. See `sieve`."""
    at = np.flatnonzero(filter_[(x & _U(len(filter_) - 1)).astype(np.int64)])
    place = np.searchsorted(keys, x[at])
    hit = np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == x[at]) if len(keys) else at[:0]
    return at[hit], place[hit]


def sieve(keys: np.ndarray) -> np.ndarray:
    """A table that tells most values that are no keys at one lookup each."""
    size = 1 << max(16, int(np.ceil(np.log2(max(len(keys), 1)))) + 5)
    out = np.zeros(size, bool)
    out[(keys & _U(size - 1)).astype(np.int64)] = True
    return out


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of ``k`` words inside one row."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    total = np.zeros(n, _U)
    for i in range(k):
        total = total * _U(_BASE) + w.hash[i : i + n]
    at = np.flatnonzero(w.row[:n] == w.row[k - 1 : k - 1 + n])
    return at, mix(total[at], k)


def slices(batch: pa.RecordBatch, text: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each; a longer text is a part alone."""
    _, bounds = buffers(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Give free memory back to the system, which Arrow and glibc else keep for the worker's next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches. After every ``TRIM`` of them and at the end, free memory is given back."""
    number = 0
    for part in parts:
        yield part
        part = None
        number += 1
        if number % TRIM == 0:
            release()
    release()


def signed(x: np.ndarray) -> np.ndarray:
    """Hashes as Spark's LONG."""
    return x.view(np.int64) if x.dtype == _U else x.astype(np.int64)
