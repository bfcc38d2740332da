"""Fill-in-the-middle transformation over a sparse exception index.

A text is cut into prefix, middle and suffix and written with sentinels in prefix-suffix-middle or
suffix-prefix-middle order. Cuts fall between units (letter runs and single other characters), found
on the UTF-8 bytes of a whole batch. Between bytes and code points a batch is converted by
`Exceptions`: it records only multibyte characters, their positions and excess bytes, so a cut is
moved by one ``searchsorted`` and a stretch of ASCII costs plain arithmetic.

Nulls count as empty texts; empty texts and texts that hold a sentinel stay plain. Cuts depend on
seed and doc_id alone, so repeated rows and ids are cut alike; a null id counts as an empty number.
Extra columns are ignored, whatever their names. Bytes are walked in pieces of ``PIECE``, so besides the text itself scratch memory is flat but for
sixteen bytes per multibyte character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm import textvec as tv

PIECE = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20

_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_INNER = np.array([b & 0xC0 == 0x80 for b in range(256)])
_EXCESS = np.array([0] * 192 + [1] * 32 + [2] * 16 + [3] * 16, np.int64)

SCHEMA = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
)


class Exceptions:
    """Multibyte characters of a byte string: where they end and how many bytes they are too long.

    Positions are kept both in bytes and in code points, ascending, with the excess so far.
    """

    def __init__(self, data: np.ndarray):
        lead = np.concatenate(
            [at + np.flatnonzero(data[at : at + PIECE] >= 0xC0) for at in range(0, len(data), PIECE)]
            or [np.zeros(0, np.int64)]
        )
        excess = _EXCESS[data[lead]]
        self.total = np.concatenate([[0], np.cumsum(excess)])
        self.byte = lead + excess + 1
        self.char = self.byte - self.total[1:]

    def char_of(self, byte: np.ndarray) -> np.ndarray:
        """Code-point offsets of byte offsets that lie on character bounds."""
        return byte - self.total[np.searchsorted(self.byte, byte, "right")]

    def byte_of(self, char: np.ndarray) -> np.ndarray:
        """Byte offsets of code-point offsets."""
        return char + self.total[np.searchsorted(self.char, char, "right")]


def _unit_starts(data: np.ndarray, bounds: np.ndarray, by_char: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, mask) per piece: bytes at which a unit begins. Every row begins one."""
    for at in range(0, len(data), PIECE):
        v = data[at : at + PIECE]
        start = ~_INNER[v]
        if not by_char:
            letter = _LETTER[v]
            start[1:] &= ~(letter[1:] & letter[:-1])
            if at:
                start[0] &= not (letter[0] and _LETTER[data[at - 1]])
        edge = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, at + len(v))] - at
        start[edge] = True
        yield at, start


def _units_before(data: np.ndarray, bounds: np.ndarray, by_char: bool) -> np.ndarray:
    """Units that begin before each row bound."""
    out, seen = np.zeros(len(bounds), np.int64), 0
    for at, start in _unit_starts(data, bounds, by_char):
        first, last = np.searchsorted(bounds, [at, at + len(start)])
        total = np.cumsum(start)
        edge = bounds[first:last] - at
        out[first:last] = seen + np.where(edge > 0, total[edge - 1], 0)
        seen += int(total[-1])
    out[bounds == len(data)] = seen
    return out


def _unit_bytes(data, bounds, by_char: bool, wanted: np.ndarray) -> np.ndarray:
    """Byte offset at which each unit (counted over the batch, ascending) begins."""
    out, seen = np.full(len(wanted), len(data), np.int64), 0
    for at, start in _unit_starts(data, bounds, by_char):
        count = int(np.count_nonzero(start))
        a, b = np.searchsorted(wanted, [seen, seen + count])
        if a < b:
            out[a:b] = at + np.flatnonzero(start)[wanted[a:b] - seen]
        seen += count
    return out


def _draws(seed: int, ids: list) -> np.ndarray:
    """The first four 32-bit numbers of sha256 of ``seed:id`` per row."""
    text = (f"{seed}:{'' if i is None else i}".encode() for i in ids)
    raw = b"".join(hashlib.sha256(t).digest()[:16] for t in text)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def cut_batch(column: pa.Array, draws: np.ndarray, by_char: bool = False):
    """Units of each text and the byte and code-point ends of prefix and middle inside it."""
    data, bounds = tv.buffers(column)
    before = _units_before(data, bounds, by_char)
    n = np.diff(before)
    pick = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    # The end of a row's last unit is where the next row begins.
    flat = (before[:-1, None] + pick).ravel()
    order = np.argsort(flat, kind="stable")
    ends = np.empty(len(flat), np.int64)
    ends[order] = _unit_bytes(data, bounds, by_char, flat[order])
    ends = np.minimum(ends.reshape(-1, 2), bounds[1:, None])
    index = Exceptions(data)
    chars = index.char_of(ends) - index.char_of(bounds[:-1])[:, None]
    return data, bounds, n, ends, chars


def _transform(
    batches: Iterator[pa.RecordBatch], seed: int, by_char: bool, plain: int, spm: int
) -> Iterator[pa.RecordBatch]:
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    for whole in batches:
        for part in tv.slices(whole, "text"):
            draws = _draws(seed, part.column(0).to_pylist())
            data, bounds, n, ends, chars = cut_batch(part.column(1), draws, by_char)
            blob = memoryview(np.ascontiguousarray(data))
            forms, outs, prefix, middle = [], [], [], []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                text = bytes(blob[a:b])
                if not text or draws[i, 2] % 100 >= 100 - plain or any(x in text for x in marks):
                    forms.append("plain")
                    outs.append(text)
                    prefix.append(None)
                    middle.append(None)
                    continue
                one, two = (ends[i] - a).tolist()
                pre, mid, suf = text[:one], text[one:two], text[two:]
                as_spm = draws[i, 3] % 100 < spm
                forms.append("spm" if as_spm else "psm")
                outs.append(b"".join([s, suf, p, pre, m, mid] if as_spm else [p, pre, s, suf, m, mid]))
                prefix.append(int(chars[i, 0]))
                middle.append(int(chars[i, 1] - chars[i, 0]))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(forms, pa.string()),
                    pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()),
                    pa.array(outs, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def transform(
    docs: DataFrame,
    seed: int = 1,
    by_char: bool = False,
    plain: int = PLAIN_PERCENT,
    spm: int = SPM_PERCENT,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    ``n`` counts the units of the text, ``by_char`` makes every code point a unit. ``plain`` is the
    percentage left as it is, ``spm`` that of the others in suffix-prefix-middle order. Lengths
    are code points, null where the form is plain. One narrow pass: no shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _transform(it, seed, by_char, plain, spm), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from output and form alone.

    No text with a sentinel is cut, so the first sentinel of a kind is the one that was written.
    """
    body = F.substring(output, len(PREFIX) + 1, 2_147_483_647)
    inner = {"psm": SUFFIX, "spm": PREFIX}

    def parts(kind: str) -> tuple[Column, Column, Column]:
        rest = F.substring_index(body, inner[kind], -1)
        return (
            F.substring_index(body, inner[kind], 1),
            F.substring_index(rest, MIDDLE, 1),
            F.substring_index(rest, MIDDLE, -1),
        )

    pre, suf, mid = parts("psm")
    suf2, pre2, mid2 = parts("spm")
    return (
        F.when(form == "psm", F.concat(pre, mid, suf))
        .when(form == "spm", F.concat(pre2, mid2, suf2))
        .otherwise(output)
    )


def digest(docs: DataFrame, seed: int = 1) -> DataFrame:
    """`transform` with digests of the output and of the text restored from it."""
    out = transform(docs, seed)
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias(
            "restored_sha256"
        ),
    )
