"""Secret spans: fixed patterns, and a linear-chain conditional random field that adds to them.

Tokens are runs of letters, digits and ``+/_.-``; each is tagged secret begin, inside or outside.
Its score adds weights of its own shape (length, kinds of characters, share of digits, changes
between kinds, known beginnings), the marks before and after it, key words near it, its neighbours'
shapes, and features of the file (marks of code, share of digits). The field is trained on windows
of a bounded sample whose tags come from the patterns, with key words dropped at random so that
shape and file have to speak, too. Viterbi finds the best tags of each whole text.

Most texts are settled without it: with ``slack`` the most that transitions can gain over staying
outside, a tagged stretch must hold a token whose own gain exceeds ``-slack``; texts without such a
token are outside throughout, exactly as Viterbi would find.

Pattern spans stay as they are; a decoded span is added as kind ``crf`` unless it overlaps one of
them or is shorter than ``MIN_CHARS``. Positions are code points, end exclusive. Null and empty
texts have no spans. Repeated rows are scanned one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import textvec as tv
from opinara.session import staged

SAMPLE = 2000  # bound of the texts with, and of those without, a pattern span to train on
REACH = 15  # tokens on either side of a span that are trained on
WINDOWS = 3000  # bound of the training windows
MIN_CHARS = 12
ROUNDS = 80
PART = 1 << 18  # bytes of text that are scanned together; its tokens take some sixty times as much

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Pattern spans by start, then by kind as listed."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    # A run of 32 or more is the whole run, as a shorter one would have been dropped.
    out += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- tokens and features -------------------------------------------------------------------

_INSIDE = np.zeros(256, bool)
_INSIDE[[ord(c) for c in "+/_.-"]] = True
for _range in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _INSIDE[_range[0] : _range[1]] = True
OUTSIDE = ~_INSIDE

_KEYWORDS = "password passwd pwd secret token key apikey api_key access_key auth bearer credential"
_HEADS = "AKIA ghp_ xoxb eyJh sk_l AIza"
_LENGTHS = np.array([4, 8, 12, 16, 20, 28, 32, 40, 64])
#: Sizes of the categories; their weights lie one after another.
PARTS = {
    "length": 10,
    "kinds": 64,
    "digits": 5,
    "changes": 6,
    "head": 2,
    "before": 8,
    "after": 8,
    "key": 2,
    "key1": 2,
    "key2": 2,
    "next": 2,
    "kinds_before": 64,
    "kinds_after": 64,
    "length_kinds": 640,
    "file_marks": 4,
    "file_digits": 4,
}
_BASE = dict(zip(PARTS, np.cumsum([0, *PARTS.values()])[:-1].tolist(), strict=True))
SIZE = sum(PARTS.values())


def _known(words: str, fold: bool) -> np.ndarray:
    return np.unique(tv.words(pa.array([words]), fold=fold).hash)


def tokens(column: pa.Array) -> tuple[tv.Words, np.ndarray]:
    """Tokens of a batch and the category of each in every part (tokens x parts)."""
    data, bounds = tv.buffers(column)
    w = tv.words_of(data, bounds, OUTSIDE, fold=True)
    n = len(w)
    if not n:
        return w, np.zeros((0, len(PARTS)), np.int32)
    s, e = w.start + bounds[w.row], w.end + bounds[w.row]
    size = e - s

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return total[e] - total[s]

    digit = (data >= 48) & (data <= 57)
    upper = (data >= 65) & (data <= 90)
    hexa = ((data >= 97) & (data <= 102)) | digit
    lower = (data >= 97) & (data <= 122)
    high = data >= 128
    kind = digit.astype(np.int8) + 2 * upper.astype(np.int8) + 3 * (lower | high).astype(np.int8)
    change = np.zeros(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    digits, uppers, lowers, highs = count(digit), count(upper), count(lower), count(high)
    marks = size - digits - uppers - lowers - highs
    flags = (
        (digits > 0) + 2 * (uppers > 0) + 4 * (lowers > 0) + 8 * (highs > 0) + 16 * (marks > 0)
        + 32 * (count(hexa) == size)
    ).astype(np.int32)
    length = np.searchsorted(_LENGTHS, size, "right").astype(np.int32)
    share = np.where(digits == 0, 0, 1 + np.minimum(3, 4 * digits // np.maximum(size, 1)))
    turns = np.minimum(5, 8 * np.maximum(count(change) - change[s], 0) // np.maximum(size, 1))
    key = np.isin(w.hash, _known(_KEYWORDS, True))
    head = np.zeros(n, bool)
    for text in _HEADS.split():
        hit = size > len(text)
        for i, c in enumerate(text.encode()):
            hit &= data[np.minimum(s + i, len(data) - 1)] == c
        head |= hit

    def gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What lies between two places: bits for = or :, quotes, line feed."""
        out = np.zeros(n, np.int32)
        for bit, chars in ((1, "=:"), (2, "\"'`"), (4, "\n")):
            mask = np.isin(data, [ord(c) for c in chars])
            total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
            out += bit * (total[b] > total[a])
        return out

    same = np.zeros(n, bool)
    same[1:] = w.row[1:] == w.row[:-1]
    before_from = np.where(same, np.concatenate([[0], e[:-1]]), bounds[w.row])
    last = np.append(~same[1:], True)
    after_to = np.where(last, bounds[w.row + 1], np.append(s[1:], 0))
    before, after = gap(before_from, s), gap(e, after_to)

    def back(x, k, empty=0):
        out = np.full(n, empty, np.int32)
        if n > k:
            out[k:] = np.where(w.row[k:] == w.row[:-k], x[:-k], empty)
        return out

    def ahead(x, empty=0):
        out = np.full(n, empty, np.int32)
        out[:-1] = np.where(same[1:], x[1:], empty)
        return out

    rows = len(bounds) - 1
    whole = np.maximum(np.diff(bounds), 1)
    file_marks = np.isin(data, [ord(c) for c in "=:;{}()\"'"])
    sums = np.concatenate([[0], np.cumsum(file_marks)])
    marked = np.searchsorted([0.002, 0.01, 0.04], (sums[bounds[1:]] - sums[bounds[:-1]]) / whole)
    sums = np.concatenate([[0], np.cumsum(digit)])
    numeric = np.searchsorted([0.002, 0.02, 0.1], (sums[bounds[1:]] - sums[bounds[:-1]]) / whole)
    assert len(marked) == rows
    columns = [
        length, flags, share, turns, head, before, after, key, back(key, 1), back(key, 2),
        ahead(key), back(flags, 1), ahead(flags), length * 64 + flags, marked[w.row], numeric[w.row],
    ]
    return w, np.stack([np.asarray(c, np.int32) for c in columns], axis=1)


# --- the field ------------------------------------------------------------------------------

B, I, O = 0, 1, 2


@dataclass
class Field:
    """Weights (SIZE x 3) of the categories and (3 x 3) of neighbouring tags; ``start`` of the first."""

    weights: np.ndarray
    steps: np.ndarray
    start: np.ndarray

    @property
    def slack(self) -> float:
        steps = np.where(self.steps < -1e5, -np.inf, self.steps)
        gain = max(float(steps.max() - steps[O, O]), float((self.start - self.start[O]).max()))
        return max(0.0, gain)

    def scores(self, categories: np.ndarray) -> np.ndarray:
        out = np.zeros((len(categories), 3))
        for j, base in enumerate(_BASE.values()):
            out += self.weights[base + categories[:, j]]
        return out

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best tags of one sequence."""
        n = len(scores)
        best = scores[0] + self.start
        from_ = np.zeros((n, 3), np.int8)
        steps, rows = self.steps.T.tolist(), scores.tolist()
        best = best.tolist()
        for t in range(1, n):
            now = []
            for j in range(3):
                a, b, c = best[0] + steps[j][0], best[1] + steps[j][1], best[2] + steps[j][2]
                k = 2 if c >= a and c >= b else (0 if a >= b else 1)
                from_[t, j] = k
                now.append((a, b, c)[k] + rows[t][j])
            best = now
        tags = np.zeros(n, np.int8)
        tags[-1] = 2 if best[2] >= max(best[0], best[1]) else (0 if best[0] >= best[1] else 1)
        for t in range(n - 1, 0, -1):
            tags[t - 1] = from_[t, tags[t]]
        return tags

    def decode(self, row: np.ndarray, categories: np.ndarray) -> np.ndarray:
        """Tags of all tokens of a batch; rows that cannot hold a secret are outside at once."""
        scores = self.scores(categories)
        tags = np.full(len(row), O, np.int8)
        own = np.maximum(scores[:, B], scores[:, I]) - scores[:, O]
        hot = np.unique(row[own + 2 * self.slack >= 0])
        for a, b in zip(np.searchsorted(row, hot), np.searchsorted(row, hot, "right"), strict=True):
            tags[a:b] = self.viterbi(scores[a:b])
        return tags


FORBIDDEN = -1e6


def train(windows: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam; forward-backward over all windows."""
    steps0 = np.zeros((3, 3))
    steps0[O, I] = FORBIDDEN
    start0 = np.array([0.0, FORBIDDEN, 0.0])
    if not windows:
        weights = np.zeros((SIZE, 3))
        weights[:, O] = 1.0
        return Field(weights, steps0, start0)
    rng = np.random.default_rng(5)
    n, longest = len(windows), max(len(t) for _, t in windows)
    tags = np.full((n, longest), -1, np.int8)
    cats = np.zeros((n, longest, len(PARTS)), np.int32)
    for i, (c, t) in enumerate(windows):
        cats[i, : len(t)], tags[i, : len(t)] = c, t
    names = list(PARTS)
    dropped = rng.random(n) < 0.3
    for name in ("key", "key1", "key2", "next"):
        cats[dropped, :, names.index(name)] = 0
    cats += np.array(list(_BASE.values()), np.int32)
    live = tags >= 0
    flat, gold = cats[live], tags[live]
    w, s = np.zeros((SIZE, 3)), steps0.copy()
    use = steps0 > FORBIDDEN / 2
    truth = np.zeros((SIZE, 3))
    for j in range(len(PARTS)):
        np.add.at(truth, (flat[:, j], gold), 1)
    pair_live = live[:, 1:]
    pair_truth = np.zeros((3, 3))
    np.add.at(pair_truth, (tags[:, :-1][pair_live], tags[:, 1:][pair_live]), 1)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(s), np.zeros_like(s)]
    for r in range(1, rounds + 1):
        scores = np.zeros((n, longest, 3))
        scores[live] = w[flat].sum(1)
        step = np.exp(np.clip(s, -50, 50)) * use
        emit = np.exp(scores - scores.max(2, keepdims=True))
        forward = np.zeros((longest, n, 3))
        forward[0] = emit[:, 0] * np.array([1.0, 0.0, 1.0])
        forward[0] /= forward[0].sum(1, keepdims=True)
        for t in range(1, longest):
            f = (forward[t - 1] @ step) * emit[:, t]
            forward[t] = np.where(live[:, t, None], f / f.sum(1, keepdims=True), forward[t - 1])
        back = np.ones((n, 3))
        node = np.zeros((n, longest, 3))
        pairs = np.zeros((3, 3))
        for t in range(longest - 1, -1, -1):
            p = forward[t] * back
            node[:, t] = p / p.sum(1, keepdims=True)
            if t:
                right = emit[:, t] * back
                both = forward[t - 1][:, :, None] * step[None] * right[:, None, :]
                both /= both.sum((1, 2), keepdims=True)
                pairs += both[live[:, t]].sum(0)
                new = right @ step.T
                back = np.where(live[:, t, None], new / new.sum(1, keepdims=True), back)
        found = np.zeros((SIZE, 3))
        expected = node[live]
        for j in range(len(PARTS)):
            for k in range(3):
                found[:, k] += np.bincount(flat[:, j], expected[:, k], minlength=SIZE)
        grads = [(found - truth) / n + 1e-3 * w, ((pairs - pair_truth) / n + 1e-3 * s) * use]
        for x, g, m1, m2 in ((w, grads[0], *moments[:2]), (s, grads[1], *moments[2:])):
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            m2 += 0.01 * g * g
            x -= 0.1 * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
        s[~use] = FORBIDDEN
    return Field(w, s, start0)


def _secret_bytes(text: str) -> list[tuple[int, int]]:
    """Byte ranges of the secrets themselves: the value of an assignment, the whole of others."""
    spans = [m.span(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    spans += [(a, b) for kind, a, b in base_spans(text) if kind != "assign"]
    at = lambda i: len(text[:i].encode())
    return [(at(a), at(b)) for a, b in spans]


def training_windows(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows of categories and tags around pattern spans and at even places of other texts.

    All texts give windows; the ``WINDOWS`` of smallest hash train the field, whatever their order.
    """
    out = []
    for text in texts:
        w, cats = tokens(pa.array([text]))
        if not len(w):
            continue
        tags = np.full(len(w), O, np.int8)
        centres = []
        for a, b in _secret_bytes(text):
            inside = np.flatnonzero((w.start < b) & (w.end > a))
            if len(inside):
                tags[inside] = np.where(tags[inside] == O, I, tags[inside])
                tags[inside[0]] = B
                centres.append(int(inside[0]))
        centres += list(range(REACH, len(w), max(len(w) // 2, 2 * REACH)))[:2] or [0]
        # Tokens with digits are where a text without a secret looks most like one.
        share = cats[:, list(PARTS).index("digits")]
        odd = np.flatnonzero((share > 0) & (tags == O))
        centres += odd[:: max(1, len(odd) // 2)][:2].tolist()
        own = hashlib.sha256(text.encode()).digest()
        for number, c in enumerate(centres):
            a, b = max(0, c - REACH), min(len(w), c + REACH + 1)
            if tags[a] == I:
                a = int(np.flatnonzero(tags[: a + 1] == B)[-1])
            place = hashlib.sha256(own + number.to_bytes(8, "big")).digest()
            out.append((place, cats[a:b], tags[a:b]))
    out.sort(key=lambda x: x[0])
    return [x[1:] for x in out[:WINDOWS]]


def fit(docs: DataFrame) -> Field:
    """Field of a bounded sample: the texts of smallest id hash with, and without, a pattern span."""
    texts = docs.select("doc_id", "text").dropna().filter(F.length("text") < 20_000)
    hit = F.col("text").rlike(
        r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
        r"|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}"
    )
    marked = staged(
        texts.select("doc_id", F.xxhash64("doc_id").alias("h"), hit.alias("hit")), "crf-marks"
    )
    picked = [
        marked.filter(F.col("hit") == want).orderBy("h", "doc_id").limit(SAMPLE).select("doc_id")
        for want in (True, False)
    ]
    chosen = staged(picked[0].union(picked[1]).distinct(), "crf-sample")
    rows = texts.join(chosen, "doc_id").dropDuplicates(["doc_id"])
    found = sorted((r.doc_id, r.text) for r in rows.collect())
    return train(training_windows([t for _, t in found]))


# --- scanning -------------------------------------------------------------------------------


def spans(column: pa.Array, field: Field) -> list[list[Span]]:
    """All spans of each text: the patterns', then what the field adds, by start and kind."""
    texts = [t or "" for t in column.to_pylist()]
    out = [base_spans(t) for t in texts]
    w, cats = tokens(column)
    if not len(w):
        return out
    tags = field.decode(w.row, cats)
    for i in np.flatnonzero(tags == B).tolist():
        j = i + 1
        while j < len(w) and tags[j] == I and w.row[j] == w.row[i]:
            j += 1
        row = int(w.row[i])
        data = texts[row].encode()
        a = len(data[: w.start[i]].decode())
        b = a + len(data[w.start[i] : w.end[j - 1]].decode())
        base = out[row]
        if b - a >= MIN_CHARS and not any(a < y and x < b for _, x, y in base):
            base.append(("crf", a, b))
    for found in out:
        found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def _joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch], field) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in tv.slices(whole, "text", PART):
            found = spans(part.column(1), field.value)
            base = [[s for s in x if s[0] != "crf"] for x in found]
            counts = [
                pa.array([sum(s[0] == kind for s in x) for x in base], pa.int64())
                for kind in KINDS[:3]
            ]
            digest = [hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(pa.int64()),
                    *counts,
                    pa.array(digest, pa.string()),
                    pa.array([_joined(x) for x in found], pa.string()),
                ],
                [f.split()[0] for f in SCHEMA.split(", ")],
            )


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """Counts, digest of the pattern spans and all spans of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return docs.select("doc_id", "text").mapInArrow(lambda it: tv.lean(_scan(it, shared)), SCHEMA)


def _mask(batches: Iterator[pa.RecordBatch], field, mark: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in tv.slices(whole, "text", PART):
            at = part.schema.get_field_index("text")
            column = part.column(at)
            texts = column.to_pylist()
            for i, found in enumerate(spans(column, field.value)):
                if found:
                    text, kept, end = texts[i], [], 0
                    for _, a, b in found:
                        if b > end:
                            if a >= end:
                                kept += [text[end:a], mark]
                            end = b
                    texts[i] = "".join([*kept, text[end:]])
            yield part.set_column(at, part.schema.field(at), pa.array(texts, column.type))


def mask(docs: DataFrame, field: Field, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark``; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return docs.mapInArrow(lambda it: tv.lean(_mask(it, shared, mark)), docs.schema)

