"""Byte-level BPE encoding by speculation and verification, and decoding.

Speculate: the longest token that fits is taken, left to right. Verify: a token sequence is the BPE
encoding of its word exactly if each token is the encoding of its own bytes and every two
neighbours stay apart when their bytes are merged together. Neighbour tests run for all adjacent
pairs of a batch at once, by undoing merges on arrays; only words with a failing pair are merged
exactly. Encoded words are kept per worker in a table of bounded size.

Texts are cut by the tokenizer's pattern first; the text of a special token is that token, as the
library has it by default. Null and empty texts have no ids. The vocabulary file is a parameter and
is read on each worker; it must be installed there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from opinara.llm import textvec as tv

KEPT_WORDS = 200_000  # encoded words that a worker keeps, some 40 MB; most words of a corpus are met once
PART = 1 << 19  # bytes of text that are encoded together

# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges and tokens as arrays. Ids are the file's; ranks order the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        n = max([*ids.values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        self.bytes: list[bytes] = [b""] * n
        for text, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in text)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.of = {self.bytes[i]: i for i in ids.values()}
        self.single = [self.of[bytes([b])] for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in merges]
        self.rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(pairs)}
        none = len(pairs)
        self.result = np.array([c for _, _, c in pairs])
        self.made = np.full(n, -1, np.int64)  # rank of the merge that makes a token
        self.left, self.right = np.arange(n), np.arange(n)
        for r, (a, b, c) in enumerate(pairs):
            if self.made[c] < 0:
                self.made[c], self.left[c], self.right[c] = r, a, b
        key = np.array([(a << 32) | b for a, b, _ in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair_key = np.append(key[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(np.arange(none)[order], none)
        # Only tokens that are the encoding of their own bytes may be proposed.
        self.own = {b for b, i in self.of.items() if len(b) == 1 or self.merge(b) == [i]}
        self.reach = [0] * 65536  # longest proposable token by its first two bytes
        for b in self.own:
            if len(b) > 1:
                start = b[0] << 8 | b[1]
                self.reach[start] = max(self.reach[start], len(b))
        self.cut = regex.compile(PATTERN)
        self.split = (
            regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
            if self.special
            else None
        )
        self.parts: dict[str, bytes | None] = {}

    def merge(self, data: bytes) -> list[int]:
        """Exact encoding of one word: the earliest merge first, leftmost among equals."""
        parts = [self.single[b] for b in data]
        while len(parts) > 1:
            best = min(
                ((self.rank[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.rank),
                default=None,
            )
            if best is None:
                break
            pair = (parts[best[1]], parts[best[1] + 1])
            made, out, i = self.rank[pair][1], [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(made)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def propose(self, data: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, of, own = [], 0, len(data), self.of, self.own
        while at < n:
            if at + 1 < n:
                to = min(n, at + self.reach[data[at] << 8 | data[at + 1]])
                while to > at + 1 and data[at:to] not in own:
                    to -= 1
                to = max(to, at + 1)
            else:
                to = n
            out.append(of[data[at:to]])
            at = to
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens a[i], b[i] stay apart when the bytes of both are merged together.

        Merges run from the lowest rank up. Undone step by step, the token with the later merge is
        opened first and its part at the border is kept; a merge across the border that comes
        before the one just undone would have happened and joins the two. On equal rank the left
        token's merge comes first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        # A border merge must have a rank below this to come first.
        limit = np.full(len(a), len(self.rank), np.int64)
        while len(live):
            x, y, lim = a[live], b[live], limit[live]
            key = (x << 32) | y
            at = np.searchsorted(self.pair_key, key)
            rank = np.where(self.pair_key[at] == key, self.pair_rank[at], len(self.rank))
            bad = rank < lim
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            rx, ry = self.made[x], self.made[y]
            going = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[going], x[going], y[going], rx[going], ry[going]
            left = rx > ry
            a[live] = np.where(left, self.right[x], x)
            b[live] = np.where(left, y, self.left[y])
            # Opening the left token: the border merge had to come before it. Opening the right
            # one: an equal rank at the border lies further left and also comes before it.
            limit[live] = np.where(left, rx, ry + 1)
        return good

    def merge_all(self, data: list[bytes]) -> list[list[int]]:
        """Exact encoding of many words at once: each round does every word's earliest merge."""
        size = np.array([len(d) for d in data])
        tokens = np.array(self.single)[np.frombuffer(b"".join(data), np.uint8)]
        word = np.repeat(np.arange(len(data)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.rank)
        while len(tokens):
            key = (tokens[:-1] << 32) | tokens[1:]
            at = np.searchsorted(self.pair_key, key)
            found = (self.pair_key[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(found, self.pair_rank[at], none), none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, first)
            low = np.repeat(low, np.diff(np.append(first, len(word))))
            over = low == none
            if over.any():  # words without a merge left
                done.append((word[over], tokens[over]))
                rank, low, tokens, word = (x[~over] for x in (rank, low, tokens, word))
                if not len(tokens):
                    break
            hit = rank == low
            # In a run of equal pairs every other one is merged, from the left.
            place = np.arange(len(hit))
            begin = hit.copy()
            begin[1:] &= ~(hit[:-1] & (word[1:] == word[:-1]))
            run = np.maximum.accumulate(np.where(begin, place, 0))
            take = np.flatnonzero(hit & ((place - run) % 2 == 0))
            tokens = tokens.copy()
            tokens[take] = self.result[rank[take]]
            left = np.ones(len(tokens), bool)
            left[take + 1] = False
            tokens, word = tokens[left], word[left]
        word = np.concatenate([w for w, _ in done])
        tokens = np.concatenate([t for _, t in done])
        order = np.argsort(word, kind="stable")
        return [x.tolist() for x in np.split(tokens[order], np.cumsum(np.bincount(word))[:-1])]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Encode words together: ids as little-endian 32-bit numbers."""
        data = [w.encode() for w in words]
        proposed = [self.propose(d) for d in data]
        flat = np.fromiter((t for p in proposed for t in p), np.int64)
        ends = np.cumsum([len(p) for p in proposed])
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        pairs, back = np.unique((flat[at] << 32) | flat[at + 1], return_inverse=True)
        apart = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        wrong = np.unique(np.searchsorted(ends, at[~apart], "right")).tolist()
        if wrong:
            for i, ids in zip(wrong, self.merge_all([data[i] for i in wrong]), strict=True):
                proposed[i] = ids
        sizes = 4 * np.cumsum([len(p) for p in proposed])
        packed = np.fromiter((t for p in proposed for t in p), "<u4").tobytes()
        begins = [0, *sizes[:-1].tolist()]
        return {w: packed[i:j] for w, i, j in zip(words, begins, sizes.tolist(), strict=True)}

    def exact(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts through the pattern; a special token's text is that token."""
        cut, pieces = self.cut.findall, []
        for t in texts:
            if self.split and any(s in t for s in self.special):
                found: list[str | bytes] = []
                for part in self.split.split(t):
                    i = self.special.get(part)
                    found += cut(part) if i is None else [i.to_bytes(4, "little")]
                pieces.append(found)
            else:
                pieces.append(cut(t))
        new = {w for p in pieces for w in p if isinstance(w, str)}
        known = self.learn(list(new)) if new else {}
        return [b"".join(known[w] if isinstance(w, str) else w for w in p) for p in pieces]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text.

        A piece of the pattern starts at a blank or lies between two, unless blanks are adjacent.
        So a text is cut at its spaces, and a part is encoded once with its space in front. Texts
        with adjacent blanks or a special token go through the pattern whole.
        """
        known = self.parts
        if len(known) > KEPT_WORDS:
            known.clear()
        parts = [t.split(" ") for t in texts]
        new = set()
        for p in parts:
            new.update(p[1:])
        new = [w for w in new if w not in known]
        odd = [w for w in new if not w or w[0].isspace() or w[-1].isspace()]
        known.update(dict.fromkeys(odd))
        odd = set(odd)
        new = [w for w in new if w not in odd]
        if new:
            known.update(zip(new, self.exact([" " + w for w in new]), strict=True))
        out: list[bytes | None] = []
        for t, p in zip(texts, parts, strict=True):
            found = [known[w] for w in p[1:]]
            whole = None in found or p[0][-1:].isspace() or any(s in t for s in self.special)
            out.append(None if whole else b"".join(found))
        heads = dict.fromkeys(p[0] for p, x in zip(parts, out, strict=True) if x is not None)
        rest = [t for t, x in zip(texts, out, strict=True) if x is None]
        heads = dict(zip(heads, self.exact(list(heads)), strict=True))
        whole = iter(self.exact(rest))
        return [
            next(whole) if x is None else heads[p[0]] + x for p, x in zip(parts, out, strict=True)
        ]

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Token ids of every text."""
        return [np.frombuffer(p, "<u4").tolist() for p in self.packed(texts)]

    def text(self, ids) -> str:
        """Decoded text, special tokens included."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _rows(batches: Iterator[pa.RecordBatch], path: str, make) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for whole in batches:
        for part in tv.slices(whole, "text", PART):
            texts = [t or "" for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), *make(vocab, vocab.packed(texts))], make.names
            )


def _whole(vocab: Vocabulary, packed: list[bytes]) -> list[pa.Array]:
    ids = [np.frombuffer(p, "<u4") for p in packed]
    return [
        pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())),
        pa.array([vocab.text(i.tolist()) for i in ids], pa.string()),
    ]


def _digest(vocab: Vocabulary, packed: list[bytes]) -> list[pa.Array]:
    decoded = [vocab.text(np.frombuffer(p, "<u4").tolist()) for p in packed]
    return [
        pa.array([len(p) // 4 for p in packed], pa.int64()),
        pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
    ]


_whole.names = ["doc_id", "ids", "decoded"]
_digest.names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): token ids of each whole text, and the text they decode to."""
    return docs.select("doc_id", "text").mapInArrow(
        lambda it: tv.lean(_rows(it, path, _whole)), "doc_id long, ids array<int>, decoded string"
    )


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text, without its ids."""
    return docs.select("doc_id", "text").mapInArrow(
        lambda it: tv.lean(_rows(it, path, _digest)),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
