"""Line-first cleaning: rules judge each line, failing lines go, documents that lose too much go.

A line fails as
* punctuation: it shows as many marks as letters, or most of its words are shouted or carry a
  string of symbols;
* navigation: it is cut into many short items by bars, bullets or arrows;
* boilerplate: it is short and names cookies, scripts, copyright and the like;
* repetition: most of its words are one of a few that come again and again.
Blank lines are dropped without counting. A document is kept if its base figures pass and the
failing lines hold at most ``max_lost`` of its word characters.

Base figures (per whole text, words are runs without ASCII blanks): words, characters in words,
symbols, repeated lines, words in 5-word windows that occur twice or more. Nulls count as empty
texts; a text of less than ten words fails. Repeated rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opinara.llm import textvec as tv

SYMBOLS = "#*$%&|<>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BARS = re.compile(r"(?:^|\s)(?:\||»|›|·|•|/|>|→)(?=\s|$)")
MARKED = re.compile(r"[#*$%&|<>!?=~^_+@\\]{2,}[.,;:]?$")
BOILERPLATE = re.compile(
    r"\b(?:cookies?|javascript|all rights reserved|privacy policy|terms of (?:use|service)"
    r"|subscribe|sign (?:in|up)|log ?in|lorem ipsum|click here|read more|powered by)\b",
    re.IGNORECASE,
)
WINDOW = 5


def line_fault(line: str) -> str | None:
    """Name of the rule that a line breaks, or None. Blank lines break none."""
    found = WORD.findall(line)
    if not found:
        return None
    n = len(found)
    letters = sum(map(str.isalnum, line))
    if 2 * letters < sum(map(len, found)):
        return "punctuation"
    if n >= 5 and 2 * sum(1 for w in found if MARKED.search(w)) > n:
        return "punctuation"
    if n >= 4 and 3 * len(BARS.findall(line)) >= n and len(BARS.findall(line)) >= 2:
        return "navigation"
    if n <= 25 and BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 8 and 2 * sum(1 for w in found if len(w) > 1 and w.isupper() and w.isalpha()) > n + 4:
        return "punctuation"
    if n >= 12 and 4 * len(set(found)) < n:
        return "repetition"
    return None


def clean_lines(text: str) -> tuple[str, int, int]:
    """The text without failing lines, word characters lost, word characters before."""
    kept, lost, total = [], 0, 0
    verdict: dict[str, tuple[bool, int]] = {}
    for line in text.split("\n"):
        known = verdict.get(line)
        if known is None:
            known = (line_fault(line) is not None, sum(map(len, WORD.findall(line))))
            verdict[line] = known
        total += known[1]
        if known[0]:
            lost += known[1]
        else:
            kept.append(line)
    return "\n".join(kept), lost, total


def repeated_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words per row, and words inside a window that occurs twice or more in its row."""
    rows = len(column)
    w = tv.words(column, fold=False)
    n = np.bincount(w.row, minlength=rows)
    at, h = tv.grams(w, WINDOW)
    row = w.row[at]
    order = np.lexsort((h, row))
    same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # A window covers its first word and the next four.
    step = np.zeros(len(w) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + WINDOW, -1)
    covered = np.cumsum(step)[:-1] > 0
    return n, np.bincount(w.row[covered], minlength=rows)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, lost_chars long"
)
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_NOT_SYMBOL = re.compile(f"[^{re.escape(SYMBOLS)}]+")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")


def _judge(batches: Iterator[pa.RecordBatch], max_lost: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in tv.slices(whole, "text", 2 << 20):
            n, repeat = repeated_words(part.column(1))
            chars, symbols, lines, lost, all_chars = [], [], [], [], []
            for t in part.column(1).to_pylist():
                t = t or ""
                chars.append(len(_BLANK.sub("", t)))
                symbols.append(len(_NOT_SYMBOL.sub("", t)))
                full = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
                lines.append(len(full) - len(set(full)))
                _, gone, total = clean_lines(t)
                lost.append(gone)
                all_chars.append(total)
            failed = (n < 10) | (100 * repeat > 20 * n)
            kept = ~failed & (np.array(lost) <= max_lost * np.array(all_chars))
            columns = [n, chars, symbols, lines, repeat]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(pa.int64()),
                    *(pa.array(np.asarray(c, np.int64)) for c in columns),
                    pa.array(failed),
                    pa.array(kept),
                    pa.array(np.asarray(lost, np.int64)),
                ],
                _NAMES,
            )


def judge(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """Base figures and verdict of every whole text."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _judge(it, max_lost), SCHEMA)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in tv.slices(whole, "text", 2 << 20):
            texts = [t if t is None else clean_lines(t)[0] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"]
            )


def cleaned(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with failing lines removed, whatever the document's verdict."""
    return docs.select("doc_id", "text").mapInArrow(_cleaned, "doc_id long, text string")
