"""Conversations to training text through a compiled chat template, and back.

Turns are dealt by conversation, sorted inside tasks and streamed through the template of
`chat_template`: a task holds one turn and at most ``PART`` characters of output, so a conversation
with a third of all turns is written as many parts by one task and never held whole. Output is
(conv_id, part, text, loss): parts in order are the formatted conversation and ``loss`` lists the
code-point spans of a part that the model is trained on. A span never crosses parts.

Control strings in texts and roles are escaped by one more backslash behind their bracket, which
`unescape` takes away again. Null texts and roles are empty. Turns of equal number are ordered by role
and text, nulls first; repeated rows stay. Rows without a conv_id form one conversation, with a null
id. No turns, no conversation. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import textvec as tv
from opinara.llm.chat_template import compile_template

PART = 1 << 20
_ROWS = 2000

# What opens and closes a turn by role; other roles are named inside their turn.
USER, ASSISTANT, OTHER = ("[INST]", "[/INST]"), ("<s>", "</s>"), ("[TURN]", "[/TURN]")
BODY = "[BODY]"
_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]|TURN\]|BODY\]))")

TEMPLATE = """
{#- One marked block per turn and nothing between them. -#}
{%- for m in messages -%}
  {%- if m.role == 'user' -%}
    [INST]{{ m.text|escape }}[/INST]
  {%- elif m.role == 'assistant' -%}
    <s>{% generation %}{{ m.text|escape }}{% endgeneration %}</s>
  {%- else -%}
    [TURN]{{ m.role|escape }}[BODY]{{ m.text|escape }}[/TURN]
  {%- endif -%}
{%- endfor -%}
"""

FORMATTED = "conv_id long, part int, text string, loss array<struct<start: long, end: long>>"
TURNS = "conv_id long, turn long, role string, text string"
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def escape(text: str) -> str:
    """Control strings, also escaped ones, get one more backslash; no control string is left."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    """The text that was escaped."""
    return _CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


FILTERS = {"escape": escape, "trim": str.strip, "lower": str.lower, "upper": str.upper}


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of some ``_ROWS`` rows or ``PART`` characters of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= _ROWS or size >= PART:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for whole in batches:
        for part in tv.slices(whole, "text"):
            yield from zip(*[c.to_pylist() for c in part.columns], strict=True)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FORMATTED = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("loss", _SPANS)]
)


def _format(batches: Iterator[pa.RecordBatch], template: str, part_chars: int):
    render = compile_template(template, FILTERS)

    def parts() -> Iterator[tuple]:
        for conv_id, turns in groupby(_rows(batches), key=lambda row: row[0]):
            part, at, texts, spans = 0, 0, [], []
            for text, trained in render((role, body) for _, role, body in turns):
                if trained:
                    spans.append({"start": at, "end": at + len(text)})
                texts.append(text)
                at += len(text)
                if at >= part_chars:
                    yield conv_id, part, "".join(texts), spans
                    part, at, texts, spans = part + 1, 0, [], []
            if texts or not part:
                yield conv_id, part, "".join(texts), spans

    yield from _batches(parts(), _FORMATTED)


def format_conversations(
    turns: DataFrame, template: str = TEMPLATE, part_chars: int = PART
) -> DataFrame:
    """(conv_id, part, text, loss) of the turns (conv_id, turn, role, text).

    Rows come by conversation and part within each task, which `read_turns` and `digest` rely on. The
    texts are shuffled once. A template error is raised here, before any row is read.
    """
    compile_template(template, FILTERS)
    empty = F.lit("")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"
    ).repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    return rows.mapInArrow(lambda it: _format(it, template, part_chars), FORMATTED)


def in_order(formatted: DataFrame) -> DataFrame:
    """Formatted parts read back from a table, dealt by conversation again."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")


class TurnReader:
    """Takes the parts of one conversation in turn and gives the turns they complete."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        text, at = self.rest + text, 0
        while at < len(text):
            for role, (opening, closing) in (("user", USER), ("assistant", ASSISTANT), (None, OTHER)):
                if text.startswith(opening, at):
                    break
            else:
                break
            end = text.find(closing, at)
            if end < 0:
                break
            body = text[at + len(opening) : end]
            if role is None:
                name, _, body = body.partition(BODY)
                yield unescape(name), unescape(body)
            else:
                yield role, unescape(body)
            at = end + len(closing)
        self.rest = text[at:]

    def close(self) -> None:
        if self.rest:
            raise ValueError(f"no turn begins or ends at {self.rest[:40]!r}")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv_id, parts in groupby(_rows(batches), key=lambda row: row[0]):
            reader, turn = TurnReader(), 0
            for _, _, text, _ in parts:
                for role, body in reader.feed(text):
                    yield conv_id, turn, role, body
                    turn += 1
            reader.close()

    fields = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    yield from _batches(rows(), pa.schema(fields))


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) from formatted parts in order; turns are numbered from 0."""
    return formatted.select("conv_id", "part", "text", "loss").mapInArrow(_turns, TURNS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv_id, parts in groupby(_rows(batches), key=lambda row: row[0]):
            reader, all_turns, loss = TurnReader(), hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            for _, _, text, spans in parts:
                chars += len(text)
                for role, body in reader.feed(text):
                    n += 1
                    for piece in (role, "\n", body, "\n"):
                        all_turns.update(piece.encode())
                for span in spans:
                    trained = unescape(text[span["start"] : span["end"]])
                    loss_chars += len(trained)
                    loss.update(trained.encode())
            reader.close()
            yield conv_id, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    fields = [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
    yield from _batches(rows(), pa.schema(fields))


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation: turns and trained text as digests, all read back from formatted parts."""
    return formatted.select("conv_id", "part", "text", "loss").mapInArrow(_digest, DIGEST)
