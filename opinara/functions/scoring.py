"""Scorers turn review text into seven flags and a sentiment.

A hosted model cannot be assumed, so the model call is a parameter: a ``Scorer`` is a set of
column functions. ``lexicon_scorer`` stays inside code generation; ``json_scorer`` wraps any
column function that answers in JSON; ``pandas_scorer`` batches texts through Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DIMENSIONS
from .themes import parse_dims


@dataclass(frozen=True)
class Scorer:
    """``dimensions`` and ``sentiment`` see ``normalize(text)``; text is NULL where there is none.

    ``normalize`` becomes its own projection, so a shared step is evaluated once per row.
    """

    dimensions: Callable[[Column], Column]
    sentiment: Callable[[Column], Column]
    normalize: Callable[[Column], Column] = lambda text: text


# A small lexicon for real reviews (English, Portuguese, Spanish). Replace it for other prose.
DEFAULT_TERMS: Mapping[str, Sequence[str]] = {
    "bug_report": ("crash", "bug", "error", "freez", "trava", "erro", "falla"),
    "pricing": ("price", "refund", "expensive", "preço", "caro", "reembolso", "precio"),
    "game_balance": ("unfair", "matchmaking", "pay to win", "pay-to-win", "desbalance", "injust"),
    "opinion": ("love", "hate", "good", "bad", "gost", "ador", "bom", "ruim", "bueno", "malo"),
    "community": ("player", "chat", "team", "clan", "jogador", "equipe", "comunidad"),
    "toxicity": ("idiot", "stupid", "trash", "lixo", "burro", "basura"),
    "visuals": ("graphic", "animation", "design", "gráfic", "visual", "arte"),
}
DEFAULT_POSITIVE = ("love", "great", "good", "excellent", "ador", "ótimo", "bom", "excelente")
DEFAULT_NEGATIVE = ("hate", "bad", "terrible", "worst", "odei", "ruim", "péssim", "horrible")


def _mentions(text: Column, terms: Sequence[str]) -> Column:
    return reduce(or_, [text.contains(term) for term in terms])


def lexicon_scorer(
    terms: Mapping[str, Sequence[str]] = DEFAULT_TERMS,
    positive: Sequence[str] = DEFAULT_POSITIVE,
    negative: Sequence[str] = DEFAULT_NEGATIVE,
) -> Scorer:
    """Flags raised by substring terms on lower-cased text. NULL text gives NULL flags."""
    missing = [d for d in DIMENSIONS if not terms.get(d)]
    if missing:
        raise ValueError(f"no terms for dimensions {missing}")

    def dimensions(text: Column) -> Column:
        return F.struct(*[_mentions(text, terms[d]).alias(d) for d in DIMENSIONS])

    def sentiment(text: Column) -> Column:
        good, bad = _mentions(text, positive), _mentions(text, negative)
        # Nested so that each term is searched for at most once per row.
        return (
            F.when(good, F.when(bad, "mixed").otherwise("positive"))
            .when(bad, "negative")
            .when(text.isNotNull(), "neutral")
        )

    return Scorer(dimensions, sentiment, F.lower)


def json_scorer(ask: Callable[[Column], Column], sentiment: Callable[[Column], Column]) -> Scorer:
    """A scorer over a column function that answers one JSON object of seven booleans."""
    return Scorer(lambda text: parse_dims(ask(text)), sentiment)


def pandas_scorer(load: Callable[[], Callable[[Sequence[str]], pd.DataFrame]]) -> Scorer:
    """A scorer over a Python model, one call per Arrow batch.

    ``load`` runs once per task and returns a function from texts to a frame with the seven
    flags and ``sentiment``. Rows without text never reach the model.
    """
    schema = T.StructType(
        [
            *[T.StructField(d, T.BooleanType()) for d in DIMENSIONS],
            T.StructField("sentiment", T.StringType()),
        ]
    )
    columns = schema.names

    @F.pandas_udf(schema)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            out = pd.DataFrame(None, index=texts.index, columns=columns, dtype=object)
            some = texts.notna()
            if some.any():
                scored = model(texts[some].tolist())
                out.loc[some, columns] = scored[columns].to_numpy(dtype=object)
            yield out

    return Scorer(
        dimensions=lambda scored: F.struct(*[scored[d].alias(d) for d in DIMENSIONS]),
        sentiment=lambda scored: scored["sentiment"],
        normalize=predict,
    )
