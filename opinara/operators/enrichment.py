"""Review enrichment: seven flags and a sentiment per review with text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import Scorer
from ..functions.text import has_text
from ..functions.themes import flatten_dims
from ..functions.timewin import instant


def score_texts(df: DataFrame, scorer: Scorer, text: str = "content") -> DataFrame:
    """Add ``sentiment`` and the seven flags; all NULL where there is no text.

    Stateless and row-local, so it runs where the text is read: no shuffle, and the same code
    serves a batch and a stream.
    """
    gated = F.when(has_text(F.col(text)), F.col(text))
    prepared = df.withColumn("_text", scorer.normalize(gated))
    scored = prepared.select(
        *[F.col(c) for c in df.columns],
        scorer.sentiment(F.col("_text")).alias("sentiment"),
        scorer.dimensions(F.col("_text")).alias("_dims"),
    )
    return flatten_dims(scored, "_dims")


def enrich(
    reviews: DataFrame, scorer: Scorer, enriched_at: Column | datetime | None = None
) -> DataFrame:
    """``reviews_raw`` rows -> ``reviews_enriched`` rows, one inference per review with text."""
    return score_texts(reviews, scorer).withColumn("_enriched_at", instant(enriched_at))
