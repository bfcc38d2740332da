"""KPIs, overview aggregates, dimensions, facets and readers.

Each aggregate groups by a few closed or low-cardinality columns, so map-side partial
aggregation reduces the rows to one per group and task before any shuffle; a game that holds
most of the reviews sends no more rows than a small one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text, longer_than
from ..functions.themes import themes_array
from ..schemas import ALL, SENTIMENTS, THEME_LABELS


def is_sentiment(name: str) -> Column:
    return F.lower("sentiment") == F.lit(name)


def share_of_rows(flag: Column) -> Column:
    """Mean of a flag over all rows of the group; NULL counts as not raised."""
    return F.avg(F.when(flag, 1.0).otherwise(0.0).cast("double"))


# --- overview -------------------------------------------------------------------------------


def overview_totals(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count("*").alias("total_reviews"), F.round(F.avg("score"), 2).alias("avg_score")
    )


def overview_per_game(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("game").agg(
        F.count("*").alias("reviews"), F.round(F.avg("score"), 2).alias("avg_score")
    )


def overview_scores(enriched: DataFrame) -> DataFrame:
    """Totals and per-game rows in one pass; ``is_total`` marks the grand total."""
    return (
        enriched.rollup("game")
        .agg(
            F.count("*").alias("reviews"),
            F.round(F.avg("score"), 2).alias("avg_score"),
            F.grouping("game").cast("boolean").alias("is_total"),
        )
        .select("game", "is_total", "reviews", "avg_score")
    )


def overview(enriched: DataFrame) -> DataFrame:
    """Volume, score and sentiment counts of every game and in total, in one pass."""
    return (
        enriched.rollup("game")
        .agg(
            F.grouping("game").cast("boolean").alias("is_total"),
            F.count("*").alias("reviews"),
            F.round(F.avg("score"), 2).alias("avg_score"),
            *[F.count_if(F.col("sentiment") == s).alias(f"n_{s}") for s in SENTIMENTS],
        )
    )


def sentiment_by_game(enriched: DataFrame) -> DataFrame:
    """Count per (game, sentiment); reviews without a sentiment are left out."""
    return (
        enriched.filter(F.col("sentiment").isNotNull())
        .groupBy("game", "sentiment")
        .agg(F.count("*").alias("n"))
    )


def sentiment_share(enriched: DataFrame) -> DataFrame:
    """One row per game: count and percentage of each sentiment.

    Shares divide by the game's reviews with a sentiment, or by 1 when there are none.
    """
    counts = enriched.groupBy("game").agg(
        F.count("sentiment").alias("total"),
        *[F.count_if(F.col("sentiment") == s).alias(f"n_{s}") for s in SENTIMENTS],
    )
    base = F.greatest(F.col("total"), F.lit(1))
    return counts.select(
        "game",
        *[f"n_{s}" for s in SENTIMENTS],
        *[(F.col(f"n_{s}") / base * 100).alias(f"pct_{s}") for s in SENTIMENTS],
    )


# --- filter options and facets --------------------------------------------------------------


def filter_options(enriched: DataFrame, column: str) -> DataFrame:
    """The sentinel and every distinct value of ``column``, ordered."""
    values = enriched.select(column).distinct()
    sentinel = enriched.sparkSession.range(1).select(F.lit(ALL).alias(column))
    return sentinel.union(values).distinct().orderBy(column)


def theme_options(spark, labels: Mapping[str, str] = THEME_LABELS) -> DataFrame:
    """The sentinel and the theme labels, ordered."""
    listed = F.array_distinct(F.array(*[F.lit(label) for label in (ALL, *labels.values())]))
    return spark.range(1).select(F.explode(listed).alias("theme")).orderBy("theme")


def facet_counts(enriched: DataFrame, column: str, predicate: Column) -> DataFrame:
    """Every value of ``column`` with the number of rows the other filters leave for it."""
    return enriched.groupBy(column).agg(F.count_if(predicate).alias("n"))


# --- readers --------------------------------------------------------------------------------


def reader(rows: DataFrame) -> DataFrame:
    """Reviews with text, under display names, with the six theme flags."""
    return rows.filter(has_text(F.col("content"))).select(
        F.col("at").alias("review_at"),
        F.col("game").alias("jogo"),
        F.col("language").alias("idioma"),
        F.col("score").alias("nota"),
        F.col("sentiment").alias("sentimento"),
        F.col("content").alias("comentario"),
        *THEME_LABELS,
    )


def recent_reviews(enriched: DataFrame, game: str, limit: int = 8) -> DataFrame:
    """The newest ``limit`` reviews of a game with more than 20 characters of text."""
    return (
        enriched.filter((F.col("game") == F.lit(game)) & longer_than(F.col("content")))
        .select(
            "review_id",
            "user_name",
            "content",
            "score",
            "sentiment",
            "bug_report",
            F.col("at").alias("review_at"),
            "language",
        )
        .orderBy(F.desc("review_at"), "review_id")
        .limit(limit)
    )


def exploded_themes(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per (row, theme)."""
    return rows.select(*keys, F.explode(themes_array()).alias("theme"))
