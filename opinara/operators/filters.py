"""The global filter (game, language, period, theme) shared by every dashboard dataset."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.themes import has_theme, themes_array
from ..functions.timewin import between_dates, date_bound, in_months
from ..schemas import ALL, THEME_LABELS


def equals_or_all(column: Column, value: str = ALL) -> Column:
    """``column = value`` unless the value is the sentinel."""
    return F.lit(True) if value == ALL else column == F.lit(value)


def filtered_reviews(
    enriched: DataFrame,
    game: str = ALL,
    language: str = ALL,
    theme: str = ALL,
    start: str | date | None = None,
    end: str | date | None = None,
    labels: Mapping[str, str] = THEME_LABELS,
    with_themes: bool = False,
) -> DataFrame:
    """Rows under the global filter. ``start``/``end`` are inclusive days; where the table is
    partitioned by month, only their months are opened.

    The theme filter applies first and aggregates follow, so under a theme filter that theme's
    share is 100 % and the other shares are conditional on it.
    """
    rows = in_months(enriched, date_bound(start), date_bound(end)).filter(
        equals_or_all(F.col("game"), game)
        & equals_or_all(F.col("language"), language)
        & between_dates(F.col("at"), start, end)
        & has_theme(theme, labels)
    )
    return rows.withColumn("themes", themes_array(labels)) if with_themes else rows
