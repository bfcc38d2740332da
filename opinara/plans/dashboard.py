"""All dashboard datasets for one setting of the global filter."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import metrics, trends
from ..operators.filters import filtered_reviews
from ..session import staged


def dashboard_pack(enriched: DataFrame, **filters) -> dict[str, DataFrame]:
    """The parameterised datasets by name, and the options of the filter itself.

    Six of them read one staged daily summary, a few rows per day, so reviews are scanned once
    for all six. The reader is a plain filtered scan. Options come from all reviews.
    """
    rows = filtered_reviews(enriched, **filters)
    daily = staged(trends.daily_summary(rows), "daily-summary")
    options = staged(enriched.select("game", "language").distinct(), "filter-options")
    return {
        "dim_game": metrics.filter_options(options, "game"),
        "dim_lang": metrics.filter_options(options, "language"),
        "kpis": trends.kpis(daily),
        "trend_score": trends.trend_score(daily),
        "trend_themes": trends.trend_themes(daily),
        "trend_themes_abs": trends.trend_themes_abs(daily),
        "trend_sentiment": trends.trend_sentiment(daily),
        "trend_vol": trends.trend_vol(daily),
        "reader": metrics.reader(rows),
    }
