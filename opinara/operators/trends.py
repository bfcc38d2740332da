"""KPIs and calendar trends, all read from one daily summary.

``daily_summary`` is the only step that touches reviews: it reduces them to one row per day and
sentiment. The seven-day windows then run over days. They need a total order of days, hence a
single task, which is sound because the row count is the length of the calendar and not the
number of reviews.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import THEME_LABELS

# Fixed value: frame of the moving trends, the current day and the six before it.
_SIX_DAYS_BACK = -6


def daily_summary(
    rows: DataFrame, by_sentiment: bool = True, labels: Mapping[str, str] = THEME_LABELS
) -> DataFrame:
    """Per day: reviews, scored reviews, score sum and theme counts.

    With ``by_sentiment`` (what the KPIs, the sentiment and the volume trend need) the rows are
    split by lower-cased sentiment. The other trends add the parts up again, so one summary can
    serve all of them; a trend used alone can leave the split out and not read the column.
    """
    keys = [F.lower("sentiment").alias("sentiment")] if by_sentiment else []
    return rows.groupBy(F.to_date("at").alias("day"), *keys).agg(
        F.count("*").alias("n"),
        F.count("score").alias("n_scored"),
        F.sum("score").alias("score_sum"),
        *[F.count_if(F.col(flag)).alias(flag) for flag in labels],
    )


def _per_day(daily: DataFrame, labels: Mapping[str, str] = THEME_LABELS) -> DataFrame:
    return daily.groupBy("day").agg(
        F.sum("n").alias("n"),
        F.sum("score_sum").alias("s"),
        *[F.sum(flag).alias(flag) for flag in labels],
    )


def _moving_sum(value: str | Column) -> Column:
    """Sum over seven calendar days; days without rows shrink the frame."""
    frame = Window.orderBy(F.unix_date("day")).rangeBetween(_SIX_DAYS_BACK, Window.currentRow)
    return F.sum(value).over(frame)


def _percent(part: Column, whole: Column) -> Column:
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 1)


def _theme_rows(
    per_day: DataFrame, value: Callable[[str], Column], name: str, labels: Mapping[str, str]
) -> DataFrame:
    """(day, tema, value) for the themes that occur on the day.

    The windows run over the wide day rows and the six columns are turned into rows last, so
    reviews are never exploded and totals need no join.
    """
    wide = per_day.select("day", *labels, *[value(flag).alias(f"_{flag}") for flag in labels])
    cells = F.array(
        *[
            F.struct(
                F.lit(label).alias("tema"), F.col(flag).alias("c"), F.col(f"_{flag}").alias(name)
            )
            for flag, label in labels.items()
        ]
    )
    return (
        wide.select("day", F.inline(cells))
        .filter(F.col("c") > 0)
        .select("day", "tema", name)
        .orderBy("day", "tema")
    )


def theme_daily(daily: DataFrame, labels: Mapping[str, str] = THEME_LABELS) -> DataFrame:
    """Reviews per (day, theme), themes that occur that day only."""
    rows = _theme_rows(_per_day(daily, labels), F.col, "n", labels)
    return rows.select("day", F.col("tema").alias("theme"), F.col("n").alias("c"))


def kpis(daily: DataFrame) -> DataFrame:
    """Mean score, volume and sentiment score (+1 / -1 / 0; no sentiment counts 0)."""
    weight = F.when(F.col("sentiment") == "positive", 1).when(F.col("sentiment") == "negative", -1)
    return daily.agg(
        F.round(F.sum("score_sum") / F.nullif(F.sum("n_scored"), F.lit(0)), 2).alias("nota"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("volume"),
        F.round(
            F.sum(F.coalesce(weight, F.lit(0)) * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)), 2
        ).alias("sent_score"),
    )


def trend_score(daily: DataFrame) -> DataFrame:
    """Seven-day mean score per day, weighted by reviews."""
    mean = _moving_sum("s") / F.nullif(_moving_sum("n"), F.lit(0))
    return _per_day(daily).select("day", F.round(mean, 2).alias("nota_7d")).orderBy("day")


def trend_themes(daily: DataFrame, labels: Mapping[str, str] = THEME_LABELS) -> DataFrame:
    """Seven-day share of reviews that carry a theme, in percent; each day counts once."""
    return _theme_rows(
        _per_day(daily, labels),
        lambda flag: _percent(_moving_sum(flag), _moving_sum("n")),
        "share_7d",
        labels,
    )


def trend_themes_legacy(daily: DataFrame, labels: Mapping[str, str] = THEME_LABELS) -> DataFrame:
    """Share whose denominator counts a day once per theme present on it.

    Kept for users who need the older figures; ``trend_themes`` is the documented measure.
    """
    present = sum(F.when(F.col(flag) > 0, 1).otherwise(0) for flag in labels)
    return _theme_rows(
        _per_day(daily, labels).withColumn("_n_by_theme", F.col("n") * present),
        lambda flag: _percent(_moving_sum(flag), _moving_sum("_n_by_theme")),
        "share_7d",
        labels,
    )


def trend_themes_abs(daily: DataFrame, labels: Mapping[str, str] = THEME_LABELS) -> DataFrame:
    """Seven-day count of reviews that carry a theme."""
    return _theme_rows(_per_day(daily, labels), _moving_sum, "cnt_7d", labels)


def trend_sentiment(daily: DataFrame) -> DataFrame:
    """Reviews per Monday-based week and sentiment; no sentiment is its own group."""
    return (
        daily.groupBy(
            F.trunc("day", "week").alias("semana"), F.col("sentiment").alias("sentimento")
        )
        .agg(F.sum("n").alias("n"))
        .orderBy("semana", "sentimento")
    )


def trend_vol(daily: DataFrame) -> DataFrame:
    """Reviews per day and the percentage that is negative."""
    negative = F.when(F.col("sentiment") == "negative", F.col("n")).otherwise(0)
    per_day = daily.groupBy("day").agg(F.sum("n").alias("n"), F.sum(negative).alias("neg"))
    return per_day.select(
        "day", F.col("n").alias("reviews"), _percent(F.col("neg"), F.col("n")).alias("pct_neg")
    ).orderBy("day")
