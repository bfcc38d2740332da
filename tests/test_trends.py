from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from opinara.operators import metrics, trends
from opinara.plans.dashboard import dashboard_pack
from opinara.schemas import DIMENSIONS

DAY = date(2024, 1, 1)
COLUMNS = (
    "game string, language string, at timestamp, score int, sentiment string, content string, "
    + ", ".join(f"{d} boolean" for d in DIMENSIONS)
)


def review(day, score=5, sentiment="positive", game="g", lang="en", content="text", **flags):
    at = datetime.combine(DAY, datetime.min.time()) + timedelta(days=day - 1, hours=9)
    return (game, lang, at, score, sentiment, content, *[flags.get(d, False) for d in DIMENSIONS])


def make(spark, *items):
    return spark.createDataFrame(list(items), COLUMNS)


def nth(day):
    return DAY + timedelta(days=day - 1)


def daily(spark, *items):
    return trends.daily_summary(make(spark, *items))


def test_frame_is_calendar_days_not_rows(spark):
    got = rows(trends.trend_score(daily(spark, review(1, 1), review(2, 2), review(9, 5))))
    assert got == [(nth(1), 1.0), (nth(2), 1.5), (nth(9), 5.0)]
    near = rows(trends.trend_score(daily(spark, review(1, 1), review(7, 5), review(8, 5))))
    assert near == [(nth(1), 1.0), (nth(7), 3.0), (nth(8), 5.0)]


def test_theme_share_and_legacy(spark):
    items = [
        review(1, bug_report=True, pricing=True), review(1, bug_report=True), review(1), review(1),
        review(2, bug_report=True), review(2, opinion=True),
    ]
    share = {(d, t): s for d, t, s in rows(trends.trend_themes(daily(spark, *items)))}
    assert share == {(nth(1), "Bugs"): 50.0, (nth(1), "Preços"): 25.0, (nth(2), "Bugs"): 50.0}
    # Day 1 has two themes, so the legacy denominator counts its four reviews twice.
    legacy = {(d, t): s for d, t, s in rows(trends.trend_themes_legacy(daily(spark, *items)))}
    assert legacy == {(nth(1), "Bugs"): 25.0, (nth(1), "Preços"): 12.5, (nth(2), "Bugs"): 30.0}
    count = {(d, t): c for d, t, c in rows(trends.trend_themes_abs(daily(spark, *items)))}
    assert count == {(nth(1), "Bugs"): 2, (nth(1), "Preços"): 1, (nth(2), "Bugs"): 3}


def test_theme_rows_need_the_theme_on_the_day(spark):
    got = rows(trends.trend_themes_abs(daily(spark, review(1, visuals=True), review(2))))
    assert got == [(nth(1), "Visual", 1)]


def test_theme_filter_makes_its_own_share_total(spark):
    data = make(spark, review(1, bug_report=True, pricing=True), review(1, bug_report=True),
                review(1))
    pack = dashboard_pack(data, theme="Bugs")
    assert rows(pack["trend_themes"]) == [(nth(1), "Bugs", 100.0), (nth(1), "Preços", 50.0)]


def test_null_sentiment_rules(spark):
    data = make(spark, review(1, sentiment="Positive"), review(1, sentiment=None),
                review(1, sentiment="negative", score=1), review(1, sentiment="mixed", score=None))
    summary = trends.daily_summary(data)
    assert rows(trends.kpis(summary)) == [(3.67, 4, 0.0)]
    assert rows(trends.trend_vol(summary)) == [(nth(1), 4, 25.0)]
    assert {(s, n) for _, s, n in rows(trends.trend_sentiment(summary))} == {
        ("positive", 1), (None, 1), ("negative", 1), ("mixed", 1),
    }
    assert rows(metrics.sentiment_by_game(data)) == [
        ("g", "Positive", 1), ("g", "mixed", 1), ("g", "negative", 1),
    ]


def test_kpis_of_nothing(spark):
    assert rows(trends.kpis(daily(spark, review(1)).limit(0))) == [(None, 0, None)]


def test_summary_without_sentiment_gives_the_same_trends(spark):
    data = make(spark, review(1, bug_report=True), review(1, sentiment=None), review(3, score=1))
    split, whole = trends.daily_summary(data), trends.daily_summary(data, by_sentiment=False)
    for trend in (trends.trend_score, trends.trend_themes, trends.trend_themes_abs):
        assert rows(trend(split)) == rows(trend(whole))


def test_weeks(spark):
    got = rows(trends.trend_sentiment(daily(spark, review(7), review(8))))
    assert got == [(nth(1), "positive", 1), (nth(8), "positive", 1)]


def test_overview(spark):
    data = make(spark, review(1, 5), review(1, 4), review(1, 1, game=None))
    assert rows(metrics.overview_totals(data)) == [(3, 3.33)]
    assert rows(metrics.overview_per_game(data)) == [(None, 1, 1.0), ("g", 2, 4.5)]
    # A NULL game and the grand total stay apart.
    assert set(rows(metrics.overview_scores(data))) == {
        (None, True, 3, 3.33), (None, False, 1, 1.0), ("g", False, 2, 4.5),
    }


def test_sentiment_share_of_a_silent_game(spark):
    data = make(spark, review(1, sentiment=None), review(1, game="h"), review(1, game="h"),
                review(1, game="h", sentiment="mixed"), review(1, game="h", sentiment="negative"))
    got = {r["game"]: r for r in metrics.sentiment_share(data).collect()}
    assert got["g"]["pct_positive"] == 0.0
    assert got["h"]["pct_positive"] == 50.0 and got["h"]["n_negative"] == 1


def test_options_and_facets(spark):
    data = make(spark, review(1), review(1, game="Todos"), review(1, game="h", lang="pt"))
    assert [r[0] for r in metrics.filter_options(data, "game").collect()] == ["Todos", "g", "h"]
    assert [r[0] for r in metrics.theme_options(spark).collect()] == [
        "Balanceamento", "Bugs", "Comunidade", "Preços", "Todos", "Toxicidade", "Visual",
    ]
    facets = metrics.facet_counts(data, "game", F.col("language") == "en")
    assert rows(facets) == [("Todos", 1), ("g", 1), ("h", 0)]


def test_reader_hides_blank_reviews(spark):
    data = make(spark, review(1), review(1, content="  "), review(1, content=None))
    assert metrics.reader(data).count() == 1


def test_pack_scans_reviews_once_for_all_trends(spark):
    pack = dashboard_pack(make(spark, review(1), review(2)), game="g", start="2024-01-01")
    assert set(pack) == {"kpis", "trend_score", "trend_themes", "trend_themes_abs",
                         "trend_sentiment", "trend_vol", "reader", "dim_game", "dim_lang"}
    for name in set(pack) - {"reader", "dim_game", "dim_lang"}:
        plan = pack[name]._jdf.queryExecution().executedPlan().toString()
        assert "daily-summary" in plan and "content" not in plan
    assert rows(pack["kpis"]) == [(5.0, 2, 1.0)]


@pytest.mark.parametrize("days", [40])
def test_trends_against_brute_force(spark, days):
    items = [
        review(d, score=1 + (d * 7) % 5, pricing=d % 3 == 0, visuals=d % 4 == 0)
        for d in range(1, days, 2)
        for _ in range(1 + d % 3)
    ]
    got = dict(rows(trends.trend_score(daily(spark, *items))))
    for day, value in got.items():
        window = [i[3] for i in items if 0 <= (day - i[2].date()).days <= 6]
        assert value == pytest.approx(sum(window) / len(window), abs=0.0051)
