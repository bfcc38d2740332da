from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opinara.functions import scoring, themes, timewin
from opinara.functions.grading import grade
from opinara.functions.text import has_content, has_text, longer_than
from opinara.functions.trained import flag_by_tokens, train_token_weights
from opinara.operators.enrichment import enrich, score_texts
from opinara.operators.filters import filtered_reviews
from opinara.schemas import DIMENSIONS, THEME_LABELS


def test_text_gates_differ(spark):
    texts = [None, "", "   ", "ok", "x" * 20, "x" * 21, " " * 25]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(
        has_text(F.col("t")), has_content(F.col("t")), longer_than(F.col("t"), 20)
    ).collect()
    assert [r[0] for r in got] == [False, False, False, True, True, True, False]
    assert [r[1] for r in got] == [False, True, True, True, True, True, True]
    assert [r[2] for r in got] == [False, False, False, False, False, True, True]


@pytest.mark.parametrize(
    "avg,bug,neg,expected",
    [
        (None, 0.0, 0.0, "yellow"),
        (4.0, 0.149, 0.299, "green"),
        (4.0, 0.15, 0.0, "yellow"),
        (4.0, 0.0, 0.30, "yellow"),
        (3.999, 0.0, 0.0, "yellow"),
        (3.0, 0.0, 0.0, "yellow"),
        (2.999, 0.0, 0.0, "red"),
        (5.0, 0.35, 0.0, "red"),
        (5.0, 0.349, 0.549, "yellow"),
        (5.0, 0.0, 0.55, "red"),
    ],
)
def test_grade_boundaries(spark, avg, bug, neg, expected):
    df = spark.createDataFrame([(avg, bug, neg)], "a double, b double, n double")
    assert df.select(grade(F.col("a"), F.col("b"), F.col("n"))).first()[0] == expected


def test_date_bounds_tolerate_bad_dates(spark):
    bounds = ["", "x", "2024-02-30", "2024-01-15", None, date(2024, 1, 16)]
    got = spark.range(1).select(
        *[timewin.date_bound(v).alias(f"c{i}") for i, v in enumerate(bounds)]
    ).first()
    assert list(got) == [None, None, None, date(2024, 1, 15), None, date(2024, 1, 16)]


def test_date_range_is_inclusive(spark):
    days = [datetime(2024, 1, 14, 23, 59), datetime(2024, 1, 15), datetime(2024, 1, 16, 23, 59),
            datetime(2024, 1, 17)]
    df = spark.createDataFrame([(d,) for d in days], "at timestamp")
    kept = df.filter(timewin.between_dates(F.col("at"), "2024-01-15", "2024-01-16"))
    assert kept.count() == 2
    assert df.filter(timewin.between_dates(F.col("at"), "bad", "")).count() == 4


def test_weeks_start_on_monday(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 7, 23, 59),), (datetime(2024, 1, 8, 0, 0),)], "at timestamp"
    )
    got = [r[0] for r in df.select(timewin.monday_of(F.col("at"))).collect()]
    assert got == [date(2024, 1, 1), date(2024, 1, 8)]


def test_last_n_days_keeps_the_edge(spark):
    now = datetime(2024, 1, 8, 12)
    df = spark.createDataFrame(
        [(datetime(2024, 1, 1, 12),), (datetime(2024, 1, 1, 11, 59, 59),)], "at timestamp"
    )
    assert df.filter(timewin.last_n_days(F.col("at"), 7, now)).count() == 1


def test_parse_dims_never_fails(spark):
    good = '{"bug_report": true, "pricing": false, "extra": 1}'
    df = spark.createDataFrame([(1, good), (2, "not json"), (3, None)], "id int, j string")
    out = themes.flatten_dims(df.select("id", themes.parse_dims(F.col("j")).alias("_d")), "_d")
    assert out.columns == ["id", *DIMENSIONS]
    by_id = {r["id"]: r for r in out.collect()}
    assert by_id[1]["bug_report"] is True and by_id[1]["pricing"] is False
    assert by_id[1]["visuals"] is None
    assert all(by_id[i][d] is None for i in (2, 3) for d in DIMENSIONS)


def _flags(spark, **raised):
    values = [raised.get(d) for d in DIMENSIONS]
    return spark.createDataFrame(
        [values], ", ".join(f"{d} boolean" for d in DIMENSIONS)
    )


def test_themes_leave_opinion_out_and_keep_label_order(spark):
    df = _flags(spark, opinion=True, visuals=True, bug_report=True, pricing=False)
    assert df.select(themes.themes_array()).first()[0] == ["Bugs", "Visual"]
    assert df.filter(themes.has_theme("Visual")).count() == 1
    assert df.filter(themes.has_theme("Preços")).count() == 0
    assert df.filter(themes.has_theme("Comunidade")).count() == 0  # NULL flag
    assert df.filter(themes.has_theme("no such theme")).count() == 0
    assert df.filter(themes.has_theme("Todos")).count() == 1


def test_theme_filter_equals_array_membership(spark):
    from workload import binding

    enriched = binding.enriched(spark, "/root/testdata/sf0.001")
    for label in THEME_LABELS.values():
        fast = filtered_reviews(enriched, theme=label).count()
        slow = enriched.filter(F.array_contains(themes.themes_array(), label)).count()
        assert fast == slow


def test_lexicon_scorer(spark):
    df = spark.createDataFrame(
        [(1, "GREAT game, no crash"), (2, "great but the WORST price"), (3, "terrible"),
         (4, "so so"), (5, "   "), (6, None)],
        "id int, content string",
    )
    got = {r["id"]: r for r in enrich(df, scoring.lexicon_scorer()).collect()}
    assert [got[i]["sentiment"] for i in range(1, 7)] == [
        "positive", "mixed", "negative", "neutral", None, None,
    ]
    assert got[1]["bug_report"] is True and got[2]["pricing"] is True
    assert got[4]["bug_report"] is False
    assert all(got[i][d] is None for i in (5, 6) for d in DIMENSIONS)


def test_lexicon_needs_every_dimension():
    with pytest.raises(ValueError):
        scoring.lexicon_scorer({"bug_report": ("x",)})


def test_pandas_scorer_sees_only_texts(spark):
    def load():
        def model(texts):
            assert all(t and t.strip() for t in texts)
            flags = {d: [d == "visuals" for _ in texts] for d in DIMENSIONS}
            return pd.DataFrame({**flags, "sentiment": ["neutral"] * len(texts)})

        return model

    df = spark.createDataFrame([(1, "hi"), (2, None), (3, " ")], "id int, content string")
    got = {r["id"]: r for r in score_texts(df, scoring.pandas_scorer(load)).collect()}
    assert got[1]["visuals"] is True and got[1]["sentiment"] == "neutral"
    assert got[2]["visuals"] is None and got[3]["sentiment"] is None


def test_json_scorer_tolerates_bad_answers(spark):
    answer = F.when(F.col("_text") == "good", '{"toxicity": true}').otherwise("sorry, no")
    scorer = scoring.json_scorer(lambda _: answer, lambda text: F.lit("neutral"))
    df = spark.createDataFrame([("good",), ("bad",)], "content string")
    got = {r["content"]: r["toxicity"] for r in score_texts(df, scorer).collect()}
    assert got == {"good": True, "bad": None}


def test_token_weights_flag_like_texts(spark):
    schema = "id int, text string, bad int"
    labelled = spark.createDataFrame(
        [(1, "vile day", 1), (2, "Vile  VILE", 1), (3, "nice day", 0), (4, "nice\nwalk", 0),
         (5, None, 1), (6, "vile", None)],
        schema,
    )
    weights = train_token_weights(labelled, "text", "bad")
    asked = spark.createDataFrame(
        [(1, "vile"), (2, "nice"), (3, ""), (4, None), (5, "unheard of")], "id int, text string"
    )
    out = {r.id: r.flag for r in flag_by_tokens(asked, "id", weights, "text", "flag").collect()}
    assert out == {1: True, 2: False, 3: False, 4: None, 5: False}
    empty = train_token_weights(labelled.limit(0), "text", "bad")
    out = flag_by_tokens(asked, "id", empty, "text", "flag")
    assert out.filter("flag").count() == 0 and out.count() == 5
