import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_ingest import FIRST, GAMES, payload

from opinara.functions.scoring import lexicon_scorer
from opinara.operators import ingest, trends
from opinara.operators.enrichment import enrich
from opinara.plans import jobs, tables
from opinara.schemas import THEME_LABELS
from opinara.sources.landed import stream_pages
from opinara.streaming.ingest import run_page_stream
from opinara.streaming.sentiment import run_weekly_sentiment, weekly_sentiment

SCORED = ("review_id", "sentiment", "bug_report", "opinion")


def test_ingest_then_enrich_scores_each_review_once(spark, schema, tmp_path):
    for buckets, name in ((None, schema), (4, schema + "_b")):
        tables.create_tables(spark, name, id_buckets=buckets)
        checkpoint = str(tmp_path / name)
        run = lambda *items: jobs.ingest_then_enrich(
            spark, name, payload(spark, *items), GAMES, ["en", "pt"], lexicon_scorer(), checkpoint
        )
        assert run(*FIRST) == 4
        enriched = tables.name(name, "reviews_enriched")
        first = {r["review_id"]: r["_enriched_at"] for r in spark.table(enriched).collect()}
        assert len(first) == 4
        assert run(("com.a", "en", 0, 0, "a9", 9)) == 1
        assert run(("com.a", "en", 0, 0, "a9", 9)) == 0
        second = {r["review_id"]: r["_enriched_at"] for r in spark.table(enriched).collect()}
        assert set(second) == {*first, "a9"}
        assert all(second[k] == first[k] for k in first)
        props = spark.sql(f"SHOW TBLPROPERTIES {enriched}").collect()
        assert ("quality", "silver") in [(r[0], r[1]) for r in props]
        raw = spark.table(tables.name(name, "reviews_raw"))
        batch = enrich(raw, lexicon_scorer()).select(*SCORED)
        assert rows(batch) == rows(spark.table(enriched).select(*SCORED))


def test_page_stream_shuffles_no_text_of_new_reviews(spark, schema, tmp_path, monkeypatch):
    tables.create_tables(spark, schema)
    raw, landing = tables.name(schema, "reviews_raw"), str(tmp_path / "landing")
    targets = ingest.ingest_targets(jobs.monitored_games(spark, schema, GAMES), ["en", "pt"])
    fresh = [("com.a", "en", 0, i, f"r{i}", 1) for i in range(3)]
    payload(spark, *fresh).coalesce(1).write.option("ignoreNullFields", False).json(landing)
    plans, append = [], tables.append

    def watched(df, table):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return append(df, table)

    monkeypatch.setattr(tables, "append", watched)
    run_page_stream(spark, stream_pages(spark, landing), targets, raw, str(tmp_path / "checkpoint"))
    assert spark.table(raw).count() == 3
    assert plans and not any("Exchange hashpartitioning" in plan for plan in plans)


def test_page_stream_reads_each_file_once(spark, schema, tmp_path):
    tables.create_tables(spark, schema)
    raw = tables.name(schema, "reviews_raw")
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    targets = ingest.ingest_targets(jobs.monitored_games(spark, schema, GAMES), ["en", "pt"])

    def run():
        run_page_stream(spark, stream_pages(spark, landing, 1), targets, raw, checkpoint)
        return spark.table(raw).count()

    payload(spark, *FIRST).write.mode("append").option("ignoreNullFields", False).json(landing)
    assert run() == 4
    assert run() == 4
    payload(spark, *FIRST, ("com.b", "pt", 0, 0, "b2", 7)).write.mode("append").option("ignoreNullFields", False).json(landing)
    assert run() == 5
    # A lost checkpoint replays every file and still adds nothing.
    run_page_stream(
        spark, stream_pages(spark, landing), targets, raw, str(tmp_path / "checkpoint2")
    )
    assert spark.table(raw).count() == 5


def _landed(spark, folder, number, *items):
    """One file of reviews (day of January 2024 or None, sentiment)."""
    made = [(f"2024-01-{d:02d} 23:30:00" if d else None, s) for d, s in items]
    data = spark.createDataFrame(made, "at string, sentiment string")
    data.withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(f"{folder}/part={number}")


def _counted(spark, folder, out, delay):
    stream = (
        spark.readStream.schema("at timestamp, sentiment string, part int")
        .option("maxFilesPerTrigger", 1)
        .parquet(folder)
    )
    run_weekly_sentiment(stream, f"{out}/counts", f"{out}/checkpoint", delay)
    return {(str(w), s): n for w, s, n in rows(weekly_sentiment(spark, f"{out}/counts"))}


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Asia/Tokyo"])
def test_weekly_sentiment_in_any_order_within_the_delay(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        folder, out = str(tmp_path / "in"), str(tmp_path / "out")
        parts = [[(15, "Negative"), (7, "positive")], [(1, "negative"), (14, None), (None, "mixed")],
                 [(8, "negative"), (14, "negative"), (21, "positive")], [(7, "POSITIVE"), (22, None)]]
        for i, part in enumerate(parts[:3]):
            _landed(spark, folder, i, *part)
        _counted(spark, folder, out, "30 days")
        _landed(spark, folder, 3, *parts[3])
        got = _counted(spark, folder, out, "30 days")
        assert got == _counted(spark, folder, out, "30 days")  # nothing new, nothing twice
        timed = spark.read.schema("at timestamp, sentiment string").parquet(folder).filter("at IS NOT NULL")
        timed = timed.select("*", F.lit(1).alias("score"), *[F.lit(False).alias(x) for x in THEME_LABELS])
        want = rows(trends.trend_sentiment(trends.daily_summary(timed)))
        assert got == {(str(w), s): n for w, s, n in want}
        assert sum(got.values()) == 9 and got["2024-01-01", "positive"] == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_rows_of_weeks_closed_before_the_delay_are_late(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, part in enumerate([[(2, "mixed")], [(20, "mixed")], [(21, "mixed")], [(3, "mixed"), (14, "mixed")]]):
        _landed(spark, folder, i, *part)
        got = _counted(spark, folder, out, "7 days")
    # The newest row is of the 21st: the week of the 1st ended long before, that of the 8th within seven days.
    assert got == {("2024-01-01", "mixed"): 1, ("2024-01-15", "mixed"): 2, ("2024-01-08", "mixed"): 1}
