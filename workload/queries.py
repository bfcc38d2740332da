"""Registered queries by name. Outputs name the review time ``review_at``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions.grading import grade
from opinara.functions.text import has_text, longer_than
from opinara.functions.themes import flatten_dims, parse_dims, themes_array
from opinara.functions.timewin import last_n_days, monday_of, month_of
from opinara.functions.trained import (
    flag_by_tokens,
    flag_with_model,
    train_flag_model,
    train_token_weights,
)
from opinara.operators import catalog, ingest, merge, metrics, reports, sampling, trends
from opinara.operators.enrichment import enrich, score_texts
from opinara.operators.filters import filtered_reviews
from opinara.plans import jobs, published
from opinara.plans.dashboard import dashboard_pack
from opinara.plans.snapshots import Store
from opinara.schemas import ALL, AT_MONTH, DIMENSIONS, WEEKLY_REPORTS
from opinara.session import shared_dir, staged
from opinara.streaming.enrichment import run_enrichment
from opinara.streaming.ingest import run_page_stream
from opinara.streaming.sentiment import run_weekly_sentiment, weekly_sentiment

from . import binding as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name; a trailing ``_q`` only avoids a clash."""
    QUERIES[fn.__name__.removesuffix("_q")] = fn
    return fn


def _show(df: DataFrame, *columns: str) -> DataFrame:
    """Select, with the review time under its output name."""
    return df.select(*[F.col("at").alias("review_at") if c == "at" else F.col(c) for c in columns])


def _digest(df: DataFrame, *columns: str) -> DataFrame:
    """Review columns with the whole text as a digest."""
    kept = [c for c in columns if c != "at"]
    return df.select(
        *kept, F.col("at").alias("review_at"), F.md5("content").alias("content_md5")
    )


# --- scans and decoding ---------------------------------------------------------------------


@query
def scan_reviews(spark, sf):
    return _show(
        b.reviews(spark, sf),
        "review_id", "game", "package_name", "language", "user_name", "content", "score",
        "thumbs_up_count", "at",
    )


@query
def decode_reviews(spark, sf):
    targets = ingest.ingest_targets(b.games(spark, sf), b.LANGUAGES)
    rows = ingest.decode_pages(b.pages(spark, sf), targets)
    return _digest(rows, "review_id", "game", "language", "user_name", "score", "page", "pos", "at")


@query
def validate_packages(spark, sf):
    asked = b.table(spark, sf, "lineitem").select(
        F.concat(
            F.lit("com.example.p"), (F.col("l_partkey") + F.col("l_suppkey")).cast("string")
        ).alias("package_name")
    )
    return catalog.validated_packages(asked, b.store_metadata(spark, sf))


@query
def parse_games_param(spark, sf):
    named = catalog.games_from_json(b.table(spark, sf, "events"), F.col("props"), "event_id")
    return named.toDF("event_id", "name", "value")


# --- ingest ---------------------------------------------------------------------------------


def _decoded(spark, sf):
    targets = staged(ingest.ingest_targets(b.games(spark, sf), b.LANGUAGES), "targets")
    return ingest.decode_pages(b.pages(spark, sf), targets)


@query
def ingest_targets(spark, sf):
    return ingest.ingest_targets(b.games(spark, sf), b.LANGUAGES)


@query
def watermark(spark, sf):
    return ingest.watermarks(b.stored(spark, sf))


@query
def source_cut(spark, sf):
    marks = staged(ingest.watermarks(b.stored(spark, sf)), "watermarks")
    rows = ingest.source_cut(_decoded(spark, sf), marks)
    return _show(rows, "review_id", "game", "language", "page", "pos", "at")


@query
def page_cap(spark, sf):
    marks = staged(ingest.watermarks(b.stored(spark, sf)), "watermarks")
    rows = ingest.page_cap(
        _decoded(spark, sf), marks, ingest.max_pages(600, 200), first_load="game"
    )
    return _show(rows, "review_id", "game", "language", "page", "pos", "at")


@query
def dedup_reviews(spark, sf):
    # Only digests are returned, so texts become digests where they are read and are not shuffled by id.
    rows = _decoded(spark, sf).withColumn("content_md5", F.md5("content"))
    rows = ingest.dedup_reviews(rows.drop("content"))
    return _show(rows, "review_id", "game", "language", "page", "pos", "at", "content_md5")


@query
def anti_new_reviews(spark, sf):
    # Only digests are returned, so texts become digests where they are read and are not shuffled by id.
    rows = _digest(b.reviews(spark, sf), "review_id", "game", "language", "score", "at")
    return ingest.new_reviews(rows, b.stored(spark, sf))


def _ingested(spark, sf, backfill=False):
    return ingest.select_new(
        b.pages(spark, sf),
        b.stored(spark, sf),
        ingest.ingest_targets(b.games(spark, sf), b.LANGUAGES),
        ingest.max_pages(600, 200),
        backfill=backfill,
    )


@query
def ingest_q(spark, sf):
    return _digest(_ingested(spark, sf), "review_id", "game", "language", "score", "at")


def _published(spark, sf):
    """Three runs, published one after another; each reads what the source listed at its time."""
    store = Store(spark, shared_dir(spark, "published"))
    for i, days_ago in enumerate(b.RUN_DAYS):
        pages = b.pages(spark, sf, days_ago, f"run-{i}")
        published.run_ingest(store, f"run-{i}", pages, b.games(spark, sf), b.LANGUAGES)
    return store


@query
def ingest_runs(spark, sf):
    rows = published.table(_published(spark, sf), "reviews_raw")
    rows = rows.withColumn("at", F.col("at").cast("timestamp_ntz"))
    return _digest(rows, "review_id", "game", "language", "score", "at", AT_MONTH)


@query
def ingest_run_counts(spark, sf):
    """Rows written per run and target, as the writes themselves counted them."""
    return published.run_counts(_published(spark, sf))


@query
def ingest_backfill(spark, sf):
    return _digest(_ingested(spark, sf, True), "review_id", "game", "language", "score", "at")


@query
def written_counts(spark, sf):
    return ingest.written_counts(_ingested(spark, sf))


@query
def ingest_summary(spark, sf):
    return ingest.ingest_summary(b.reviews(spark, sf))


# --- upsert, delete, schema evolution -------------------------------------------------------


def _accepted(spark, sf):
    found = catalog.accepted_packages(b.requests(spark, sf), b.store_metadata(spark, sf))
    return found.select(F.col("title").alias("game"), "package_name", "icon", "title")


@query
def upsert_games_meta(spark, sf):
    source = _accepted(spark, sf).withColumn("_updated_at", b.moment(b.CATALOG_NOW))
    return merge.upsert(b.games_meta(spark, sf), source, ["game"])


@query
def upsert_games_config(spark, sf):
    now = b.moment(b.CATALOG_NOW)
    return jobs.add_to_config(b.games_config(spark, sf), _accepted(spark, sf), now)


@query
def upsert_games_meta_partial(spark, sf):
    now = b.moment(b.CATALOG_NOW)
    return jobs.add_to_meta(b.games_meta(spark, sf), _accepted(spark, sf), now)


@query
def delete_games(spark, sf):
    return merge.delete_keys(b.games_config(spark, sf), _accepted(spark, sf).select("game"))


@query
def delete_games_report(spark, sf):
    return merge.deletion_report(b.games_config(spark, sf), _accepted(spark, sf).select("game"))


@query
def upsert_reports(spark, sf):
    new = staged(
        reports.weekly_reports(b.enriched(spark, sf), as_of=b.as_of(spark, sf)), "new-reports"
    )
    return merge.upsert(b.report_history(spark, sf), new, ["report_week", "game"])


@query
def evolve_schema(spark, sf):
    old = b.report_history(spark, sf).drop("window_start", "window_end")
    return merge.evolve(old, WEEKLY_REPORTS)


# --- enrichment -----------------------------------------------------------------------------

_SCORED = ("review_id", "game", "language", "at", "sentiment", *DIMENSIONS)


@query
def enrich_q(spark, sf):
    documents = b.quotable(spark, sf).withColumnRenamed("text", "content")
    scored = enrich(documents, b.SCORER, b.as_of(spark, sf)).withColumnRenamed("content", "text")
    rows = b.bind_enriched(spark, sf, b.table(spark, sf, "events"), scored, "_enriched_at")
    return rows.select(
        "review_id", "game", "language", "content", F.col("at").alias("review_at"), "sentiment",
        *DIMENSIONS, "_enriched_at",
    )


@query
def flatten_dims_q(spark, sf):
    documents = b.texts(spark, sf)
    scored = documents.select(
        "doc_id", b.SCORER.dimensions(F.lower("text")).alias("_dims"), F.lit(1).alias("_tmp")
    )
    return flatten_dims(scored, "_dims", "_tmp")


@query
def parse_dims_q(spark, sf):
    """Model answers as JSON; a review without text has an answer of another shape."""
    documents = b.texts(spark, sf).select("doc_id", "text")
    answers = score_texts(documents, b.SCORER, text="text").select(
        "doc_id", F.to_json(F.struct(*DIMENSIONS)).alias("answer")
    )
    asked = b.facts(spark, sf, b.table(spark, sf, "events")).join(answers, "doc_id")
    silent = F.col("thumbs_up_count").isin(0, 1)
    parsed = asked.select(
        "review_id",
        parse_dims(F.when(silent, F.concat(F.lit("no answer "), "game")).otherwise(F.col("answer")))
        .alias("_dims"),
    )
    return flatten_dims(parsed, "_dims")


@query
def themes_array_q(spark, sf):
    labels = F.array_join(themes_array(), ",")
    return b.enriched(spark, sf).select("review_id", labels.alias("themes"))


@query
def explode_themes(spark, sf):
    return metrics.exploded_themes(b.enriched(spark, sf), "review_id", "game")


@query
def stream_enrich(spark, sf):
    """The enrichment stream run to its end; the result is the table it wrote."""
    events = (
        spark.readStream.schema(b.table(spark, sf, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
    )
    run = shared_dir(spark, "stream-enrich")
    scored = score_texts(b.quotable(spark, sf), b.SCORER, text="text")
    rows = b.bind_enriched(spark, sf, events, scored)
    (
        _show(rows, *_SCORED)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{run}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{run}/reviews_enriched")
        .awaitTermination()
    )
    return spark.read.parquet(f"{run}/reviews_enriched")


@query
def enrich_job(spark, sf):
    """The enrichment job as shipped, from one catalog table into another; run twice."""
    run = shared_dir(spark, "enrich-job")
    name = run.rsplit("-", 1)[1]
    raw, target = f"raw_{name}", f"enriched_{name}"
    landed = b.reviews(spark, sf).withColumn(AT_MONTH, month_of(F.col("at")))
    landed.write.partitionBy(AT_MONTH).option("path", f"{run}/raw").saveAsTable(raw)
    for _ in range(2):
        run_enrichment(spark, raw, target, b.SCORER, f"{run}/checkpoint")
    rows = staged(_show(spark.table(target), *_SCORED), "enriched")
    spark.sql(f"DROP TABLE {raw}")
    spark.sql(f"DROP TABLE {target}")
    return rows


@query
def stream_ingest(spark, sf):
    """Landed page files read as a stream into an empty store."""
    run = shared_dir(spark, "stream-ingest")
    landed = b.pages(spark, sf)
    landed.write.parquet(f"{run}/pages")
    name = "reviews_" + run.rsplit("-", 1)[1]
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}"
        for f in ingest.decode_pages(landed, b.games(spark, sf).withColumn("language", F.lit("")))
        .drop("run", "page", "pos").schema
    )
    spark.sql(
        f"CREATE TABLE {name} ({columns}, _ingested_at timestamp) "
        f"USING parquet LOCATION '{run}/reviews_raw'"
    )
    targets = ingest.ingest_targets(b.games(spark, sf), b.LANGUAGES)
    stream = (
        spark.readStream.schema(landed.schema)
        .option("maxFilesPerTrigger", 4)
        .parquet(f"{run}/pages")
    )
    run_page_stream(spark, stream, targets, name, f"{run}/checkpoint")
    spark.sql(f"DROP TABLE {name}")
    return _digest(
        spark.read.parquet(f"{run}/reviews_raw"), "review_id", "game", "language", "score", "at"
    )


def _labelled(spark, sf):
    documents = b.texts(spark, sf).select("doc_id", "text")
    labels = b.table(spark, sf, "labels").select("doc_id", "toxic")
    return documents, documents.join(labels, "doc_id")


@query
def ml_toxicity(spark, sf):
    documents, labelled = _labelled(spark, sf)
    weights = train_token_weights(labelled, "text", "toxic")
    return flag_by_tokens(documents, "doc_id", weights, "text", "toxicity")


@query
def ml_toxicity_logistic(spark, sf):
    documents, labelled = _labelled(spark, sf)
    model = train_flag_model(labelled, "text", "toxic")
    return flag_with_model(documents, model, "text", "toxicity").select("doc_id", "toxicity")


# --- predicates and filters -----------------------------------------------------------------


@query
def has_text_q(spark, sf):
    rows = b.reviews(spark, sf).filter(has_text(F.col("content")))
    return _show(rows, "review_id", "content")


@query
def long_reviews(spark, sf):
    rows = b.reviews(spark, sf).filter(longer_than(F.col("content"), 20))
    return rows.select("review_id", F.length("content").cast("long").alias("n_chars"))


@query
def last_n_days_q(spark, sf):
    rows = b.reviews(spark, sf).filter(last_n_days(F.col("at"), 7, b.as_of(spark, sf)))
    return _digest(rows, "review_id", "game", "score", "at")


@query
def filter_global(spark, sf):
    rows = filtered_reviews(b.enriched(spark, sf), game="purchase", language="en")
    return _digest(rows, *[c for c in _SCORED])


@query
def filter_dates(spark, sf):
    """An inclusive start and an end that is no date, hence no bound."""
    rows = filtered_reviews(b.enriched(spark, sf), start="2024-01-15", end="2024-02-30")
    return _show(rows, "review_id", "game", "score", "at")


@query
def filter_theme(spark, sf):
    return _show(filtered_reviews(b.enriched(spark, sf), theme="Bugs"), *_SCORED)


@query
def filtered_base(spark, sf):
    rows = filtered_reviews(
        b.enriched(spark, sf), game="click", language="en", theme="Balanceamento",
        start="2024-01-05", end="2024-01-25", with_themes=True,
    )
    return rows.select(
        "review_id", "score", "sentiment", F.array_join("themes", ",").alias("themes"),
        F.col("at").alias("review_at"),
    )


@query
def reader(spark, sf):
    return metrics.reader(
        filtered_reviews(b.enriched(spark, sf), game="view", start="2024-01-10")
    )


@query
def reader_all(spark, sf):
    return metrics.reader(b.enriched(spark, sf))


@query
def recent_reviews(spark, sf):
    catalog.require_known_game(b.games(spark, sf), "purchase")
    return metrics.recent_reviews(b.enriched(spark, sf), "purchase", 8)


# --- overview and dimensions ----------------------------------------------------------------


@query
def overview_totals(spark, sf):
    return metrics.overview_totals(b.enriched(spark, sf))


@query
def overview_per_game(spark, sf):
    return metrics.overview_per_game(b.enriched(spark, sf))


@query
def overview_scores(spark, sf):
    return metrics.overview_scores(b.enriched(spark, sf))


@query
def overview(spark, sf):
    return metrics.overview(b.enriched(spark, sf))


@query
def dashboard(spark, sf):
    """The rows of every dataset of the pack."""
    out = None
    for name, df in dashboard_pack(b.enriched(spark, sf)).items():
        n = df.agg(F.lit(name).alias("dataset"), F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out


@query
def dashboard_values(spark, sf):
    """Every row of every dataset but the reader, which is `reader_all`, as one text per row."""
    out = None
    for name, df in dashboard_pack(b.enriched(spark, sf)).items():
        if name != "reader":
            cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in sorted(df.columns)]
            rows = df.select(F.lit(name).alias("dataset"), F.concat_ws("|", *cells).alias("cells"))
            out = rows if out is None else out.union(rows)
    return out


@query
def sentiment_by_game(spark, sf):
    return metrics.sentiment_by_game(b.enriched(spark, sf))


@query
def sentiment_share(spark, sf):
    return metrics.sentiment_share(b.enriched(spark, sf))


@query
def dim_game(spark, sf):
    return metrics.filter_options(b.enriched(spark, sf), "game")


@query
def dim_lang(spark, sf):
    return metrics.filter_options(b.enriched(spark, sf), "language")


@query
def facet_counts(spark, sf):
    others = (F.col("language") == "en") & (F.col("score") >= 4)
    return metrics.facet_counts(b.enriched(spark, sf), "game", others)


# --- KPIs and trends ------------------------------------------------------------------------


_BY_SENTIMENT = {"kpis", "trend_sentiment", "trend_vol"}


def _trend(name: str, **filters) -> Query:
    def run(spark, sf):
        rows = filtered_reviews(b.enriched(spark, sf), **filters)
        return getattr(trends, name)(trends.daily_summary(rows, name in _BY_SENTIMENT))

    return run


_FILTER = {"game": "purchase", "language": "en", "start": "2024-01-05", "end": "2024-01-25"}
_THEME = {"theme": "Visual"}

for _name in (
    "kpis", "theme_daily", "trend_score", "trend_themes", "trend_themes_legacy",
    "trend_themes_abs", "trend_sentiment", "trend_vol",
):
    QUERIES[_name] = _trend(_name)
    QUERIES[f"{_name}_filtered"] = _trend(_name, **_FILTER)
    QUERIES[f"{_name}_by_theme"] = _trend(_name, **_THEME)


@query
def stream_weekly_sentiment(spark, sf):
    """Weekly sentiment counted by event time from a stream whose files hold reviews in any order."""
    run = shared_dir(spark, "weekly-sentiment")
    rows = b.enriched(spark, sf).select("review_id", "at", "sentiment")
    rows = rows.repartition(F.col("review_id")).select("at", "sentiment")
    landed = staged(rows, "weekly-sentiment-rows")
    files = landed.inputFiles()
    stream = (
        spark.readStream.schema(landed.schema)
        .option("maxFilesPerTrigger", max(1, len(files) // 2))
        .parquet(files[0].rsplit("/", 1)[0])
    )
    # All of the data lie within the delay, so no row is late.
    run_weekly_sentiment(stream, f"{run}/counts", f"{run}/checkpoint", delay="60 days")
    return weekly_sentiment(spark, f"{run}/counts")


# --- weekly report --------------------------------------------------------------------------


@query
def weekly_agg(spark, sf):
    return reports.weekly_agg(b.enriched(spark, sf), as_of=b.as_of(spark, sf))


@query
def grade_q(spark, sf):
    figures = reports.report_aggregates(b.enriched(spark, sf), "game", "language")
    return figures.select(
        "game", "language",
        grade(F.col("avg_score"), F.col("bug_rate"), F.col("neg_rate")).alias("grade"),
    )


def _sample(spark, sf, days):
    window = reports.report_window(b.enriched(spark, sf), days, b.as_of(spark, sf))
    return sampling.sample_per_group(window, k=jobs.SAMPLE_SIZE)


@query
def weekly_sample(spark, sf):
    return _digest(_sample(spark, sf, 7), "review_id", "game", "score", "sentiment", "at")


@query
def monthly_sample(spark, sf):
    return _digest(_sample(spark, sf, 30), "review_id", "game", "score", "sentiment", "at")


@query
def review_blob(spark, sf):
    return sampling.review_blob(_sample(spark, sf, 7)).select(
        "game", F.md5("blob").alias("blob_md5"), F.length("blob").cast("long").alias("n_chars")
    )


@query
def report_prompt(spark, sf):
    prompts = reports.prompts_per_game(b.enriched(spark, sf), as_of=b.as_of(spark, sf))
    return prompts.select("game", F.md5("prompt").alias("prompt_md5"))


@query
def weekly_report(spark, sf):
    return reports.weekly_reports(b.enriched(spark, sf), as_of=b.as_of(spark, sf))


@query
def latest_reports(spark, sf):
    games = catalog.canonical_positions(b.games(spark, sf))
    return reports.latest_reports(b.report_history(spark, sf), games)


@query
def reports_of_week(spark, sf):
    return reports.reports_of_week(b.report_history(spark, sf), monday_of(b.as_of(spark, sf)))


# --- game catalog ---------------------------------------------------------------------------


@query
def list_games(spark, sf):
    """Metadata exists for the games whose mean score reaches three."""
    rows = b.enriched(spark, sf)
    meta = (
        rows.groupBy("game", "package_name")
        .agg(F.avg("score").alias("mean"), F.max("user_name").alias("icon"))
        .filter(F.col("mean") >= 3)
        .select("game", "package_name", "icon")
    )
    return catalog.list_games(rows, meta)


@query
def configured_games(spark, sf):
    meta = _accepted(spark, sf).select("game", "icon")
    return catalog.configured_games(b.games_config(spark, sf), meta)


@query
def merge_games(spark, sf):
    base = b.store_metadata(spark, sf).select(F.col("title").alias("game"), "package_name")
    return catalog.merge_games(base, b.games_config(spark, sf).select("game", "package_name"))


@query
def game_cards(spark, sf):
    rows = b.enriched(spark, sf)
    games = b.games(spark, sf)
    latest = reports.latest_reports(
        b.report_history(spark, sf), catalog.canonical_positions(games)
    )
    return catalog.game_cards(
        games.select("game"), metrics.overview_per_game(rows), metrics.sentiment_share(rows), latest
    )
