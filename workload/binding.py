"""The driver's tables seen as reviews, landed pages, reports and a game catalog.

Every event is a review and takes the whole text of one document. ``props.k`` decides whether
a review is a bare rating (0), blank (1), edited after listing (2-6) or listed twice (7).
Parts are the store's games and line items the moments users ask for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.functions.grading import grade
from opinara.functions.scoring import lexicon_scorer
from opinara.functions.text import has_content
from opinara.functions.timewin import monday_of
from opinara.operators.enrichment import score_texts
from opinara.operators.reports import report_aggregates, template_report
from opinara.schemas import DIMENSIONS, WEEKLY_REPORTS

# Terms that occur in the invented prose of `documents`, one or more per language.
TERMS = {
    "bug_report": ("therhe", "aiention", "entete", "nadoci"),
    "pricing": ("thesti", "mentch", "einver", "queque"),
    "game_balance": ("hetion", "mentier", "lichen", "cimente"),
    "opinion": ("thtion", "oiment", "enlich", "nmente"),
    "community": ("thhent", "oiouou", "enaube", "nqueco"),
    "toxicity": ("stupid",),
    "visuals": ("tioning", "tretion", "berver", "ezmente"),
}
POSITIVE = ("thing", "eaument", "belich", "queque")
NEGATIVE = ("thnt", "menteau", "schkeit", "rrmente")
SCORER = lexicon_scorer(TERMS, POSITIVE, NEGATIVE)

LANGUAGES = ("de", "en", "es", "fr")
# A game the store has listed but this system has not read yet.
UNREAD_GAME = "signup"
STORED_UNTIL_DAYS = 10

# Days before the newest event at which the source was read, run by run.
RUN_DAYS = (20, 10, 0)

# Pieces per sale, on average, from which a game is configured, and the moment of catalog writes.
LARGE_LOT = 25
CATALOG_NOW = "1999-01-01 00:00:00"


_schemas: dict[str, T.StructType] = {}


def moment(text: str) -> Column:
    """A time without zone, like the times of the tables."""
    return F.to_timestamp_ntz(F.lit(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Its schema is read from the footer once, then reused."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. An absent text counts as an empty one, so the column is never NULL and a
    query that asks only whether a review has content does not carry texts through its join."""
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, dealt over the cores.

    The test table is one row group, hence one task, whatever the machine. A landed table has many,
    so this stands for the layout of the table and is part of the fixture: operators score where the
    text is read and never deal texts out themselves.
    """
    return documents(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)


def as_of(spark: SparkSession, sf_dir: str) -> Column:
    """The newest event: the data's own clock."""
    return table(spark, sf_dir, "events").agg(F.max("ts")).scalar()


def facts(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """Review columns that come from the event alone, with the document it quotes."""
    n_documents = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    steps = F.when(F.col("event_type") == "signup", 10).when(
        F.col("event_type").isin("click", "error"), 30
    ).otherwise(60)
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").cast("string").alias("review_id"),
        F.col("event_type").alias("game"),
        F.concat(F.lit("com.example."), "event_type").alias("package_name"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_name"),
        F.greatest(F.lit(1), F.lit(5) - F.floor(F.col("value") / steps)).cast("int").alias("score"),
        k.alias("thumbs_up_count"),
        F.col("ts").alias("at"),
        (F.col("event_id") % n_documents).alias("doc_id"),
    )


def _content() -> Column:
    k = F.col("thumbs_up_count")
    return F.when(k == 0, F.lit(None)).when(k == 1, "   ").otherwise(F.col("text"))


def bind_reviews(
    spark: SparkSession, sf_dir: str, events: DataFrame, quotable: DataFrame
) -> DataFrame:
    quoted = quotable.select("doc_id", F.col("lang").alias("language"), "text")
    return facts(spark, sf_dir, events).join(quoted, "doc_id").select(
        "review_id",
        "game",
        "package_name",
        "language",
        "user_name",
        _content().alias("content"),
        "score",
        "thumbs_up_count",
        "at",
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind_reviews(spark, sf_dir, table(spark, sf_dir, "events"), texts(spark, sf_dir))


def quotable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language and text, to be scored before the join with what quotes it."""
    return texts(spark, sf_dir).select("doc_id", F.col("lang").alias("language"), "text")


def bind_enriched(
    spark: SparkSession, sf_dir: str, events: DataFrame, scored: DataFrame, *more: str
) -> DataFrame:
    """Enriched reviews of ``events`` over scored documents; ``more`` columns come from these."""
    silent = F.col("thumbs_up_count").isin(0, 1)
    return facts(spark, sf_dir, events).join(scored, "doc_id").select(
        "review_id",
        "game",
        "package_name",
        "language",
        "user_name",
        _content().alias("content"),
        "score",
        "thumbs_up_count",
        "at",
        *[F.when(~silent, F.col(c)).alias(c) for c in ("sentiment", *DIMENSIONS)],
        *more,
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched reviews. Each document is scored where it is read, before the join.

    A text quoted by many reviews is scored once, and a query that does not show texts moves
    eight small columns per document instead of the text.
    """
    scored = score_texts(quotable(spark, sf_dir), SCORER, text="text")
    return bind_enriched(spark, sf_dir, table(spark, sf_dir, "events"), scored)


# --- landed pages -----------------------------------------------------------------------------


def listed_at() -> Column:
    """An edited review keeps its place in the listing but carries an older date."""
    edited = F.col("thumbs_up_count").between(2, 6)
    return F.when(edited, F.col("at") - F.expr("INTERVAL 2 DAYS")).otherwise(F.col("at"))


def pages(
    spark: SparkSession, sf_dir: str, days_ago: int = 0, run: str | None = None
) -> DataFrame:
    """Page payload: page 0 holds a target's newest day, rows within a page newest first.

    ``days_ago`` gives what the source listed so many days before the newest event, ``run`` names
    the reading.
    """
    moment = as_of(spark, sf_dir) - F.expr(f"INTERVAL {int(days_ago)} DAYS")
    newest = F.to_date(moment)
    page = F.datediff(newest, F.to_date("at"))
    since_midnight = F.timestamp_diff("MICROSECOND", F.date_trunc("day", "at"), F.col("at"))
    twice = F.when(F.col("thumbs_up_count") == 7, F.array(page, page + 1)).otherwise(F.array(page))
    nothing = F.lit(None).cast("string")
    # The join deals texts out by document, so they are not dealt over the cores before it.
    listed = bind_reviews(spark, sf_dir, table(spark, sf_dir, "events"), documents(spark, sf_dir))
    if days_ago:
        listed = listed.filter(F.col("at") <= moment)
    named = [F.lit(run).alias("run")] if run else []
    return listed.select(
        "package_name",
        "language",
        *named,
        F.explode(twice).alias("page"),
        (F.lit(86_400_000_000) - since_midnight).alias("pos"),
        F.col("review_id").alias("reviewId"),
        F.col("user_name").alias("userName"),
        "content",
        "score",
        F.col("thumbs_up_count").alias("thumbsUpCount"),
        nothing.alias("reviewCreatedVersion"),
        listed_at().alias("at"),
        nothing.alias("replyContent"),
        F.lit(None).cast("timestamp_ntz").alias("repliedAt"),
        nothing.alias("appVersion"),
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("game"),
        F.concat(F.lit("com.example."), "event_type").alias("package_name"),
    ).distinct()


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What earlier runs stored: all games but one, up to some days ago."""
    limit = as_of(spark, sf_dir) - F.expr(f"INTERVAL {STORED_UNTIL_DAYS} DAYS")
    rows = bind_reviews(
        spark, sf_dir, table(spark, sf_dir, "events"), documents(spark, sf_dir)
    ).filter((F.col("at") < limit) & (F.col("game") != UNREAD_GAME))
    return rows.withColumn("at", listed_at())


# --- reports ----------------------------------------------------------------------------------


def report_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per game and calendar week of the data."""
    rows = enriched(spark, sf_dir).filter(has_content(F.col("content")))
    weekly = report_aggregates(
        rows.withColumn("report_week", monday_of(F.col("at"))), "report_week", "game"
    )
    return weekly.select(
        "report_week",
        "game",
        grade(F.col("avg_score"), F.col("bug_rate"), F.col("neg_rate")).alias("grade"),
        template_report().alias("report"),
        "window_start",
        "window_end",
        F.col("n_reviews").cast("long").alias("n_reviews"),
        "avg_score",
        F.col("window_end").cast("timestamp_ntz").alias("_generated_at"),
    ).select(*WEEKLY_REPORTS.names)


# --- game catalog -----------------------------------------------------------------------------


def store_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("com.example.p"), F.col("p_partkey").cast("string")).alias("package_name"),
        F.concat(
            F.lit("https://img.example.com/"), F.replace("p_brand", F.lit("#"), F.lit("-")),
            F.lit(".png"),
        ).alias("icon"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"),
    )


def _first_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured games, those sold in large lots on average, with the moment of the first sale."""
    first = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(
            F.min("l_shipdate").alias("first_asked"),
            F.sum("l_quantity").alias("pieces"),
            F.count("*").alias("sales"),
        )
        .filter(F.col("pieces") >= LARGE_LOT * F.col("sales"))
    )
    part = table(spark, sf_dir, "part")
    return first.join(part, "p_partkey").select(
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("game"),
        F.concat(F.lit("com.old.p"), F.col("p_partkey").cast("string")).alias("package_name"),
        F.when(F.col("p_size") > 25, "bundle").otherwise("ui").alias("source"),
        "first_asked",
    )


def games_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_asked(spark, sf_dir).select(
        "game", "package_name", "source", F.col("first_asked").alias("_added_at")
    )


def games_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_asked(spark, sf_dir).select(
        "game",
        "package_name",
        F.lit("https://img.example.com/old.png").alias("icon"),
        F.col("game").alias("title"),
        F.col("first_asked").alias("_updated_at"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages users asked to add: those of which a quarter of all sales came back."""
    returned = F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    sales = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        returned.alias("returned"), F.count("*").alias("sales")
    )
    return sales.filter(4 * F.col("returned") >= F.col("sales")).select(
        F.concat(F.lit("com.example.p"), F.col("l_partkey").cast("string")).alias("package_name")
    )
