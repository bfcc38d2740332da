"""The jobs: ingest, metadata refresh, weekly report, game management."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scoring import Scorer
from ..functions.timewin import instant
from ..operators import catalog, ingest, merge, reports
from ..session import staged
from ..sources.landed import decode_metadata
from ..streaming.enrichment import run_enrichment
from . import tables

# Ingest and report defaults.
PAGE_COUNT = 200
BACKFILL_MAX = 600
REPORT_DAYS = 7
SAMPLE_SIZE = 700


def monitored_games(
    spark: SparkSession, schema: str, games: str | Mapping[str, str]
) -> DataFrame:
    """The games parameter merged with ``games_config`` (absent before the first setup)."""
    config = tables.table_or_empty(
        spark, tables.name(schema, "games_config"), schemas.GAMES_CONFIG
    )
    return catalog.merge_games(
        catalog.games_param(spark, games), config.select("game", "package_name")
    )


def run_ingest(
    spark: SparkSession,
    schema: str,
    pages: DataFrame,
    games: str | Mapping[str, str],
    languages: str | Sequence[str],
    backfill: bool = False,
    backfill_max: int = BACKFILL_MAX,
    page_count: int = PAGE_COUNT,
    first_load: str = "none",
    ingested_at: datetime | None = None,
) -> int:
    """Append the new reviews of the landed pages; returns how many were written.

    ``pages`` may hold the pages of several runs; each is cut on its own. They are read more than
    once, so they must be landed: `read_pages` and `fetch_pages` return such.
    """
    raw = tables.name(schema, "reviews_raw")
    targets = ingest.ingest_targets(
        monitored_games(spark, schema, games), catalog.languages_param(languages)
    )
    rows = ingest.select_new(
        pages,
        spark.table(raw),
        targets,
        ingest.max_pages(backfill_max, page_count),
        backfill=backfill,
        first_load=first_load,
    )
    return tables.append(rows.withColumn("_ingested_at", instant(ingested_at)), raw)


def refresh_games_meta(
    spark: SparkSession,
    schema: str,
    metadata: DataFrame,
    games: str | Mapping[str, str],
    as_of: datetime | None = None,
) -> None:
    """Upsert icon and title of every monitored game."""
    meta = tables.name(schema, "games_meta")
    rows = decode_metadata(monitored_games(spark, schema, games), metadata)
    source = rows.withColumn("_updated_at", instant(as_of))
    tables.replace(merge.upsert(spark.table(meta), source, ["game"]), meta)


def run_weekly_report(
    spark: SparkSession,
    schema: str,
    days: int = REPORT_DAYS,
    sample_size: int = SAMPLE_SIZE,
    as_of: Column | datetime | None = None,
    reporter: reports.Reporter | None = None,
) -> None:
    """Write this week's reports; a rerun in the same week replaces them.

    Only the partitions of the written week are read and rewritten. The clock is read once, so
    figures, sample and week agree even if the run crosses midnight.
    """
    as_of = datetime.now() if as_of is None else as_of
    table = tables.name(schema, "weekly_reports")
    enriched = spark.table(tables.name(schema, "reviews_enriched"))
    # Staged because the upsert reads it twice and a reporter must be asked once per game.
    new = staged(
        reports.weekly_reports(enriched, days, sample_size, as_of, reporter), "new-reports"
    )
    week = spark.table(table).filter(
        F.col("report_week") == reports.monday_of(instant(as_of))
    )
    tables.replace_partitions(merge.upsert(week, new, ["report_week", "game"]), table)


def add_games(
    spark: SparkSession,
    schema: str,
    requests: DataFrame,
    metadata: DataFrame,
    as_of: datetime | None = None,
) -> DataFrame:
    """Add the requested packages the store knows; returns the rejected ones."""
    now = instant(as_of)
    found = catalog.accepted_packages(requests, metadata).select(
        F.col("title").alias("game"), "package_name", "icon", "title"
    )
    config, meta = tables.name(schema, "games_config"), tables.name(schema, "games_meta")
    tables.replace(add_to_config(spark.table(config), found, now), config)
    tables.replace(add_to_meta(spark.table(meta), found, now), meta)
    return catalog.rejected_packages(requests, metadata)


def add_to_config(config: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """A known game takes the new package only; a new one is stamped as added by a user."""
    return merge.partial_upsert(
        config,
        found.select("game", "package_name"),
        ["game"],
        update=["package_name"],
        insert={"source": F.lit("ui"), "_added_at": now},
    )


def add_to_meta(meta: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """A known game takes package, icon and title and keeps its update time."""
    return merge.partial_upsert(
        meta,
        found.select("game", "package_name", "icon", "title"),
        ["game"],
        update=["package_name", "icon", "title"],
        insert={"_updated_at": now},
    )


def remove_game(spark: SparkSession, schema: str, game: str) -> bool:
    """Stop monitoring a game; False if it was not configured. Stored reviews stay."""
    table = tables.name(schema, "games_config")
    config = spark.table(table)
    if config.filter(F.col("game") == F.lit(game)).isEmpty():
        return False
    tables.replace(config.filter(~F.col("game").eqNullSafe(F.lit(game))), table)
    return True


def ingest_then_enrich(
    spark: SparkSession,
    schema: str,
    pages: DataFrame,
    games: str | Mapping[str, str],
    languages: Sequence[str],
    scorer: Scorer,
    checkpoint: str,
    **options,
) -> int:
    """The daily job: ingest, then enrich exactly the rows it added."""
    written = run_ingest(spark, schema, pages, games, languages, **options)
    run_enrichment(
        spark,
        tables.name(schema, "reviews_raw"),
        tables.name(schema, "reviews_enriched"),
        scorer,
        checkpoint,
    )
    return written
