"""Incremental ingest: decode, high-watermark cut, page cap, deduplication, anti-join.

No operator puts one game's or one language's reviews into a single task: cuts and caps are
small staged tables joined back by broadcast, so texts are not shuffled by game, and duplicate
copies collapse on the map side first. Texts are shuffled at most once, by review id: while few ids
are listed twice or stored, only their rows are (`first_new`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import PAGE_FIELDS, PAGE_PAYLOAD, REVIEW_ROW
from ..session import staged

TARGET = ("game", "language")

# Ids, as hashes of eight bytes, that a run sends to all tasks at most.
FEW_IDS = 1_000_000


def decode_pages(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """Landed page payload -> review columns plus ``run``, ``page`` and ``pos``.

    Pages without a ``run`` column are one run.

    ``targets`` (game, package_name, language) names the game of each package. A payload column
    that is absent raises here, at plan time, rather than becoming NULL.
    """
    missing = [c for c in PAGE_PAYLOAD.names if c not in pages.columns and c != "run"]
    if missing:
        raise KeyError(f"page payload lacks {missing}")
    typed = pages.select(
        "package_name",
        "language",
        (F.col("run") if "run" in pages.columns else F.lit("")).alias("run"),
        "page",
        "pos",
        *[F.col(src).alias(dst) for src, dst in PAGE_FIELDS.items()],
    )
    joined = typed.join(targets, ["package_name", "language"])
    return joined.select(*REVIEW_ROW.names, F.coalesce("run", F.lit("")).alias("run"), "page", "pos")


def ingest_targets(games: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Every game in every language: a per-row explode of the language list, not a join."""
    listed = F.array(*[F.lit(x) for x in languages])
    return games.select("game", "package_name", F.explode(listed).alias("language"))


def watermarks(stored: DataFrame, by: Sequence[str] = ("game",)) -> DataFrame:
    """Newest stored ``at`` per game; games without one are absent (first load)."""
    return (
        stored.groupBy(*by)
        .agg(F.max("at").alias("last_at"))
        .filter(F.col("last_at").isNotNull())
    )


def _read_order() -> Column:
    """Position in the source's newest-first order within one target and run."""
    return F.struct("page", "pos")


def source_cut(
    rows: DataFrame, marks: DataFrame, by: Sequence[str] = ("game",)
) -> DataFrame:
    """Rows read before the first one older than the watermark, per run, game and language.

    A reader that pages newest-first stops at that row, so anything behind it is not seen even
    if it is newer. A row exactly at the watermark is kept; targets without one are not cut. The
    stop positions, one row per target, are found on narrow columns and staged.
    """
    marked = rows.join(marks, list(by), "left")
    older = marked.filter(F.col("at") < F.col("last_at"))
    by_run = [*(["run"] if "run" in rows.columns else []), *TARGET]
    first_per_page = older.groupBy(*by_run, "page").agg(F.min("pos").alias("pos"))
    stops = staged(
        first_per_page.groupBy(*by_run).agg(F.min(_read_order()).alias("_stop")), "stops"
    )
    before_stop = F.col("_stop").isNull() | (_read_order() < F.col("_stop"))
    return rows.join(stops, by_run, "left").filter(before_stop).select(*rows.columns)


def max_pages(backfill_max: int, page_count: int) -> int:
    """Pages that hold ``backfill_max`` reviews, at least one."""
    return max(1, -(-backfill_max // page_count))


def page_cap(
    rows: DataFrame,
    marks: DataFrame,
    pages: int,
    backfill: bool = False,
    first_load: str = "none",
    by: Sequence[str] = ("game",),
) -> DataFrame:
    """Keep the first ``pages`` pages (numbered from 0) where the cap applies.

    It applies to every target in backfill mode. Otherwise it applies to none (the default, so no
    review is left unread), to all targets while no game has a watermark (``first_load="table"``),
    or to each target without one (``first_load="game"``). What a cap leaves out is not read later.
    """
    within = F.col("page") < F.lit(pages)
    if backfill:
        return rows.filter(within)
    if first_load == "none":
        return rows
    if first_load == "table":
        any_mark = marks.agg(F.count("*").alias("n")).select(F.col("n") > 0).scalar()
        return rows.filter(any_mark | within)
    if first_load != "game":
        raise ValueError(f"first_load must be 'none', 'game' or 'table', not {first_load!r}")
    known = marks.select(*by, F.lit(True).alias("_known"))
    return (
        rows.join(known, list(by), "left")
        .filter(F.col("_known").isNotNull() | within)
        .select(*rows.columns)
    )


def dedup_reviews(rows: DataFrame) -> DataFrame:
    """One row per review id: the first in read order, so the survivor does not vary.

    A rank filter of one lets Spark drop all but one copy per task before the shuffle.
    """
    # The newest run has the newest state of a review.
    run = [F.desc("run")] if "run" in rows.columns else []
    first_read = Window.partitionBy("review_id").orderBy(
        *run, "page", "pos", "game", "language"
    )
    return (
        rows.withColumn("_copy", F.row_number().over(first_read))
        .filter(F.col("_copy") == 1)
        .drop("_copy")
    )


def new_reviews(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose id is not stored yet. Only the id column of the store is read."""
    return rows.join(stored.select("review_id"), "review_id", "left_anti").select(*rows.columns)


def _few(ids: DataFrame) -> bool:
    return ids.limit(FEW_IDS + 1).count() <= FEW_IDS


def _among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose hashed review id is (``left_semi``) or is not (``left_anti``) one of a few."""
    hashed = rows.withColumn("_id_hash", F.xxhash64("review_id"))
    return hashed.join(F.broadcast(ids), "_id_hash", how).select(*rows.columns)


def doubtful_ids(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """(_id_hash) hashes of the review ids that ``rows`` list more than once or that are stored; staged.

    Only ids are read. A small run is looked up in the store where the store lies.
    """
    counted = rows.groupBy("review_id").agg(F.count("*").alias("n"))
    counted = staged(counted.select("review_id", "n", F.xxhash64("review_id").alias("_id_hash")), "run-ids")
    ids = stored.select("review_id")
    if _few(counted):
        known = _among(ids, counted.select("_id_hash"), "left_semi")
    else:
        known = counted.join(ids, "review_id", "left_semi")
    again = counted.filter("n > 1").select("_id_hash")
    known = known.select(F.xxhash64("review_id").alias("_id_hash"))
    return staged(again.union(known).distinct(), "doubtful-ids")


def first_new(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The first row of each review id that is not stored: `dedup_reviews`, then `new_reviews`.

    A review listed once and not stored passes where it is read; the others, and any whose hash
    meets theirs, are shuffled and compared by the two operators. With many of those all rows are.
    ``rows`` are read more than once.
    """
    doubtful = doubtful_ids(rows, stored)
    if not _few(doubtful):
        return new_reviews(dedup_reviews(rows), stored)
    if doubtful.isEmpty():
        return rows
    compared = dedup_reviews(_among(rows, doubtful, "left_semi"))
    compared = new_reviews(compared, _among(stored.select("review_id"), doubtful, "left_semi"))
    return _among(rows, doubtful, "left_anti").union(compared)


def select_new(
    pages: DataFrame,
    stored: DataFrame,
    targets: DataFrame,
    pages_allowed: int,
    backfill: bool = False,
    first_load: str = "none",
    by: Sequence[str] = ("game",),
) -> DataFrame:
    """The reviews one ingest run adds. In backfill mode the watermark is ignored."""
    rows = decode_pages(pages, staged(targets, "targets"))
    marks = staged(watermarks(stored, by), "watermarks")
    if not backfill:
        rows = source_cut(rows, marks, by)
    capped = page_cap(rows, marks, pages_allowed, backfill, first_load, by)
    return first_new(capped, stored).select(*REVIEW_ROW.names)


def written_counts(rows: DataFrame) -> DataFrame:
    """Rows added per target."""
    return rows.groupBy(*TARGET).agg(F.count("*").alias("written"))


def ingest_summary(stored: DataFrame) -> DataFrame:
    """Reviews, oldest and newest ``at`` per game."""
    return (
        stored.groupBy("game")
        .agg(F.count("*").alias("n"), F.min("at").alias("oldest"), F.max("at").alias("newest"))
        .orderBy("game")
    )
