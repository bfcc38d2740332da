"""The jobs over published tables: a run is visible as a whole or not at all.

`plans.jobs` writes catalog tables; here the same operators write a `snapshots.Store`. The watermark
of a run comes from the version it starts from, hence from committed runs only, and moves with the
one manifest that publishes the run's rows. A run that died is repeated under its name; a run that
was committed is not done again.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.timewin import instant, month_of
from ..operators import catalog, ingest, merge
from ..schemas import AT_MONTH
from ..session import staged
from .jobs import BACKFILL_MAX, PAGE_COUNT, add_to_config, add_to_meta
from .snapshots import Snapshot, Store

# Beyond so many targets their counts are taken from the finished folder instead of the write.
TARGET_METRICS = 500

REVIEWS_RAW = schemas.REVIEWS_RAW_BY_MONTH
_SCHEMAS = {
    "reviews_raw": REVIEWS_RAW,
    "games_meta": schemas.GAMES_META,
    "games_config": schemas.GAMES_CONFIG,
}


def table(store: Store, name: str, snapshot: Snapshot | None = None) -> DataFrame:
    """A published table at a version (the newest by default)."""
    return store.read(name, _SCHEMAS[name], snapshot)


def _target_metrics(targets: list) -> dict:
    """A conditional count per target, to be observed by the write."""
    return {
        f"t{i}": F.count_if((F.col("game") == F.lit(t.game)) & (F.col("language") == F.lit(t.language)))
        for i, t in enumerate(targets)
    }


def run_ingest(
    store: Store,
    run_id: str,
    pages: DataFrame,
    games: DataFrame | str | Mapping[str, str],
    languages: str | Sequence[str],
    backfill: bool = False,
    backfill_max: int = BACKFILL_MAX,
    page_count: int = PAGE_COUNT,
    first_load: str = "none",
    ingested_at: datetime | None = None,
) -> dict[tuple[str, str], int]:
    """Publish the new reviews of the landed pages; -> rows written per (game, language).

    The counts are observed on the one write of the run and kept with it, so that a run which was
    committed before gives them again. Targets without new rows are left out.
    """
    base = store.snapshot()
    done = base.run(run_id)
    if done:
        return {(g, lang): n for g, lang, n in done["written"]}
    store.note(run_id, "started")
    config = table(store, "games_config", base).select("game", "package_name")
    if not isinstance(games, DataFrame):
        games = catalog.games_param(store.spark, games)
    known = catalog.merge_games(games, config)
    targets = staged(
        ingest.ingest_targets(known, catalog.languages_param(languages)), "run-targets"
    )
    few = targets.select("game", "language").distinct().limit(TARGET_METRICS + 1).collect()
    rows = ingest.select_new(
        pages,
        table(store, "reviews_raw", base),
        targets,
        ingest.max_pages(backfill_max, page_count),
        backfill=backfill,
        first_load=first_load,
    )
    rows = rows.withColumn("_ingested_at", instant(ingested_at)).withColumn(
        AT_MONTH, month_of(F.col("at"))
    )
    watched = few if len(few) <= TARGET_METRICS else []
    folder, seen = store.stage(
        rows.select(*REVIEWS_RAW.names), "reviews_raw", run_id, [AT_MONTH], _target_metrics(watched)
    )
    store.note(run_id, "landed")
    if len(few) <= TARGET_METRICS:
        counts = {(t.game, t.language): seen[f"t{i}"] for i, t in enumerate(watched)}
    else:
        landed = store.read("reviews_raw", REVIEWS_RAW, Snapshot(0, {"reviews_raw": [folder]}))
        counts = {(r.game, r.language): r.written for r in ingest.written_counts(landed).collect()}
    counts = {k: n for k, n in counts.items() if n}
    record = {
        "run_id": run_id,
        "at": time.time(),
        "rows": seen["_rows"],
        "written": [[g, lang, n] for (g, lang), n in sorted(counts.items())],
    }
    new = {"reviews_raw": [folder]} if seen["_rows"] else {}
    store.commit(base, append=new, run=record)
    return counts


def add_games(
    store: Store, requests: DataFrame, metadata: DataFrame, as_of: datetime | None = None
) -> DataFrame:
    """Add the requested packages the store knows, to both game tables or to none; -> the rejected."""
    base, now = store.snapshot(), instant(as_of)
    found = staged(
        catalog.accepted_packages(requests, metadata).select(
            F.col("title").alias("game"), "package_name", "icon", "title"
        ),
        "accepted-games",
    )
    config = add_to_config(table(store, "games_config", base), found, now)
    meta = add_to_meta(table(store, "games_meta", base), found, now)
    new = {
        "games_config": [store.stage(config, "games_config")[0]],
        "games_meta": [store.stage(meta, "games_meta")[0]],
    }
    store.commit(base, replace=new)
    return catalog.rejected_packages(requests, metadata)


def remove_games(store: Store, games: DataFrame) -> DataFrame:
    """Stop monitoring games; -> every asked game with ``removed``. Stored reviews stay."""
    base = store.snapshot()
    config = table(store, "games_config", base)
    report = staged(merge.deletion_report(config, games.select("game")), "removed-games")
    kept = store.stage(merge.delete_keys(config, games.select("game")), "games_config")[0]
    store.commit(base, replace={"games_config": [kept]})
    return report


def run_counts(store: Store) -> DataFrame:
    """(run_id, game, language, written) of every committed run, read from the newest manifest."""
    runs = store.manifest("runs array<struct<run_id: string, written: array<array<string>>>>")
    run = runs.select(F.explode("runs").alias("run"))
    each = run.select("run.run_id", F.explode("run.written").alias("w"))
    return each.select(
        "run_id",
        F.col("w")[0].alias("game"),
        F.col("w")[1].alias("language"),
        F.col("w")[2].cast("long").alias("written"),
    )
