"""The game dimension: listings, configuration, validation and cards."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def games_from_json(df: DataFrame, json_map: Column, *keys: str) -> DataFrame:
    """A JSON object ``{game: package}`` per row -> (*keys, game, package_name) rows."""
    return df.select(
        *keys,
        F.explode(F.from_json(json_map, "map<string,string>")).alias("game", "package_name")
    )


def games_param(spark: SparkSession, games: str | Mapping[str, str]) -> DataFrame:
    """The ``games`` job parameter as a DataFrame. Text that is not a JSON object raises."""
    text = games if isinstance(games, str) else json.dumps(dict(games))
    if not isinstance(json.loads(text), dict):
        raise ValueError(f"games must be a JSON object of game: package, not {text!r}")
    return games_from_json(spark.range(1), F.lit(text))


def languages_param(languages: str | Sequence[str]) -> list[str]:
    """The ``languages`` job parameter: a list, or its JSON text."""
    found = json.loads(languages) if isinstance(languages, str) else list(languages)
    if not isinstance(found, list) or not all(isinstance(x, str) and x.strip() for x in found):
        raise ValueError(f"languages must be a list of codes, not {languages!r}")
    return found


def merge_games(base: DataFrame, config: DataFrame) -> DataFrame:
    """Base games united with configured games; the configured package wins on a clash."""
    return base.alias("b").join(config.alias("c"), "game", "full_outer").select(
        "game", F.coalesce("c.package_name", "b.package_name").alias("package_name")
    )


def list_games(enriched: DataFrame, meta: DataFrame) -> DataFrame:
    """Distinct games of the reviews with icon and package, blank where unknown."""
    games = enriched.select("game").filter(F.col("game").isNotNull()).distinct()
    return (
        games.join(meta, "game", "left")
        .select(
            "game",
            F.coalesce("icon", F.lit("")).alias("icon"),
            F.coalesce("package_name", F.lit("")).alias("package"),
        )
        .orderBy("game")
    )


def configured_games(config: DataFrame, meta: DataFrame) -> DataFrame:
    """Configured games, most recently added first."""
    return (
        config.join(meta.select("game", "icon"), "game", "left")
        .orderBy(F.desc("_added_at"), "game")
        .select(F.col("game").alias("name"), F.col("package_name").alias("package"), "icon")
    )


def requested_packages(requests: DataFrame) -> DataFrame:
    """Distinct requested packages without surrounding blanks; blank ones are no request."""
    asked = requests.select(F.trim("package_name").alias("package_name"))
    return asked.filter(F.col("package_name") != "").distinct()


def validated_packages(requests: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every requested package with its metadata and whether the store knows it, in one join."""
    known = metadata.withColumn("accepted", F.lit(True))
    out = requested_packages(requests).join(known, "package_name", "left")
    return out.withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def accepted_packages(requests: DataFrame, metadata: DataFrame) -> DataFrame:
    """Requested packages the store knows, with their metadata."""
    return requested_packages(requests).join(metadata, "package_name")


def rejected_packages(requests: DataFrame, metadata: DataFrame) -> DataFrame:
    """Requested packages the store does not know."""
    return requested_packages(requests).join(metadata, "package_name", "left_anti")


def require_known_game(games: DataFrame, game: str) -> None:
    """Raise if ``game`` is not among ``games``; reads at most one row."""
    if games.filter(F.col("game") == F.lit(game)).isEmpty():
        raise ValueError(f"unknown game: {game}")


def canonical_positions(games: DataFrame) -> DataFrame:
    """Position of each game in name order, from 0. One row per game goes through the window."""
    position = F.row_number().over(Window.orderBy("game")) - 1
    return games.select("game").distinct().select("game", position.cast("long").alias("position"))


def game_cards(games: DataFrame, per_game: DataFrame, shares: DataFrame, reports: DataFrame):
    """One card per game: score and volume, sentiment shares, latest grade."""
    return (
        games.join(per_game, "game", "left")
        .join(shares, "game", "left")
        .join(reports.select("game", "grade", "report_week"), "game", "left")
    )
