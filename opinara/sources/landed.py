"""Landed payloads: page files and store metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PAGE_PAYLOAD


REQUIRED = [c for c in PAGE_PAYLOAD.names if c != "run"]
# Longer than any folder is kept, so that the stream skips no file for its age.
_ANY_AGE = "36500d"


def _payload(lines: DataFrame) -> DataFrame:
    """JSON lines -> payload. A key that is absent fails the read; an explicit null is a value.

    Without a ``run`` key the folder of the file is the run.
    """
    absent = F.array_except(
        F.array(*[F.lit(c) for c in REQUIRED]),
        F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")),
    )
    parsed = F.from_json("value", PAGE_PAYLOAD, {"mode": "FAILFAST"})
    problem = F.concat(F.lit("page payload lacks "), F.array_join(absent, ", "))
    checked = F.when(F.size(absent) == 0, parsed).otherwise(
        F.raise_error(problem).cast(PAGE_PAYLOAD)
    )
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    rows = lines.filter(F.trim("value") != "").select(checked.alias("p"), folder.alias("folder"))
    return rows.select(
        *[
            (F.coalesce("p.run", "folder") if c == "run" else F.col(f"p.{c}")).alias(c)
            for c in PAGE_PAYLOAD.names
        ]
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON pages, one review per line. The schema is fixed, nothing is inferred."""
    return _payload(spark.read.text(path))


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same files as a stream; ``files_per_trigger`` throttles each micro-batch."""
    reader = spark.readStream.format("text").option("maxFileAge", _ANY_AGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _payload(reader.load(path))


def decode_metadata(games: DataFrame, metadata: DataFrame) -> DataFrame:
    """(game, package_name) with the store's icon and title; absent columns raise."""
    missing = [c for c in ("package_name", "icon", "title") if c not in metadata.columns]
    if missing:
        raise KeyError(f"store metadata lacks {missing}")
    found = metadata.select("package_name", "icon", "title", F.lit(True).alias("_found"))
    # A configured package the store does not know fails the job instead of storing NULLs.
    known = F.when(
        F.col("_found").isNull(),
        F.raise_error(F.concat(F.lit("no store metadata for "), F.col("package_name"))).cast(
            "boolean"
        ),
    ).otherwise(True)
    return (
        games.join(found, "package_name", "left")
        .filter(known)
        .select("game", "package_name", "icon", "title")
    )
