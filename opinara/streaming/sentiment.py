"""Weekly sentiment kept up to date by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the epoch is a Thursday, so seven-day windows start on Mondays four days later.
_TO_MONDAY = "4 days"
_BATCH = "_batch"


def weekly_counts(rows: DataFrame, delay: str) -> DataFrame:
    """Reviews per Monday-based week and lower-cased sentiment of a stream with a watermark on ``at``.

    A row is late only if its whole week ended more than ``delay`` before the newest row of the
    earlier batches; late rows are not counted, every other order gives the same counts. Weeks are those of
    the session's time zone. Rows without a time have no week and are left out; no sentiment is its
    own group. State holds one row per open week and sentiment.
    """
    zone = rows.sparkSession.conf.get("spark.sql.session.timeZone")
    # Windows count in UTC, so they get local wall time and their start is moved back.
    local = F.from_utc_timestamp(F.col("at").cast("timestamp"), zone)
    narrow = rows.select(local.alias("_local"), F.lower("sentiment").alias("sentimento"))
    week = F.window("_local", "7 days", "7 days", _TO_MONDAY)
    counts = narrow.withWatermark("_local", delay).groupBy(week.alias("_week"), "sentimento").count()
    monday = F.to_date(F.to_utc_timestamp(F.col("_week.start"), zone))
    return counts.select(monday.alias("semana"), "sentimento", F.col("count").alias("n"))


def run_weekly_sentiment(rows: DataFrame, path: str, checkpoint: str, delay: str = "7 days") -> None:
    """Count the rows appended to a stream since the last run into ``path``, then stop.

    A batch writes the weeks it changed into a folder of its own and replaces it when it is replayed,
    so a run that lost executors or its driver counts nothing twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{_BATCH}={number}")

    (
        weekly_counts(rows, delay)
        .writeStream.foreachBatch(add)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def weekly_sentiment(spark: SparkSession, path: str) -> DataFrame:
    """The present counts: of each week and sentiment what the last batch that changed it wrote."""
    written = spark.read.schema(f"semana date, sentimento string, n long, {_BATCH} long").parquet(path)
    return written.groupBy("semana", "sentimento").agg(F.max_by("n", _BATCH).alias("n"))
