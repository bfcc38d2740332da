"""Ingest of landed pages as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..plans import tables
from ..schemas import REVIEW_ROW
from ..session import staged


def run_page_stream(
    spark: SparkSession, pages: DataFrame, targets: DataFrame, table: str, checkpoint: str
) -> None:
    """Append the new reviews of page files that landed since the last run, then stop.

    The checkpoint takes the place of the watermark: it knows which pages were read. A batch
    that is replayed after a failure adds nothing, because stored ids are anti-joined away.
    """

    targets = staged(targets, "targets")

    def add(batch: DataFrame, _: int) -> None:
        rows = ingest.decode_pages(batch, targets)
        stored = batch.sparkSession.table(table)
        new = ingest.first_new(rows, stored).select(*REVIEW_ROW.names)
        tables.append(new.withColumn("_ingested_at", F.current_timestamp()), table)

    (
        pages.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    spark.catalog.refreshTable(table)
