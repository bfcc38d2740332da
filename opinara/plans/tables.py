"""Catalog tables: creation, schema evolution and the few ways rows are written."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.timewin import month_of
from ..operators.merge import evolve
from ..schemas import AT_MONTH
from ..session import shared_dir

COMMENTS = {
    "reviews_raw": "Bronze: one row per review, deduplicated by review_id before the append.",
    "games_meta": "Dimension: icon and title of each monitored game.",
    "games_config": "Games added by users, merged with the games parameter at ingest.",
    "weekly_reports": "Gold: one graded report per game and week.",
}

TABLES: Mapping[str, T.StructType] = {
    "reviews_raw": schemas.REVIEWS_RAW_BY_MONTH,
    "games_meta": schemas.GAMES_META,
    "games_config": schemas.GAMES_CONFIG,
    "weekly_reports": schemas.WEEKLY_REPORTS,
}


def name(schema: str, table: str) -> str:
    """A quoted ``schema.table``; ``schema`` may carry a catalog."""
    return ".".join(f"`{part}`" for part in [*schema.split("."), table])


def create_tables(
    spark: SparkSession, schema: str, id_buckets: int | None = None, by_month: bool = True
) -> None:
    """Create the schema and its four tables where missing, then add missing report columns.

    ``by_month`` partitions ``reviews_raw`` by the month of ``at``; `append` fills that column and
    the enrichment stream hands it on, so reports and date filters open the months they need.

    ``id_buckets`` buckets ``reviews_raw`` by review id. The ingest anti-join then reads the
    stored ids in place: only the run's own rows are shuffled, never the whole store. Run the
    ingest with ``spark.sql.shuffle.partitions`` at the same number, so that its one shuffle
    serves deduplication, anti-join and a write of one file per bucket.
    """
    spark.sql("CREATE SCHEMA IF NOT EXISTS " + ".".join(f"`{p}`" for p in schema.split(".")))
    layout = {"weekly_reports": "PARTITIONED BY (report_week)"}
    raw = ["PARTITIONED BY (at_month)"] if by_month else []
    if id_buckets:
        raw.append(f"CLUSTERED BY (review_id) INTO {int(id_buckets)} BUCKETS")
    layout["reviews_raw"] = " ".join(raw)
    for table, struct in TABLES.items():
        fields = [f for f in struct if by_month or f.name != AT_MONTH]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name(schema, table)} ({columns}) USING parquet "
            f"{layout.get(table, '')} COMMENT '{COMMENTS[table]}'"
        )
    add_missing_columns(spark, name(schema, "weekly_reports"), schemas.WEEKLY_REPORTS)


def add_missing_columns(spark: SparkSession, table: str, schema: T.StructType) -> list[str]:
    """ALTER the table to hold every column of ``schema``; older rows read NULL there."""
    have = set(spark.table(table).columns)
    missing = [f for f in schema.fields if f.name not in have]
    if missing:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in missing)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")
    return [f.name for f in missing]


def table_or_empty(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """An optional source: the table, or no rows of its schema when it does not exist."""
    if spark.catalog.tableExists(table):
        return spark.table(table)
    return evolve(spark.range(0).select(), schema)


def append(df: DataFrame, table: str) -> int:
    """Append by column position of the table; returns the rows written.

    The count is observed on the write itself, so the plan runs once. The whole run is one
    commit: a lost run leaves nothing behind and can be repeated.
    """
    spark = df.sparkSession
    written = Observation()
    columns = spark.table(table).columns
    if AT_MONTH in columns and AT_MONTH not in df.columns:
        df = df.withColumn(AT_MONTH, month_of(F.col("at")))
    rows = df.select(*columns).observe(written, F.count("*").alias("n"))
    rows.write.insertInto(table)
    return int(written.get["n"])


def _location(spark: SparkSession, table: str) -> str:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
    return described.filter("col_name = 'Location'").first()["data_type"]


def replace(df: DataFrame, table: str) -> None:
    """Make ``df`` the content of an unpartitioned table, even if ``df`` reads that table.

    The rows go to a new folder beside the old one and the table is then pointed at it, so
    readers see the old content or the new, and a failed write changes nothing. If another writer
    replaced the table meanwhile, nothing is changed and the call raises; repeat it then.
    """
    spark = df.sparkSession
    current = spark.table(table)
    before = _location(spark, table)
    base = re.sub(r"@[0-9a-f]{32}$", "", before.rstrip("/"))
    snapshot = f"{base}@{uuid.uuid4().hex}"
    extra = set(df.columns) - set(current.schema.names)
    if extra:
        raise ValueError(f"{sorted(extra)} are no columns of {table}; add them first")
    evolve(df, current.schema).write.parquet(snapshot)
    spark.catalog.refreshTable(table)
    if _location(spark, table) != before:
        raise RuntimeError(f"{table} was replaced by another writer; run again")
    quoted = snapshot.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{quoted}'")
    spark.catalog.refreshTable(table)


def replace_partitions(df: DataFrame, table: str) -> None:
    """Overwrite only the partitions that occur in ``df``, which may read the table itself.

    A file table cannot be overwritten while it is read, so the rows are staged first; the
    staged copy also lets a failed overwrite be repeated.
    """
    spark = df.sparkSession
    staged = shared_dir(spark, "staged-partitions")
    columns = spark.table(table).columns
    df.select(*columns).write.parquet(staged)
    # insertInto takes the overwrite mode from the session only; the caller's stays as it is.
    writer = spark.newSession()
    writer.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    writer.read.parquet(staged).select(*columns).write.insertInto(table, overwrite=True)
    spark.catalog.refreshTable(table)
