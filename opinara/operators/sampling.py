"""Exact random samples per group, and the text built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def sample_key(id_col: str, seed: str) -> Column:
    """A repeatable random order: the digest of seed and id."""
    return F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))


def sampled_ids(
    rows: DataFrame, group: str, id_col: str, k: int, seed: str, slices: int = 64
) -> DataFrame:
    """Ids of the ``k`` lowest sample keys per group, at most ``k`` per group.

    Ranks run on ids alone, first inside slices of a group and then over the survivors. A slice is
    some of the read tasks, so each task sends its ``k`` lowest rows of a group to one slice only;
    the result does not depend on the slicing. ``k`` must be within the limit up to which Spark
    ranks before the shuffle.
    """
    limit = int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if k > limit:
        raise ValueError(f"k is {k}; raise spark.sql.optimizer.windowGroupLimitThreshold ({limit})")
    slice_of = F.pmod(F.spark_partition_id(), F.lit(slices))
    keyed = rows.select(
        group, id_col, sample_key(id_col, seed).alias("sample_key"), slice_of.alias("_slice")
    )

    def lowest(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("sample_key", id_col)
        return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)

    return lowest(lowest(keyed, group, "_slice").drop("_rank"), group).select(
        group, id_col
    )


def sample_per_group(
    rows: DataFrame, group: str = "game", id_col: str = "review_id", k: int = 700, seed: str = "s"
) -> DataFrame:
    """Up to ``k`` random rows of every group.

    The sampled ids are staged, so while they are few the texts are not shuffled to meet them.
    """
    ids = staged(sampled_ids(rows, group, id_col, k, seed), "sample")
    return rows.join(ids, [group, id_col]).withColumn("sample_key", sample_key(id_col, seed))


def review_line() -> Column:
    """``- (score/5, sentiment) content``; a missing score or sentiment prints None."""
    return F.concat(
        F.lit("- ("),
        F.coalesce(F.col("score").cast("string"), F.lit("None")),
        F.lit("/5, "),
        F.coalesce("sentiment", F.lit("None")),
        F.lit(") "),
        F.col("content"),
    )


def review_blob(sample: DataFrame, group: str = "game") -> DataFrame:
    """The sample of each group as one text, a line per review. The sample size bounds it."""
    lines = sample.select(group, "review_id", "sample_key", review_line().alias("line"))
    return lines.groupBy(group).agg(
        F.expr(
            "listagg(line, '\\n') WITHIN GROUP (ORDER BY sample_key, review_id)"
        ).alias("blob")
    )
