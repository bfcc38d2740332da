"""Upsert and delete as DataFrame functions.

Parquet tables have no MERGE or DELETE. Each function returns the full new content of the
table; ``plans.tables`` writes it. Joins carry no broadcast hint: Spark broadcasts a side whose
measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles on the key beyond.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_unique(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``source`` unchanged, failing the job if a key occurs twice (NULL keys never match).

    Two rows of a key are enough to fail, so the rank filter keeps two per key and task before
    the shuffle; a row with a NULL key is a group of its own.
    """
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    own_group = F.when(~known, F.monotonically_increasing_id())
    nth = F.row_number().over(Window.partitionBy(*keys, "_own").orderBy(*keys))
    message = F.concat(
        F.lit(f"duplicate merge key {tuple(keys)}: "),
        F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]),
    )
    check = F.when(F.col("_nth") > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    return (
        source.withColumn("_own", own_group)
        .withColumn("_nth", nth)
        .filter((F.col("_nth") <= 2) & check)
        .select(*source.columns)
    )


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows replace target rows with the same key; the rest of the target stays."""
    kept = target.join(source.select(*keys), list(keys), "left_anti").select(*target.columns)
    return kept.unionByName(require_unique(source, keys))


def partial_upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Sequence[str],
    insert: Mapping[str, Column],
) -> DataFrame:
    """Matched rows take only ``update`` columns; new rows take the source and ``insert``.

    ``insert`` gives the columns the source does not carry (defaults, timestamps).
    """
    checked = require_unique(source, keys)
    t = target.withColumn("_in_target", F.lit(True)).alias("t")
    s = checked.withColumn("_in_source", F.lit(True)).alias("s")
    same_key = reduce(and_, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys])
    matched = F.col("_in_target") & F.col("_in_source")
    is_new = F.col("_in_target").isNull()

    def new_value(name: str) -> Column:
        return F.col(f"s.{name}") if name in source.columns else insert[name]

    def value(name: str) -> Column:
        picked = F.when(is_new, new_value(name))
        if name in update:
            picked = picked.when(matched, F.col(f"s.{name}"))
        return picked.otherwise(F.col(f"t.{name}")).alias(name)

    return t.join(s, same_key, "full_outer").select(*[value(c) for c in target.columns])


def delete_keys(target: DataFrame, keys: DataFrame) -> DataFrame:
    """Target rows whose key is not in ``keys`` (all its columns form the key)."""
    return target.join(keys, keys.columns, "left_anti").select(*target.columns)


def deletion_report(target: DataFrame, keys: DataFrame) -> DataFrame:
    """Every requested key with ``removed``: whether the target held it."""
    held = target.select(*keys.columns).distinct().withColumn("removed", F.lit(True))
    return (
        keys.distinct()
        .join(held, keys.columns, "left")
        .withColumn("removed", F.coalesce("removed", F.lit(False)))
    )


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, as typed NULLs, in schema order.

    Columns that the schema does not name stay, behind the others.
    """
    have = set(df.columns)
    return df.select(
        *[
            F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ],
        *[c for c in df.columns if c not in schema.names],
    )
