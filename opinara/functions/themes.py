"""Dimension flags: parsing, flattening and theme arrays."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ALL, DIMENSIONS, DIMS_STRUCT, THEME_LABELS


def parse_dims(json_text: Column) -> Column:
    """JSON text -> struct of seven booleans. Malformed text or absent keys give NULL fields."""
    return F.from_json(json_text, DIMS_STRUCT)


def flatten_dims(df: DataFrame, struct_col: str, *drop: str) -> DataFrame:
    """Lift the seven flags out of ``struct_col`` to top level and drop the temporaries."""
    gone = {struct_col, *drop}
    kept = [F.col(c) for c in df.columns if c not in gone]
    return df.select(*kept, *[F.col(f"{struct_col}.{d}").alias(d) for d in DIMENSIONS])


def themes_array(labels: Mapping[str, str] = THEME_LABELS) -> Column:
    """Labels of the raised theme flags, in label-map order."""
    return F.array_compact(
        F.array(*[F.when(F.col(flag), F.lit(label)) for flag, label in labels.items()])
    )


def has_theme(label: str, labels: Mapping[str, str] = THEME_LABELS) -> Column:
    """Rows with the theme: tests the one flag, so it prunes columns and reaches the scan.

    An unknown label matches nothing, as a membership test on the array would.
    """
    if label == ALL:
        return F.lit(True)
    flags = [flag for flag, known in labels.items() if known == label]
    return F.coalesce(F.col(flags[0]), F.lit(False)) if flags else F.lit(False)
