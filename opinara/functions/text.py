"""Text gates. The three rules differ on purpose; each operator names the one it uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_text(content: Column) -> Column:
    """Not NULL and not blank: the gate for enrichment and for the reader."""
    return content.isNotNull() & (F.length(F.trim(content)) > 0)


def has_content(content: Column) -> Column:
    """Not NULL; blank strings pass: the gate for weekly aggregates and samples."""
    return content.isNotNull()


def longer_than(content: Column, n: int = 20) -> Column:
    """Not NULL and more than ``n`` characters, untrimmed: the gate for recent reviews."""
    return content.isNotNull() & (F.length(content) > n)
