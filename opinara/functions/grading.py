"""The deterministic weekly grade."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grade(avg_score: Column, bug_rate: Column, neg_rate: Column) -> Column:
    """green / yellow / red. Toxicity is reported beside the grade but does not enter it."""
    # The thresholds of the grade rule.
    healthy = (avg_score >= 4.0) & (bug_rate < 0.15) & (neg_rate < 0.30)
    failing = (avg_score < 3.0) | (bug_rate >= 0.35) | (neg_rate >= 0.55)
    return (
        F.when(avg_score.isNull(), "yellow")
        .when(healthy, "green")
        .when(failing, "red")
        .otherwise("yellow")
    )
