"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.session import staged


def fold(doc_id: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, rows: int, parts: int, held_out: int
) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside the held-out fold.

    The rows with the smallest id hashes are taken, whatever the size of the table, and staged.
    Rows without id or label do not count; repeated ids with different labels count as 1.
    """
    known = labels.select("doc_id", F.col(target).cast("int").alias("label")).dropna()
    known = known.filter(fold("doc_id", parts) != held_out)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "label-sample")
    texts = docs.select("doc_id", "text").dropna(subset=["text"]).join(chosen, "doc_id")
    return staged(texts.dropDuplicates(["doc_id"]).select("doc_id", "text", "label"), "label-texts")
