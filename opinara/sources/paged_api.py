"""A paged, newest-first review API read on the executors.

A continuation token makes one target's pages sequential, so a target is the unit of work:
targets are spread over tasks and each task yields one page at a time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PAGE_FIELDS, PAGE_PAYLOAD
from ..session import staged

# fetch(package_name, language, country, count, token) -> (reviews, next token or None)
Fetch = Callable[[str, str, str, int, Any], tuple[list[dict], Any]]


def fetch_pages(
    targets: DataFrame,
    fetch: Fetch,
    country: str,
    page_count: int = 200,
    pause_s: float = 0.3,
    parallelism: int = 32,
    run: str | None = None,
) -> DataFrame:
    """Page payload rows of every target, landed before they are used.

    Each page is asked for once and under one run key (``run``, by default the time), so what is
    posted meanwhile cannot shift the positions that the ingest compares.

    ``targets`` has package_name, language, ``last_at`` (watermark or NULL) and ``max_pages``
    (cap or NULL). A target ends with the token, at its cap, or after the page that holds a
    review older than its watermark; ``operators.ingest.source_cut`` makes the exact cut.
    """
    columns = PAGE_PAYLOAD.names
    run = run or f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"
    dtypes = {"page": "int32", "pos": "int64", "score": "Int32", "thumbsUpCount": "Int32"}

    def read_target(row) -> Iterator[pd.DataFrame]:
        token, page = None, 0
        while True:
            if page:
                time.sleep(pause_s)
            reviews, token = fetch(row.package_name, row.language, country, page_count, token)
            payload = [
                {
                    "package_name": row.package_name,
                    "language": row.language,
                    "run": run,
                    "page": page,
                    "pos": pos,
                    # Key access: a field the source no longer sends must fail, not be NULL.
                    **{field: review[field] for field in PAGE_FIELDS},
                }
                for pos, review in enumerate(reviews)
            ]
            if payload:
                yield pd.DataFrame(payload, columns=columns).astype(dtypes)
            page += 1
            past_mark = pd.notna(row.last_at) and any(r["at"] < row.last_at for r in reviews)
            at_cap = pd.notna(row.max_pages) and page >= row.max_pages
            if token is None or past_mark or at_cap:
                return

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield from read_target(row)

    work = targets.select(
        "package_name",
        "language",
        F.col("last_at").cast("timestamp_ntz").alias("last_at"),
        F.col("max_pages").cast("int").alias("max_pages"),
    )
    return staged(work.repartition(parallelism).mapInPandas(read, PAGE_PAYLOAD), "pages")
