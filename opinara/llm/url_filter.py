"""URL rules by a sort-merge range join.

A host is written from its last label on, each label closed by a dot (``org.example.``), so a rule's
host and all its subdomains are one interval of keys, and intervals nest. Rules and URLs are dealt
by key ranges and sorted together. One sweep over a range keeps a stack of the rule hosts whose
interval holds the current key, each with its paths; the longest rule of the stack whose path
begins the URL's path wins (most characters of host and path; on a tie the longer host).

Ranges are cut at fences: quantiles of a bounded sample of keys, which decide balance and never the
result. A rule goes to every range its interval meets, so broad rules are repeated once a range and
narrow ones are not. URL rows are ordered by (key, path, id) across the fences, so a host with a
third of all rows spreads over many ranges.

URL parts: host from the first ``://`` up to ``/``, ``?``, ``#`` or the end with A-Z lower-cased;
path from there up to ``?``, ``#`` or the end; both empty without ``://`` or for null. Such rows and
rows without a rule get the default verdict. Of rules with equal host and path, block wins. Rules
with a null part or no host are ignored. Repeated rows each get a verdict, rows without an id too. Extra
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAMPLE = 20_000
AFTER_DOT = "/"  # the character after "."
NO_ID = 2  # kind of a URL row without an id; ids themselves are never null, so pandas keeps them exact
SCHEMA = "id long, host string, path string, rule string, verdict string"


def url_host(url: str = "url") -> Column:
    u = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: str = "url") -> Column:
    u = F.coalesce(F.col(url), F.lit(""))
    return F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def fences(rows: DataFrame, ranges: int) -> list[tuple[str, str, int]]:
    """At most ``ranges`` - 1 cut points (key, path, id) from a bounded sample of the rows."""
    share = min(1.0, SAMPLE / max(rows.count(), 1))
    picked = rows.sample(share, seed=7) if share < 1 else rows
    found = sorted({(r.key, r.path, r.id) for r in picked.limit(2 * SAMPLE).collect()})
    step = max(1, len(found) // ranges)
    return found[step::step][: ranges - 1]


def _deal(batches: Iterator[pd.DataFrame], cuts: list) -> Iterator[pd.DataFrame]:
    """The range of each URL; every range that a rule's interval meets."""
    keys = [c[0] for c in cuts]
    for x in batches:
        first, last = [], []
        for kind, key, path, i in zip(x.kind, x.key, x.path, x.id, strict=True):
            if kind == 0:
                # A cut at the key itself may leave URLs of this key in the range before it.
                first.append(bisect_left(keys, key))
                last.append(bisect_right(keys, key[:-1] + AFTER_DOT))
            else:
                place = bisect_right(cuts, (key, path, int(i)))
                first.append(place)
                last.append(place)
        x["part"] = [list(range(a, b + 1)) for a, b in zip(first, last, strict=True)]
        yield x


def _sweep(batches: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    """Rows sorted by (part, key, kind): the stack holds the rule hosts around the current key."""
    stack: list[tuple[str, dict[str, str], list[int]]] = []
    part = None
    for x in batches:
        out = []
        for p, kind, key, path, i, host, verdict in zip(
            x.part, x.kind, x.key, x.path, x.id, x.host, x.verdict, strict=True
        ):
            if p != part:
                stack, part = [], p
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                paths, sizes = stack[-1][1:]
                if paths.get(path) != "block":
                    paths[path] = verdict
                if len(path) not in sizes:
                    sizes.append(len(path))
                continue
            best = None
            for own, paths, sizes in stack if host else ():
                for n in sizes:
                    hit = paths.get(path[:n]) if n <= len(path) else None
                    rank = (len(own) - 1 + n, len(own))
                    if hit is not None and (best is None or rank > best[0]):
                        name = ".".join(reversed(own[:-1].split("."))) + path[:n]
                        best = (rank, name, hit)
            out.append((i, kind == NO_ID, host, path, best and best[1], best[2] if best else default))
        if not out:
            continue
        ids, unnamed, *rest = zip(*out, strict=True)
        ids = pd.arrays.IntegerArray(np.array(ids, np.int64), np.array(unnamed, bool))
        yield pd.DataFrame(dict(zip(["host", "path", "rule", "verdict"], rest, strict=True))).assign(id=ids)


def filter_urls(
    urls: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None
) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``urls`` (id, url).

    ``rules`` is (host, path, verdict). ``ranges`` defaults to the shuffle partitions.
    """
    spark = urls.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host = url_host()
    rows = urls.select(
        F.when(F.col("id").isNull(), NO_ID).otherwise(1).alias("kind"),
        host_key(host).alias("key"),
        url_path().alias("path"),
        F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"),
        host.alias("host"),
        F.lit(None).cast("string").alias("verdict"),
    )
    rule_host = F.translate("host", UPPER, LOWER)
    known = rules.dropna(subset=["host", "path", "verdict"]).filter("host <> ''").select(
        F.lit(0).alias("kind"),
        host_key(rule_host).alias("key"),
        "path",
        F.lit(0).cast("long").alias("id"),
        rule_host.alias("host"),
        "verdict",
    )
    cuts = fences(rows.select("key", "path", "id"), ranges)
    both = rows.unionByName(known)
    dealt = both.mapInPandas(
        lambda it: _deal(it, cuts),
        "kind int, key string, path string, id long, host string, verdict string, part array<int>",
    )
    dealt = dealt.withColumn("part", F.explode("part"))
    # Dealt by the number of the range: rows of one range stay together, a task may get several.
    dealt = dealt.repartition(len(cuts) + 1, "part")
    dealt = dealt.sortWithinPartitions("part", "key", "kind")
    return dealt.mapInPandas(lambda it: _sweep(it, default), SCHEMA)
