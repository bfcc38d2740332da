"""WARC archives: written with duplicates as revisits, read back by boundary-chain verification.

Writing: one record per page, an HTTP response whose entity is the page in UTF-8. Of pages with
equal payloads of at least ``MIN_BYTES`` the one with the largest page_id is stored, the others
become revisit records without payload. Groups of copies are found by partial aggregation on the
payload's SHA-1; only groups of two or more are joined back.

Reading: the version line that opens a record also occurs inside payloads. Files are cut at every
version line; each cut is a candidate that names its successor (start + header + Content-Length +
closing blank lines). Only candidates that are reachable from the file's start over such links are
records. Links are followed by pointer jumping: inside a chunk of a file on arrays, between chunks
by joins that double the distance each round. A record whose payload holds version lines is put
together again from its cuts.

Null html is an empty payload, a null page_id or url leaves its header out. Rows that repeat the
largest page_id of a group are all responses. A chain that breaks (a cut file) ends there; what
came before is returned. Files hold at most ``FILE_ROWS`` records each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.session import staged

MIN_BYTES = 1000
FILE_ROWS = 20_000
CHUNK = 64 << 20
VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
RECORD = "urn:page:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _header(name: str, value: Column) -> Column:
    """A header line, or null if the value is."""
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """(record): the text of one WARC record per page, without the closing blank lines."""
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    )
    p = p.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    p = p.withColumn("bytes", F.octet_length("html").cast("long"))
    groups = p.filter(F.col("bytes") >= MIN_BYTES).groupBy("digest", "bytes")
    groups = groups.agg(F.max("page_id").alias("first"), F.count("*").alias("times"))
    groups = staged(groups.filter("times > 1 AND first IS NOT NULL"), "warc-groups")
    p = p.join(groups, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit(_HTTP), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return p.select(
        F.concat_ws(
            "",
            F.lit(VERSION),
            _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            _header(
                "WARC-Record-ID",
                F.concat(
                    F.lit(f"<{RECORD}"),
                    F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                    F.lit(">"),
                ),
            ),
            _header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
            _header("WARC-Target-URI", url),
            _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            _header("X-Payload-Bytes", F.col("bytes")),
            _header(
                "WARC-Refers-To",
                F.when(
                    revisit, F.concat(F.lit(f"<{RECORD}"), F.col("first").cast("string"), F.lit(">"))
                ),
            ),
            _header(
                "WARC-Profile",
                F.when(
                    revisit,
                    "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                ),
            ),
            _header("Content-Type", F.lit("application/http; msgtype=response")),
            _header("Content-Length", F.octet_length(block)),
            F.lit("\r\n"),
            block,
        ).alias("record")
    )


def write(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write the archives of ``pages`` (page_id, url, html) into a folder."""
    out = records(pages).write.option("lineSep", END).option("compression", compression)
    out.option("maxRecordsPerFile", FILE_ROWS).text(path)


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    """The text between version lines, in file order inside each split."""
    raw = spark.read.option("lineSep", VERSION).text(path)
    return raw.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.octet_length("value").cast("long").alias("size"),
    )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add each cut's distance from the first byte of its split. Splits arrive one after another."""
    here, total = None, 0
    for batch in batches:
        files = batch.column(batch.schema.get_field_index("file")).to_pylist()
        splits = batch.column(batch.schema.get_field_index("split")).to_pylist()
        sizes = batch.column(batch.schema.get_field_index("size")).to_pylist()
        out = []
        for name, split, size in zip(files, splits, sizes, strict=True):
            if (name, split) != here:
                here, total = (name, split), 0
            out.append(total)
            total += size + len(VERSION)
        yield batch.append_column("rel", pa.array(out, pa.int64()))


def _fields(cuts: DataFrame) -> DataFrame:
    """Header fields of each cut and, where the cut holds the whole record, its payload's digest."""
    head = F.substring_index("value", END, 1)

    def field(name: str) -> Column:
        return F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)

    c = cuts.withColumn("head", F.when(F.instr("value", END) > 0, head))
    c = c.withColumn("length", field("Content-Length").try_cast("long"))
    need = F.octet_length("head") + 2 * len(END) + F.col("length")
    c = c.withColumn("need", need.cast("long"))
    opened = (F.octet_length(F.substring_index("value", END, 2)) + len(END)).cast("int")
    c = c.withColumn("payload", _payload("value", "need", opened))
    return c.select(
        "file",
        "split",
        "size",
        "need",
        field("WARC-Type").alias("record_type"),
        F.regexp_extract("head", rf"WARC-Record-ID: <{RECORD}(-?\d+)>", 1).try_cast("long").alias("page_id"),
        F.regexp_extract("head", rf"WARC-Refers-To: <{RECORD}(-?\d+)>", 1).try_cast("long").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"),
        field("X-Payload-Bytes").try_cast("long").alias("stated_bytes"),
        F.when(F.col("size") >= F.col("need"), F.sha1("payload")).alias("digest"),
        F.when(F.col("size") >= F.col("need"), F.octet_length("payload")).cast("long").alias("bytes"),
    )


def _payload(value: str, need: str, opened: Column) -> Column:
    """Bytes of a record's HTTP entity."""
    size = (F.col(need) - len(END) - opened).cast("int")
    return F.substring(F.col(value).cast("binary"), opened + 1, size)


def _located(cuts: DataFrame) -> DataFrame:
    """Add ``offset``, the byte in its file where the version line before the cut begins."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cuts.schema)
    return cuts.mapInArrow(_running, f"{fields}, rel long")


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Where the chain that begins at each candidate leaves the chunk, by pointer jumping."""
    rows = rows.sort_values("offset").drop_duplicates("offset")
    at = rows.offset.to_numpy()
    to = rows.succ.fillna(-1).to_numpy(np.int64)
    place = np.minimum(np.searchsorted(at, to), len(at) - 1)
    hop = np.where(at[place] == to, place, np.arange(len(at)))
    while True:
        further = hop[hop]
        if (further == hop).all():
            break
        hop = further
    return pd.DataFrame({"file": rows.file, "at": at, "leaves": to[hop]})


def _marked(rows: pd.DataFrame) -> pd.DataFrame:
    """Candidates on the chain from the chunk's entries, by pointer jumping from the entries."""
    entries = rows[rows.entry].offset.unique()
    rows = rows[~rows.entry].sort_values("offset").drop_duplicates("offset")
    at = rows.offset.to_numpy()
    to = rows.succ.fillna(-1).to_numpy(np.int64)
    on = np.isin(at, entries)
    place = np.minimum(np.searchsorted(at, to), max(len(at) - 1, 0))
    hop = np.where(at[place] == to, place, np.arange(len(at))) if len(at) else place
    while True:
        after = on.copy()
        after[hop[on]] = True
        if (after == on).all():
            break
        on, hop = after, hop[hop]
    return rows[on][["file", "offset"]]


def _chain(cands: DataFrame) -> DataFrame:
    """(file, offset) of the candidates (file, offset, succ) that are reachable from byte 0."""
    cands = cands.withColumn("chunk", F.floor(F.col("offset") / CHUNK))
    exits = cands.groupBy("file", "chunk").applyInPandas(
        lambda rows: _exits(rows), "file string, at long, leaves long"
    )
    exits = staged(exits, "warc-exits")
    starts = cands.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    targets = exits.select("file", F.col("leaves").alias("at")).union(starts).distinct()
    jump = staged(exits.join(targets, ["file", "at"]), "warc-jumps")
    reached = staged(starts, "warc-reached")
    known = reached.count()
    while True:
        more = reached.join(jump, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        reached = staged(reached.union(more.filter("at >= 0")).distinct(), "warc-reached")
        now = reached.count()
        # The end of a file is reached as an entry, too, and leads nowhere.
        if now == known:
            break
        known = now
        far = jump.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("far"))
        jump = staged(
            jump.join(far, ["file", "leaves"]).select("file", "at", F.col("far").alias("leaves")),
            "warc-jumps",
        )
    entry = reached.select(
        "file",
        F.col("at").alias("offset"),
        F.lit(None).cast("long").alias("succ"),
        F.floor(F.col("at") / CHUNK).alias("chunk"),
        F.lit(True).alias("entry"),
    )
    both = cands.select("file", "offset", "succ", "chunk", F.lit(False).alias("entry")).union(entry)
    return both.groupBy("file", "chunk").applyInPandas(
        lambda rows: _marked(rows), "file string, offset long"
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each verified record.

    The digest and size of a response are taken from its payload as read, those of a revisit from
    its header.
    """
    cuts = staged(_located(_fields(_cuts(spark, path))), "warc-cuts")
    bases = _bases(cuts)
    cands = _with_offset(cuts, bases)
    cands = cands.withColumn("succ", F.col("offset") + len(VERSION) + F.col("need"))
    cands = staged(cands.filter("offset >= 0"), "warc-candidates")
    good = staged(_chain(cands.select("file", "offset", "succ")), "warc-chain")
    found = cands.join(good, ["file", "offset"])
    broken = found.filter("size < need").select("file", "offset", "succ")
    broken = staged(broken, "warc-broken")
    if not broken.isEmpty():
        whole = _rejoined(spark, path, bases, cands, broken)
        found = found.join(whole, ["file", "offset"], "left")
        found = found.withColumn("digest", F.coalesce("whole_digest", "digest"))
        found = found.withColumn("bytes", F.coalesce("whole_bytes", "bytes"))
    again = F.col("record_type") == "revisit"
    return found.select(
        "page_id",
        F.when(again, F.col("stated_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(again, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.when(again, F.col("refers_to")).alias("refers_to"),
    )


def _bases(cuts: DataFrame) -> DataFrame:
    """(file, split, base): bytes of a file before each of its splits; one row per split."""
    sums = cuts.groupBy("file", "split").agg(F.sum(F.col("size") + len(VERSION)).alias("n"))
    before = sums.select("file", F.col("split").alias("earlier"), F.col("n").alias("m"))
    joined = sums.join(before, "file").filter("earlier < split")
    base = joined.groupBy("file", "split").agg(F.sum("m").alias("base"))
    base = sums.join(base, ["file", "split"], "left")
    return staged(base.select("file", "split", F.coalesce("base", F.lit(0)).alias("base")), "warc-bases")


def _with_offset(cuts: DataFrame, bases: DataFrame) -> DataFrame:
    offset = F.col("base") + F.col("rel") - len(VERSION)
    return cuts.join(bases, ["file", "split"]).withColumn("offset", offset)


def _rejoined(spark, path: str, bases: DataFrame, cands: DataFrame, broken: DataFrame) -> DataFrame:
    """Payload figures of records whose payload holds version lines. The archive is read once more.

    The cuts of one record are collected together, so a task holds one record at a time.
    """
    inner = cands.select("file", F.col("offset").alias("part"), "size")
    ranges = broken.select("file", "offset", "succ")
    # Cuts per chunk, so that the range condition is checked within one chunk only.
    spans = ranges.withColumn(
        "chunk",
        F.explode(F.sequence(F.floor(F.col("offset") / CHUNK), F.floor(F.col("succ") / CHUNK))),
    )
    inner = inner.withColumn("chunk", F.floor(F.col("part") / CHUNK))
    owned = inner.join(spans, ["file", "chunk"]).filter("part >= offset AND part < succ")
    owned = owned.select("file", "part", "offset")
    cuts = _located(_cuts(spark, path))
    parts = _with_offset(cuts, bases).withColumnRenamed("offset", "part").join(owned, ["file", "part"])
    whole = parts.groupBy("file", "offset").agg(
        F.array_sort(F.collect_list(F.struct("part", "value"))).alias("cuts")
    )
    value = F.array_join(F.transform("cuts", lambda c: c["value"]), VERSION)
    whole = whole.select("file", "offset", value.alias("value"), F.lit(0).alias("size"))
    whole = whole.withColumn("head", F.substring_index("value", END, 1))
    length = F.regexp_extract("head", r"(?:^|\r\n)Content-Length: ([^\r\n]*)", 1).try_cast("long")
    whole = whole.withColumn("need", F.octet_length("head") + 2 * len(END) + length)
    opened = (F.octet_length(F.substring_index("value", END, 2)) + len(END)).cast("int")
    whole = whole.withColumn("payload", _payload("value", "need", opened))
    return whole.select(
        "file",
        "offset",
        F.sha1("payload").alias("whole_digest"),
        F.octet_length("payload").cast("long").alias("whole_bytes"),
    )
