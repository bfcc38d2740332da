"""Exact set-similarity self join of documents by a universe partition and the pigeonhole principle.

A document is the set of its distinct word shingles. Two sets of sizes n and s that reach the
threshold t differ in at most H = (n + s)(1 - t) / (1 + t) shingles. Per size band the universe of
shingles is hashed into segments, and a cost choice (`allocate`: keys written against chance meetings
expected among all rows) gives the band one of two forms. The choice changes the work, never the
result.

* Deletions, for small sets: a segment is worth 2 when it is indexed by its subset and all subsets
  with one shingle deleted, 1 when by its exact subset alone. A record indexes leading segments
  until their worth exceeds its H; two records that link share at least one key.
* Exact subsets: a record indexes one leading segment more than its H, and a spare that is the same
  for all records of the band, a share ``SPARE`` of the band's H. Linked records agree on more than
  the spare of the leading segments that both index. Keys are ordered by how many records hold them,
  and each record leaves out its most frequent ones, as many as the spare; two records that link
  share one that both keep. Keys that a large group shares are so kept only where a record has no
  rarer ones, and keys that no other record holds drop out before a comparison.

Before all this, two sieves take out the records that cannot link with any other. A shingle that no other set
holds is in one set of a pair alone, so a set of size n with more than n(1 - t) of them has no partner. The universe is
dealt out by hash, a part to a task, packed: few rows move, and numpy counts. The first sieve takes a share of the
universe that is large enough to tell for most sets without a near copy; the second takes all of it, counted among the
records left. Only what is left gets keys and tags, so texts of their own neither cost keys nor meet by chance in
segments that both leave empty, which would grow with the square of the rows.

Keys are written in up to ``SLICES`` by segment, and one slice after another is searched for keys that two
records hold and then deleted, so the shuffles of one slice alone are on disk at a time. Other staged tables go
as soon as the table made from them is staged.

Records of a shared key are a bucket. Buckets are not expanded into pairs. Rounds of verification
compare hubs with the members that are still in another component and whose segments' tags allow a
link; each round retires its hubs and
draws many times as many, until no bucket holds members of two components that were not compared.
Near copies share most of their buckets. The buckets of a record have an order, larger ones first, and each membership
carries the ``EARLIER`` buckets before its own. Where those of hub and member overlap, the two meet in an
earlier bucket and are left to it; the first bucket that two records share never leaves them out.
Memberships are narrow: tags, staged once per record and band, join them where a round pairs its hubs and members and
are never staged by bucket. Texts are read only of the records in pairs that the tags let through.
Copies of one set are collapsed before all this, so a large group of copies is one record.

Records are numbered by doc_id. Rows without an id and rows whose id stands for several sets are numbered
by a 64-bit hash of their set instead, so no set and no link is lost on them.

Nulls, empty texts: empty set, linked with nothing. Repeated doc_ids with equal sets collapse; with
different sets each row keeps its own and the id is one node, so all that link with either are one
component. Rows without a doc_id link others but are returned with a null component. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinara.llm import textvec as tv
from opinara.session import delete_folder, discard, shared_dir, staged

_U = np.uint64
SPARE = 0.25  # keys that a record may leave out, for each segment in which linked records may differ
CELLS = 3  # tags of a record in a band, for each segment in which linked records may differ
TAG_BITS = 4
PER_LONG = 64 // TAG_BITS  # tags packed in a number, so that records of a bucket are cheap to deal out
SLICES = 8  # parts of the key space that are shuffled one after another
MORE_HUBS = 64  # times as many hubs of a bucket in each further round
EARLIER = 8  # buckets of a record that each of its memberships knows
SLICED = 1 << 22  # shingles of all records for which one slice is enough
SIEVED = 500  # rows from which the sieves are worth their passes: chance meetings grow with the square of the rows
PACKED = 1 << 20  # shingles that a task packs at a time
FEW_IDS = 1_000_000  # ids that are broadcast


def distinct_shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct k-word shingle, sorted; short rows give one whole shingle."""
    w = tv.words(column)
    at, h = tv.grams(w, k)
    row = w.row[at]
    n = np.bincount(w.row, minlength=len(column)) if len(w) else np.zeros(len(column), int)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        first = np.searchsorted(w.row, short)
        whole = tv.mix(w.hash[first], 101)
        for i in range(1, k - 1):
            more = n[short] > i
            nxt = w.hash[np.minimum(first + i, len(w) - 1)]
            whole = np.where(more, tv.mix(whole * _U(3) + nxt, 101 + i), whole)
        row, h = np.concatenate([row, short]), np.concatenate([h, whole])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


class Bands:
    """Size bands, segments per band and their allocation, for a threshold in percent."""

    RATIO = 1.5

    def __init__(self, percent: int, rows: int, ratio: float | None = None):
        self.percent, self.rows = percent, max(rows, 1)
        ratio = ratio or self.RATIO
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * ratio))))
        self.low = np.array(edges[:-1], np.int64)
        high = np.array(edges[1:], np.int64) - 1
        self.high = high
        self.budget = self.apart(100 * high // percent, high) + 1
        self.deleting = np.array(
            [allocate(int(n), int(h), self.rows) for n, h in zip(self.low, self.budget, strict=True)]
        )
        self.spare = np.where(self.deleting > 0, 0, np.ceil(SPARE * self.budget).astype(np.int64))
        self.segments = np.where(
            self.deleting > 0, self.budget - self.deleting, self.budget + self.spare
        )

    def apart(self, n, s):
        """Most shingles in which linked sets of these sizes can differ."""
        return (n + s) * (100 - self.percent) // (100 + self.percent)

    def entries(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each set size: (index into n, band, worth that must be indexed there)."""
        own = np.searchsorted(self.low, n, "right") - 1
        need = self.apart(n, 100 * n // self.percent) + 1
        idx, band, worth = [np.flatnonzero(n > 0)], [own[n > 0]], [need[n > 0]]
        least = -(-self.percent * n // 100)  # of a partner
        below = own - 1
        while True:
            reach = np.flatnonzero((n > 0) & (below >= 0) & (least <= self.high[below]))
            if not len(reach):
                break
            idx.append(reach)
            band.append(below[reach])
            worth.append(self.apart(n[reach], self.high[below[reach]]) + 1)
            below = below - 1
        return np.concatenate(idx), np.concatenate(band), np.concatenate(worth)


def allocate(size: int, budget: int, rows: int) -> int:
    """Segments of a band that are indexed with one-shingle deletions, by the least cost.

    Cost of a record: its keys, plus the rows it meets by chance because both subsets are empty or,
    with deletions, have one shingle at most. ``rows`` is the number of documents. Up to 64
    segments with deletions are weighed; past that the load per segment makes them a loss.
    """
    d = np.arange(min(budget // 2, 64) + 1, dtype=float)
    exact = budget - 2 * d
    load = size / (budget - d)
    meet = np.exp(-2 * load) * (exact + d * (1 + load) ** 2)
    cost = exact + d * (load + 1) + rows * meet
    return int(np.argmin(cost))


def signatures(row: np.ndarray, shingle: np.ndarray, n: np.ndarray, bands: Bands):
    """Keys of each row's set as (row, key, slot, place) arrays. ``n`` holds every row's set size.

    A slot numbers the band and says how many of the record's most frequent keys may be left out; the
    place is the key's segment.
    """
    idx, band, worth = bands.entries(n)
    if not len(idx):
        nothing = np.zeros(0, np.int64)
        return nothing, np.zeros(0, _U), nothing, nothing
    d, m, spare = bands.deleting[band], bands.segments[band], bands.spare[band]
    used = np.where(worth <= 2 * d, -(-worth // 2), worth - d)
    used = np.where(d > 0, used, worth + spare)
    base = np.cumsum(used) - used
    begin = np.searchsorted(row, np.arange(len(n)))
    count = n[idx]
    entry = np.repeat(np.arange(len(idx)), count)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count) + begin[idx][entry]
    x = shingle[at]
    seg = (tv.mix(x + band[entry].astype(_U) * _U(0x9E3779B1), 7) % m[entry].astype(_U)).astype(
        np.int64
    )
    keep = seg < used[entry]
    entry, seg, x = entry[keep], seg[keep], tv.mix(x[keep], 11)
    slot = base[entry] + seg
    total = np.zeros(int(used.sum()), _U)
    np.add.at(total, slot, x)
    size = np.bincount(slot, minlength=len(total))
    owner = np.repeat(np.arange(len(idx)), used)
    place = np.arange(len(total)) - base[owner]

    def key(total, size, owner, place):
        where = (band[owner].astype(_U) << _U(32)) + place.astype(_U)
        return tv.mix(total + tv.mix(where, 13) + size.astype(_U) * _U(0x2545F4914F6CDD1D), 17)

    cut = seg < d[entry]
    slot, x = slot[cut], x[cut]
    keys = [key(total, size, owner, place), key(total[slot] - x, size[slot] - 1, owner[slot], place[slot])]
    owner, place = np.concatenate([owner, owner[slot]]), np.concatenate([place, place[slot]])
    return idx[owner], np.concatenate(keys), (band[owner] << 32) + spare[owner], place


def cell_tags(row: np.ndarray, shingle: np.ndarray, n: np.ndarray, bands: Bands):
    """Tags of each row's set in each of its bands as (row, band, numbers, packed) arrays.

    A band's universe is cut into at least ``CELLS`` times its budget; a tag is ``TAG_BITS`` bits of the
    sum of a cell's shingles, so cells with different tags differ, each by a shingle at least.
    ``numbers`` says how many packed numbers an entry has.
    """
    idx, band, _ = bands.entries(n)
    order = np.argsort(idx, kind="stable")
    idx, band = idx[order], band[order]
    numbers = -(-CELLS * bands.budget[band] // PER_LONG)
    cells = PER_LONG * numbers
    base = np.cumsum(cells) - cells
    begin, count = np.searchsorted(row, np.arange(len(n))), n[idx]
    entry = np.repeat(np.arange(len(idx)), count)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count) + begin[idx][entry]
    x = shingle[at]
    place = tv.mix(x + band[entry].astype(_U) * _U(0x9E3779B1), 37) % cells[entry].astype(_U)
    total = np.zeros(int(cells.sum()), _U)
    np.add.at(total, base[entry] + place.astype(np.int64), tv.mix(x, 41))
    tag = (tv.mix(total, 43) & _U((1 << TAG_BITS) - 1)).reshape(-1, PER_LONG)
    packed = np.bitwise_or.reduce(tag << (_U(TAG_BITS) * np.arange(PER_LONG, dtype=_U)), axis=1)
    return idx, band, numbers, packed


SET_SCHEMA = "slice int, doc_id long, n_shingles long, f1 long, f2 long, number long, own boolean, part int, shingles binary, holders binary"
PACKETS = "part int, a binary, b binary"
KEY_SCHEMA = (
    "slice int, id long, n_shingles long, text string, "
    "keys array<long>, slots array<long>, bands array<int>, tags array<array<long>>"
)


def column_names(schema: str) -> list[str]:
    return schema.replace(",", "").split()[::2]  # no type has a blank


def fingerprints(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two order-free hashes of each row's set, and one of both."""
    f1, f2 = np.zeros(rows, _U), np.zeros(rows, _U)
    np.add.at(f1, row, tv.mix(h, 19))
    np.add.at(f2, row, tv.mix(h, 23))
    return f1, f2, tv.mix(f1 + tv.mix(f2, 29), 31)


def _lists(at: np.ndarray, rows: int, *columns: np.ndarray) -> list[pa.Array]:
    """The values of each row as one list a column; ``at`` is ascending."""
    ends = pa.array(np.searchsorted(at, np.arange(rows + 1)), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(x)) for x in columns]


class Packets:
    """Pairs of values by part, packed: a row holds all that a task has for a part, so that few rows are shuffled."""

    def __init__(self, parts: int, *types):
        self.parts, self.types, self.held, self.size = parts, types, [], 0

    def add(self, part: np.ndarray, *values: np.ndarray) -> None:
        self.held.append((part.astype(np.int32), *(x.astype(t, copy=False) for x, t in zip(values, self.types, strict=True))))
        self.size += len(part)

    def take(self) -> list[pa.Array]:
        """The rows' columns; nothing is held afterwards."""
        part, *values = [np.concatenate(x) for x in zip(*self.held, strict=True)]
        self.held, self.size = [], 0
        order = np.argsort(part, kind="stable")
        part = part[order]
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        bounds = np.append(begin, len(part))
        out = [pa.array(part[begin], pa.int32())]
        for x in values:
            ends = pa.py_buffer((bounds * x.itemsize).astype(np.int32))
            out.append(pa.Array.from_buffers(pa.binary(), len(begin), [None, ends, pa.py_buffer(x[order])]))
        return out


def by_part(batches: Iterator[pa.RecordBatch], *types) -> Iterator[list[np.ndarray]]:
    """The two values of each part, unpacked. Rows come sorted by part."""
    now, held = None, []
    for batch in batches:
        for i, part in enumerate(batch.column(0).to_pylist()):
            if part != now and held:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            now = part
            # Copied, so that no batch is kept for a part of it.
            held.append([np.frombuffer(batch.column(j + 1)[i].as_buffer(), t).copy() for j, t in enumerate(types)])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def universe_parts(size: int) -> int:
    """Parts into which the shingles of ``size`` bytes of text are dealt."""
    return 1 + min(size >> 21, 256 + (size >> 24))


def universe_share(h: np.ndarray, share: float, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, part and short hash of the shingles that lie in the first ``share`` of the universe.

    Shingles with one part and one short hash count as one, which may only make them look shared.
    """
    u = tv.mix(h, 47)
    at = np.flatnonzero((u >> _U(54)) < _U(int(np.ceil(share * 1024))))
    u = u[at]
    return at, ((u >> _U(32)) & _U(0x3FFFFF)) % _U(parts), u & _U(0xFFFFFFFF)


def _sets(batches: Iterator[pa.RecordBatch], k: int, share: float, parts: int) -> Iterator[pa.RecordBatch]:
    """A row per document with its set's size and fingerprints (slice -1), and packets of shingles (slice 0).

    Shingles are packed once per set and task, by the row marked as ``own``, with the set's ``number``: the
    hash that also numbers the record if its id cannot. With no parts nothing is packed.
    """
    seen: set[tuple[int, int]] = set()
    packets = Packets(parts, np.uint32, _U)
    names = column_names(SET_SCHEMA)
    types = [pa.int32(), *[pa.int64()] * 5, pa.bool_(), pa.int32(), pa.binary(), pa.binary()]

    def rows_of(columns: dict[str, pa.Array], rows: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns[c] if c in columns else pa.nulls(rows, t) for c, t in zip(names, types, strict=True)], names
        )

    def packed() -> pa.RecordBatch:
        part, shingles, holders = packets.take()
        columns = {"part": part, "shingles": shingles, "holders": holders}
        return rows_of({"slice": pa.array(np.zeros(len(part), np.int32)), **columns}, len(part))

    for whole in batches:
        for part in tv.slices(whole, "text", 1 << 20):
            rows = part.num_rows
            row, h = distinct_shingles(part.column(1), k)
            n = np.bincount(row, minlength=rows).astype(np.int64)
            f1, f2, number = fingerprints(row, h, rows)
            own = np.zeros(rows, bool)
            for i, pair in enumerate(zip(f1.tolist(), f2.tolist(), strict=True)):
                if n[i] and pair not in seen:
                    seen.add(pair)
                    own[i] = True
            about = {"doc_id": part.column(0).cast(pa.int64()), "own": pa.array(own)}
            hashes = {"f1": f1, "f2": f2, "number": number, "n_shingles": n}
            about |= {c: pa.array(tv.signed(x)) for c, x in hashes.items()}
            yield rows_of({"slice": pa.array(np.full(rows, -1, np.int32)), **about}, rows)
            if not parts:
                continue
            held = own[row]
            row, h = row[held], h[held]
            at, of, short = universe_share(h, share, parts)
            packets.add(of, short, number[row[at]])
            if packets.size > PACKED:
                yield packed()
    if packets.size:
        yield packed()


def _packed(batches: Iterator[pa.RecordBatch], k: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Packets of all shingles of the records (id, text), with their ids."""
    packets = Packets(parts, np.uint32, np.int64)
    for whole in batches:
        for part in tv.slices(whole, "text", 1 << 20):
            row, h = distinct_shingles(part.column(1), k)
            at, of, short = universe_share(h, 1, parts)
            packets.add(of, short, part.column(0).to_numpy(zero_copy_only=False)[row[at]])
            if packets.size > PACKED:
                yield pa.RecordBatch.from_arrays(packets.take(), column_names(PACKETS))
    if packets.size:
        yield pa.RecordBatch.from_arrays(packets.take(), column_names(PACKETS))


def _lone(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """For each part of the universe its holders and how many of its shingles each holds alone, in packets by holder."""
    for short, holder in by_part(batches, np.uint32, np.int64):
        order = np.argsort(short)
        short, holder = short[order], holder[order]
        begin = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
        least, most = np.minimum.reduceat(holder, begin), np.maximum.reduceat(holder, begin)
        holder, count = np.unique(least[least == most], return_counts=True)
        if len(holder):
            packets = Packets(parts, np.int64, np.uint32)
            packets.add(tv.mix(holder.view(_U), 53) % _U(parts), holder, count)
            yield pa.RecordBatch.from_arrays(packets.take(), column_names(PACKETS))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for holder, count in by_part(batches, np.int64, np.uint32):
        holder, at = np.unique(holder, return_inverse=True)
        total = np.bincount(at, weights=count).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(holder), pa.array(total)], ["holder", "lone"])


def lone_shingles(packets: DataFrame, parts: int) -> DataFrame:
    """(holder, lone): how many shingles of the packets each holder shares with no other, if any.

    A part of the universe goes to one task, whatever number of records hold its shingles.
    """
    packets = packets.repartition("part").sortWithinPartitions("part")
    packets = packets.mapInArrow(lambda it: tv.lean(_lone(it, parts)), PACKETS)
    packets = packets.repartition("part").sortWithinPartitions("part")
    return packets.mapInArrow(lambda it: tv.lean(_sums(it)), "holder long, lone long")


def may_have_partner(percent: int) -> Column:
    """False only where a set has too many shingles of its own alone to link with any other.

    Another set shares at most ``n_shingles - lone`` of them, and the two have ``n_shingles`` at least.
    """
    shared = F.col("n_shingles") - F.coalesce("lone", F.lit(0))
    return 100 * shared >= percent * F.col("n_shingles")


def _keys(batches: Iterator[pa.RecordBatch], k: int, bands: Bands, slices: int) -> Iterator[pa.RecordBatch]:
    """A row per record (id, text) with its bands and tags (slice -1), and rows of keys by slice."""
    names = column_names(KEY_SCHEMA)
    for whole in batches:
        for part in tv.slices(whole, "text", 1 << 20):
            rows = part.num_rows
            row, h = distinct_shingles(part.column(1), k)
            n = np.bincount(row, minlength=rows).astype(np.int64)
            at, keys, slots, place = signatures(row, h, n, bands)
            # The segment decides the slice, so equal keys meet in one and each slice has its order.
            piece = place % slices
            order = np.lexsort((np.arange(len(at)), at, piece))
            at, keys, slots, piece = at[order], tv.signed(keys)[order], slots[order], piece[order]
            about = [part.column(0), pa.array(n)]
            empty = pa.nulls(rows, pa.list_(pa.int64()))
            who, band, numbers, tag = cell_tags(row, h, n, bands)
            ends = pa.array(np.concatenate([[0], np.cumsum(numbers)]), pa.int32())
            tags = pa.ListArray.from_arrays(ends, pa.array(tv.signed(tag)))
            of_row = pa.array(np.searchsorted(who, np.arange(rows + 1)), pa.int32())
            about_bands = [
                pa.ListArray.from_arrays(of_row, pa.array(band.astype(np.int32))),
                pa.ListArray.from_arrays(of_row, tags),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, -1, np.int32)), *about, part.column(1).cast(pa.string()), empty, empty, *about_bands], names
            )
            nothing = [pa.nulls(rows, x.type) for x in about_bands]
            for i in range(slices):
                cut = slice(*np.searchsorted(piece, [i, i + 1]))
                lists = _lists(at[cut], rows, keys[cut], slots[cut])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, i, np.int32)), *about, pa.nulls(rows, pa.string()), *lists, *nothing], names
                )


def document_sets(
    docs: DataFrame, k: int = 3, percent: int = 90
) -> tuple[DataFrame, DataFrame, str, int]:
    """All sets (id, doc_id, n_shingles, f1, f2, own); the records that may link, one a set, staged in a folder
    (slice -1: id, n_shingles, text, bands, tags; other slices: id, keys, slots); the folder and its number of slices.

    ``id`` numbers the record. From ``SIEVED`` rows on, two sieves find the records that cannot link with any
    other: the first over a share of the universe and all sets, the second over all of it and what is left.
    """
    spark = docs.sparkSession
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    share = min(1.0, (100 - percent) / 60)
    parts = universe_parts(size or 0) if rows >= SIEVED else 0
    got = docs.select("doc_id", "text")
    got = got.mapInArrow(lambda it: tv.lean(_sets(it, k, share, parts)), SET_SCHEMA)
    path = shared_dir(spark, "jaccard-sets")
    got.write.partitionBy("slice").parquet(path)
    got = spark.read.schema(SET_SCHEMA).parquet(path)
    sets = got.filter("slice = -1").drop("part", "shingles", "holders", "slice")
    same = ["f1", "f2", "n_shingles"]
    # Ids of several sets: each of their rows is numbered by its set.
    several = sets.groupBy("doc_id").agg(*[f(c) for f in (F.min, F.max) for c in same])
    differ = " OR ".join(f"`min({c})` <> `max({c})`" for c in same)
    several = staged(several.filter(differ).select("doc_id").dropna(), "jaccard-several")
    by_set = F.col("odd").isNotNull() | F.col("doc_id").isNull()
    sets = sets.join(several.withColumn("odd", F.lit(True)), "doc_id", "left")
    sets = sets.withColumn("id", F.when(by_set, F.col("number")).otherwise(F.col("doc_id")))
    # One record a set.
    left = sets.filter("own").groupBy(*same).agg(F.min("id").alias("id"), F.min("number").alias("holder"))
    if parts:
        packets = got.filter("slice = 0").select("part", F.col("shingles").alias("a"), F.col("holders").alias("b"))
        left = left.join(lone_shingles(packets, parts), "holder", "left").filter(may_have_partner(percent))
    left = staged(left.select("id", "n_shingles"), "jaccard-left")
    delete_folder(spark, f"{path}/slice=0")
    _release(spark)
    texts = record_texts(docs, several, left, k)
    if parts:
        parts = universe_parts(8 * (left.agg(F.sum("n_shingles")).first()[0] or 0))
        packets = texts.mapInArrow(lambda it: tv.lean(_packed(it, k, parts)), PACKETS)
        lone = lone_shingles(packets, parts).withColumnRenamed("holder", "id")
        done, left = left, left.join(lone, "id", "left").filter(may_have_partner(percent)).drop("lone")
        left = staged(left, "jaccard-left")
        discard(done)
    count, shingles = left.agg(F.count("*"), F.sum("n_shingles")).first()
    bands, slices = Bands(percent, count), min(SLICES, 1 + (shingles or 0) // SLICED)
    keyed = texts.join(left.select("id"), "id").select("id", "text")
    keyed = keyed.mapInArrow(lambda it: tv.lean(_keys(it, k, bands, slices)), KEY_SCHEMA)
    path = shared_dir(spark, "jaccard-keys")
    keyed.write.partitionBy("slice").parquet(path)
    discard(texts, left)
    _release(spark)
    return sets, spark.read.schema(KEY_SCHEMA).parquet(path), path, slices


def record_texts(docs: DataFrame, odd: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, text) of the wanted records, staged. Rows numbered by their set are hashed again.

    ``odd`` and ``wanted`` are staged. Up to ``FEW_IDS`` wanted ids are broadcast, so that no text but theirs is
    dealt out; with more of them all texts are, once.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in tv.slices(whole, "text", 1 << 20):
                row, h = distinct_shingles(part.column(0), k)
                hashed = tv.signed(fingerprints(row, h, part.num_rows)[2])
                yield pa.RecordBatch.from_arrays([pa.array(hashed), part.column(0)], ["id", "text"])

    rows = docs.select("doc_id", "text")
    named = wanted.select(F.col("id").alias("doc_id"), F.lit(False).alias("odd"))
    marks = named.join(odd, "doc_id", "left_anti").union(odd.select("doc_id", F.lit(True)))
    marks = staged(marks, "jaccard-marks")
    found = rows.join(F.broadcast(marks) if marks.count() <= FEW_IDS else marks, "doc_id")
    unnamed = rows.filter("doc_id IS NULL").union(found.filter("odd").select("doc_id", "text"))
    unnamed = unnamed.select("text").mapInArrow(lambda it: tv.lean(number(it)), "id long, text string")
    unnamed = unnamed.join(wanted.select("id"), "id")
    named = found.filter("NOT odd").select(F.col("doc_id").alias("id"), "text")
    texts = named.dropDuplicates(["id"]).union(unnamed.dropDuplicates(["id"]))
    texts = staged(texts, "jaccard-left-texts")
    discard(marks)
    return texts


def _release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffles of jobs that are done, whose plans nobody holds."""
    gc.collect()
    spark._jvm.System.gc()


def shared_keys(keys: DataFrame, path: str, slices: int) -> list[DataFrame]:
    """(id, key, slot, held) of the keys that several rows hold, slice by slice, each staged.

    A slice of all keys is deleted from ``path`` once its shared ones are known. Keys are counted by
    partial aggregation, so a key that a third of all records hold sends one row per task.
    """
    out = []
    for i in range(slices):
        part = keys.filter(F.col("slice") == i)
        held = part.select(F.explode("keys").alias("key")).groupBy("key")
        held = held.agg(F.count("*").cast("int").alias("held")).filter("held > 1")
        both = F.explode(F.arrays_zip("keys", "slots")).alias("x")
        slotted = part.select("id", both)
        slotted = slotted.select("id", F.col("x.keys").alias("key"), F.col("x.slots").alias("slot"))
        out.append(staged(slotted.join(held, "key"), "jaccard-shared"))
        delete_folder(keys.sparkSession, f"{path}/slice={i}")
        del part, held, slotted
        _release(keys.sparkSession)
    return out


def buckets(sets: DataFrame, keys: DataFrame, path: str, slices: int) -> DataFrame:
    """(bucket, id, band, earlier) of records that share a key; staged.

    There is one bucket for equal member lists. Arguments are those that `document_sets` returns.
    """
    shared = shared_keys(keys, path, slices)
    members = reduce(DataFrame.union, shared)
    # Of the shared keys of a record and band all but the ``spare`` most frequent are kept.
    by = Window.partitionBy("id", "slot").orderBy(F.desc("held"), "key")
    members = members.withColumn("nth", F.row_number().over(by))
    spare = F.col("slot").bitwiseAND(F.lit((1 << 32) - 1))
    band = F.shiftright("slot", 32).cast("int").alias("band")
    members = members.filter(F.col("nth") > spare).select("key", "id", band).distinct()
    members = staged(members, "jaccard-members")
    discard(*shared)
    _release(sets.sparkSession)
    alike = members.groupBy("key").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("id")).alias("x"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
    )
    alike = alike.filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    member = members.join(alike, "key").withColumnRenamed("key", "bucket")
    member = staged(with_earlier(member), "jaccard-member")
    discard(members)
    return member


def with_earlier(member: DataFrame) -> DataFrame:
    """(bucket, id, band, earlier): the buckets of a record before each, by ``n``, the members of a bucket."""
    before = Window.partitionBy("id").orderBy(F.desc("n"), "bucket").rowsBetween(-EARLIER, -1)
    return member.select("bucket", "id", "band", F.collect_list("bucket").over(before).alias("earlier"))


def tags(records: DataFrame, met: DataFrame) -> DataFrame:
    """(id, band, tags, size) of the records and bands of ``met``. ``size`` is the record's set size."""
    x = records.select(
        "id", F.explode(F.arrays_zip("bands", "tags")).alias("x"), F.col("n_shingles").alias("size")
    )
    x = x.select("id", F.col("x.bands").alias("band"), F.col("x.tags").alias("tags"), "size")
    return x.join(met, ["id", "band"])


def meet_first() -> Column:
    """False only where hub and member share a bucket earlier than theirs, as far as both know."""
    return ~F.arrays_overlap("hub_earlier", "earlier")


def may_link(percent: int) -> Column:
    """Whether sizes and tags of hub and member allow a link.

    The bound on different tags comes from the two sizes, so it holds in whichever band they meet.
    """
    alike = 100 * F.least("size", "hub_size") >= percent * F.greatest("size", "hub_size")
    most = F.floor((F.col("size") + F.col("hub_size")) * (100 - percent) / (100 + percent))
    differ = F.aggregate(
        F.zip_with("hub_tags", "tags", unequal_tags), F.lit(0), lambda total, count: total + count
    )
    return alike & (differ <= most)


def unequal_tags(a: Column, b: Column) -> Column:
    """How many of the tags packed in two numbers differ."""
    x = a.bitwiseXOR(b)
    step = 1
    while step < TAG_BITS:  # the lowest bit of each tag gathers the others
        x = x.bitwiseOR(F.shiftright(x, step))
        step *= 2
    lowest = sum(1 << (TAG_BITS * i) for i in range(PER_LONG))
    return F.bit_count(x.bitwiseAND(F.lit(lowest)))


def _verify(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose shingle sets reach the threshold, counted exactly."""
    for whole in batches:
        for part in tv.slices(whole, "text_a", 1 << 20):
            ra, ha = distinct_shingles(part.column(2), k)
            rb, hb = distinct_shingles(part.column(3), k)
            rows = part.num_rows
            row, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            twice = np.flatnonzero((row[1:] == row[:-1]) & (h[1:] == h[:-1]))
            both = np.bincount(row[twice], minlength=rows)
            either = np.bincount(row, minlength=rows) - both
            linked = (either > 0) & (100 * both >= percent * either)
            yield pa.RecordBatch.from_arrays(
                [part.column(i).filter(pa.array(linked)) for i in (0, 1)], ["a", "b"]
            )


def linked_pairs(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of the staged ``pairs`` that link; staged. Only their texts are dealt out of ``texts``."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = staged(texts.join(wanted, "id"), "jaccard-texts")
    full = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    full = full.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    full = full.select("a", "b", "text_a", "text_b")
    links = full.mapInArrow(lambda it: tv.lean(_verify(it, k, percent)), "a long, b long")
    links = staged(links, "jaccard-links")
    discard(texts)
    return links


def components(links: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable over the links (a, b). Large and small stars alternate.

    Every round rewrites the links as a table, so lineage stays short and lost executors cost one
    round. Each star keeps one row per node; a hub of many links is pre-aggregated per task.
    """
    edges = staged(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v")
        .distinct(),
        "components",
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        done, edges = edges, staged(small, "components")
        discard(done)
        sums = edges.agg(
            F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("u")
        ).first()
        # A star per component: one edge per node, and the same edges as in the last round.
        if sums[0] == sums[2] and sums == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
        before = sums


def hub_tags(tagged: DataFrame) -> DataFrame:
    """``tagged`` with the names that a hub has in a pair."""
    names = {"id": "hub", "tags": "hub_tags", "size": "hub_size"}
    return tagged.withColumnsRenamed(names)


def merged(
    member: DataFrame, tagged: DataFrame, texts: DataFrame, k: int, percent: int
) -> DataFrame:
    """(id, comp) of the records that link with another, from the buckets, the tags of ``tagged`` and the ``texts``.

    Memberships stay narrow: they get their tags where hubs and members meet, and no table holds both.
    The staged ``member`` is deleted as soon as the first round has its own copy of what is left.
    """
    # To begin with, each record is compared with one other, the smallest that leads a bucket of it.
    # A group of near copies so becomes one component before its buckets are searched in pairs.
    lead = member.groupBy("bucket").agg(F.min("id").alias("hub"))
    pairs = member.join(lead, "bucket").filter("hub < id").select("id", "hub", "band").distinct()
    pairs = pairs.join(tagged, ["id", "band"]).join(hub_tags(tagged), ["hub", "band"])
    pairs = pairs.filter(may_link(percent)).groupBy("id").agg(F.min("hub").alias("a"))
    pairs = staged(pairs.select("a", F.col("id").alias("b")), "jaccard-pairs")
    del lead
    _release(member.sparkSession)
    links = linked_pairs(pairs, texts, k, percent)
    discard(pairs)
    comp = components(links)
    del pairs
    active = member.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    hubs_wanted, done, compared = 1, [member], []
    while True:
        mixed = active.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
        mixed = mixed.filter("x < y").select("bucket")
        active = staged(active.join(mixed, "bucket"), "jaccard-active")
        discard(*done)
        _release(active.sparkSession)
        cell = F.pmod(F.xxhash64("id", F.lit(hubs_wanted)), F.lit(hubs_wanted))
        hubs = active.groupBy("bucket", cell.alias("cell")).agg(
            F.min(F.struct("id", "comp", "band", "earlier")).alias("hub")
        )
        hubs = hubs.select(
            "bucket",
            F.col("hub.id").alias("hub"),
            F.col("hub.comp").alias("hub_comp"),
            F.col("hub.band").alias("band"),
            F.col("hub.earlier").alias("hub_earlier"),
        )
        hubs = staged(hubs, "jaccard-hubs")
        # A pair is compared once, in the first round in which one is a hub of a common bucket.
        members = active.join(tagged, ["id", "band"]).withColumnRenamed("bucket", "hub_bucket")
        fit = (F.col("bucket") == F.col("hub_bucket")) & (F.col("comp") != F.col("hub_comp"))
        pairs = hubs.join(hub_tags(tagged), ["hub", "band"]).drop("band")
        pairs = pairs.join(members, fit & meet_first() & may_link(percent))
        pairs = pairs.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"))
        pairs = pairs.distinct()
        if compared:
            pairs = pairs.join(reduce(DataFrame.union, compared), ["a", "b"], "left_anti")
        pairs = staged(pairs, "jaccard-pairs")
        compared.append(pairs)
        _release(active.sparkSession)
        if pairs.isEmpty():
            if active.isEmpty():
                discard(active, hubs, *compared)
                return comp
        else:
            found = linked_pairs(pairs, texts, k, percent)
            if not found.isEmpty():
                links = links.union(found)
                comp = components(links)
        done = [active, hubs]
        rest = active.join(
            hubs.select("bucket", F.col("hub").alias("id")), ["bucket", "id"], "left_anti"
        )
        active = (
            rest.drop("comp")
            .join(comp, "id", "left")
            .withColumn("comp", F.coalesce("comp", "id"))
        )
        hubs_wanted *= MORE_HUBS


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; see the module."""
    sets, keys, path, slices = document_sets(docs, k, percent)
    member = buckets(sets, keys, path, slices)
    records = keys.filter("slice = -1")
    tagged = staged(tags(records, member.select("id", "band").distinct()), "jaccard-tags")
    comp = merged(member, tagged, records.select("id", "text"), k, percent)
    discard(tagged)
    delete_folder(docs.sparkSession, path)
    # Copies of a set: one node per set, then sets of one component share its smallest doc_id.
    same = ["f1", "f2", "n_shingles"]
    held = sets.filter("n_shingles > 0")
    first = held.groupBy(*same).agg(
        F.min("doc_id").alias("least"), F.min(F.when(F.col("own"), F.col("id"))).alias("id")
    )
    first = first.join(comp, "id", "left").withColumn("node", F.coalesce("comp", "id"))
    first = first.select(*same, "least", "node")
    odd = staged(
        held.filter("odd").join(first, same).select("doc_id", "node").distinct(), "jaccard-odd"
    )
    if not odd.isEmpty():
        # An id of several sets joins their components.
        least = odd.groupBy("doc_id").agg(F.min("node").alias("a"))
        joined = components(odd.join(least, "doc_id").select("a", F.col("node").alias("b")))
        joined = joined.select(F.col("id").alias("node"), F.col("comp").alias("whole"))
        first = first.join(joined, "node", "left")
        first = first.withColumn("node", F.coalesce("whole", "node")).drop("whole")
    least = first.groupBy("node").agg(F.min("least").alias("component"))
    named = first.join(least, "node").select(*same, "component")
    out = sets.join(named, same, "left").select("doc_id", "n_shingles", "odd", "component")
    # Empty rows of such an id share its component.
    of_id = odd.join(least, "node").groupBy("doc_id").agg(F.min("component").alias("of_id"))
    out = out.join(of_id, "doc_id", "left")
    component = F.coalesce("component", "of_id", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    )
