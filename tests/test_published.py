"""Published tables: whole runs or nothing, several tables at once, months pruned, safe retention."""

from datetime import datetime
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_ingest import FIRST, GAMES, payload

from opinara.functions.timewin import AT_MONTH, in_months, month_of
from opinara.operators import ingest, merge, reports
from opinara.operators.filters import filtered_reviews
from opinara.plans import published, tables
from opinara.plans.snapshots import Conflict, Snapshot, Store
from opinara.schemas import REVIEWS_ENRICHED

LANGUAGES = ["en", "pt"]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def run(store, run_id, *items, **options):
    return published.run_ingest(store, run_id, payload(store.spark, *items), GAMES, LANGUAGES, **options)


def ids(store, snapshot=None):
    return sorted(r.review_id for r in published.table(store, "reviews_raw", snapshot).collect())


def test_runs_publish_rows_and_watermark_together(spark, store):
    assert run(store, "r1", *FIRST) == {
        ("Beta", "en"): 1, ("O'Neil\\x", "en"): 2, ("O'Neil\\x", "pt"): 1,
    }
    assert ids(store) == ["a1", "a2", "b1", "p1"]
    later = [("com.a", "en", 0, 0, "a4", 5), ("com.a", "en", 0, 1, "a1", 3), ("com.a", "en", 0, 2, "a0", 0)]
    assert run(store, "r2", *later) == {("O'Neil\\x", "en"): 1}
    # A committed run is not done again and gives its counts again.
    assert run(store, "r2", *later) == {("O'Neil\\x", "en"): 1}
    assert run(store, "r3", *later) == {}
    assert ids(store) == ["a1", "a2", "a4", "b1", "p1"]
    stored = published.table(store, "reviews_raw")
    assert rows(ingest.written_counts(stored)) == [
        ("Beta", "en", 1), ("O'Neil\\x", "en", 3), ("O'Neil\\x", "pt", 1),
    ]
    states = {(r.run_id, r.state) for r in store.runs().collect()}
    assert states == {(f"r{i}", s) for i in (1, 2, 3) for s in ("started", "landed", "committed")}


def test_counted_runs_shuffle_no_text_of_new_reviews(spark, store, monkeypatch):
    plans, stage = [], Store.stage

    def watched(self, df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(self, df, *more)

    monkeypatch.setattr(Store, "stage", watched)
    run(store, "r1", ("com.a", "en", 0, 0, "a1", 1), ("com.a", "pt", 0, 0, "p1", 1))
    run(store, "r2", ("com.a", "en", 0, 0, "a2", 2))
    counts = sorted(tuple(r) for r in published.run_counts(store).collect())
    assert counts == [("r1", "O'Neil\\x", "en", 1), ("r1", "O'Neil\\x", "pt", 1), ("r2", "O'Neil\\x", "en", 1)]
    assert len(plans) == 2 and not any("Exchange hashpartitioning" in plan for plan in plans)


@pytest.mark.parametrize("moment", ["during the write", "before the commit"])
def test_a_killed_run_loses_and_doubles_nothing(spark, store, monkeypatch, moment):
    run(store, "r1", ("com.a", "en", 0, 0, "a1", 1))
    # Newest first: a9 is stored before a2 is read, so a watermark that moved early would lose a2.
    due = [("com.a", "en", 0, 0, "a9", 9), ("com.a", "en", 1, 0, "a2", 2), ("com.a", "pt", 0, 0, "p3", 3)]
    with monkeypatch.context() as m:
        if moment == "before the commit":
            m.setattr(Store, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        else:
            broken = F.when(F.col("review_id") == "a2", F.raise_error(F.lit("killed")).cast("string"))
            whole = ingest.select_new
            m.setattr(
                ingest, "select_new",
                lambda *a, **k: whole(*a, **k).withColumn("content", broken.otherwise(F.col("content"))),
            )
        with pytest.raises(Exception, match="killed"):
            run(store, "r2", *due)
    assert ids(store) == ["a1"] and store.snapshot().run("r2") is None
    states = {r.state for r in store.runs().filter("run_id = 'r2'").collect()}
    assert states == ({"started", "landed"} if moment == "before the commit" else {"started"})
    assert run(store, "r2", *due) == {("O'Neil\\x", "en"): 2, ("O'Neil\\x", "pt"): 1}
    assert ids(store) == ["a1", "a2", "a9", "p3"]
    # What the killed attempt left goes, the published rows stay.
    assert len(store.vacuum(grace_s=0)) == 1
    assert ids(store) == ["a1", "a2", "a9", "p3"]


def test_of_two_writers_one_starts_again(spark, store, monkeypatch):
    run(store, "r1", ("com.a", "en", 0, 0, "a1", 1))
    inner = Store.stage

    def meanwhile(self, *args, **options):
        out = inner(self, *args, **options)
        monkeypatch.setattr(Store, "stage", inner)
        run(store, "other", ("com.a", "en", 0, 0, "a5", 5))
        return out

    monkeypatch.setattr(Store, "stage", meanwhile)
    with pytest.raises(Conflict):
        run(store, "r2", ("com.a", "en", 0, 0, "a5", 5), ("com.a", "en", 0, 1, "a4", 4))
    assert ids(store) == ["a1", "a5"]
    assert run(store, "r2", ("com.a", "en", 0, 0, "a6", 6), ("com.a", "en", 0, 1, "a5", 5)) == {
        ("O'Neil\\x", "en"): 1
    }
    assert ids(store) == ["a1", "a5", "a6"]


def test_empty_run_moves_nothing(spark, store):
    assert run(store, "r1") == {}
    assert store.snapshot().run("r1")["rows"] == 0 and ids(store) == []


def test_counts_of_many_targets_come_from_the_folder(spark, store, monkeypatch):
    monkeypatch.setattr(published, "TARGET_METRICS", 1)
    assert run(store, "r1", *FIRST) == {
        ("Beta", "en"): 1, ("O'Neil\\x", "en"): 2, ("O'Neil\\x", "pt"): 1,
    }


# --- games: two tables in one commit --------------------------------------------------------


def asked(spark, *packages):
    return spark.createDataFrame([(p,) for p in packages], "package_name string")


def metadata(spark):
    data = [("com.n", "icon-n", "New"), ("com.m", "icon-m", "More")]
    return spark.createDataFrame(data, "package_name string, icon string, title string")


def test_add_games_changes_both_tables_or_none(spark, store, monkeypatch):
    when = datetime(2024, 1, 2)
    rejected = published.add_games(store, asked(spark, "com.n", "com.zz"), metadata(spark), when)
    assert rows(rejected) == [("com.zz",)]
    both = lambda: (
        rows(published.table(store, "games_config").select("game", "package_name", "source")),
        rows(published.table(store, "games_meta").select("game", "icon")),
    )
    assert both() == ([("New", "com.n", "ui")], [("New", "icon-n")])
    inner = Store.stage

    def fails_on_the_second(self, df, table, *args, **options):
        if table == "games_meta":
            raise RuntimeError("killed")
        return inner(self, df, table, *args, **options)

    with monkeypatch.context() as m:
        m.setattr(Store, "stage", fails_on_the_second)
        with pytest.raises(RuntimeError):
            published.add_games(store, asked(spark, "com.m"), metadata(spark), when)
    assert both() == ([("New", "com.n", "ui")], [("New", "icon-n")])
    published.add_games(store, asked(spark, "com.m"), metadata(spark), when)
    assert both() == (
        [("More", "com.m", "ui"), ("New", "com.n", "ui")], [("More", "icon-m"), ("New", "icon-n")],
    )
    games = spark.createDataFrame([("More",), ("None",)], "game string")
    assert rows(published.remove_games(store, games)) == [("More", True), ("None", False)]
    assert both()[0] == [("New", "com.n", "ui")] and len(both()[1]) == 2


# --- versions and retention -----------------------------------------------------------------


def test_readers_keep_their_version_while_old_ones_go(spark, store):
    for i in range(4):
        run(store, f"r{i}", ("com.a", "en", 0, 0, f"a{i}", i + 1))
    old = store.snapshot(2)
    reader = published.table(store, "reviews_raw", old)
    store.compact("reviews_raw", published.REVIEWS_RAW, [AT_MONTH])
    assert len(store.snapshot().tables["reviews_raw"]) == 1
    assert store.vacuum(keep=5, grace_s=0) == []
    assert sorted(r.review_id for r in reader.collect()) == ["a0", "a1"]
    # Young folders stay, whether or not they are listed.
    assert store.vacuum(keep=1, grace_s=3600) == [] and store.versions() == [5]
    assert len(store.vacuum(keep=1, grace_s=0)) == 4
    assert ids(store) == ["a0", "a1", "a2", "a3"]
    assert store.snapshot().run("r0") and run(store, "r0", ("com.a", "en", 0, 0, "zz", 9)) == {
        ("O'Neil\\x", "en"): 1
    }


def test_a_version_is_created_once(spark, store):
    first = store.commit(Snapshot(), replace={"t": ["run=a"]})
    with pytest.raises(Conflict):
        store.commit(Snapshot(), replace={"t": ["run=b"]})
    assert store.snapshot() == first and store.snapshot(1).tables == {"t": ["run=a"]}


# --- months ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def by_month(spark, tmp_path_factory):
    """Enriched reviews of four months and one without a time, partitioned; March is unreadable."""
    times = ["2023-12-31 23:30:00", "2024-01-01 00:00:00", "2024-01-31 23:59:59", "2024-02-15 12:00:00",
             "2024-03-03 00:00:00", None]
    data = [(f"r{i}", "g", t) for i, t in enumerate(times)]
    raw = spark.createDataFrame(data, "review_id string, game string, at string").withColumn(
        "at", F.col("at").cast("timestamp")
    )
    full = merge.evolve(raw, REVIEWS_ENRICHED).withColumn("content", F.lit("text"))
    path = tmp_path_factory.mktemp("months")
    full.withColumn(AT_MONTH, month_of(F.col("at"))).write.partitionBy(AT_MONTH).parquet(str(path / "t"))
    for file in Path(path / "t" / "at_month=2024-03-01").glob("*.parquet"):
        file.write_bytes(b"no parquet")
    for crc in Path(path / "t" / "at_month=2024-03-01").glob(".*.crc"):
        crc.unlink()
    schema = T.StructType([*full.schema.fields, T.StructField(AT_MONTH, T.DateType())])
    return full, spark.read.schema(schema).parquet(str(path / "t"))


def found(df):
    return sorted(r.review_id for r in df.select("review_id").collect())


@pytest.mark.parametrize(
    "start,end",
    [("2023-12-31", "2024-01-01"), ("2024-01-31", "2024-02-15"), ("", "2024-02-20"), ("2024-01-15", "2024-02-28"),
     ("no date", "2024-01-31"), ("2024-02-16", "2024-02-20")],
)
def test_date_filter_opens_only_its_months(by_month, start, end):
    """March cannot be read, so every one of these fails unless it is pruned."""
    plain, partitioned = by_month
    want = found(filtered_reviews(plain, start=start, end=end))
    assert found(filtered_reviews(partitioned, start=start, end=end)) == want


def test_an_open_filter_reads_every_month(by_month):
    with pytest.raises(Exception, match="(?i)parquet"):
        found(filtered_reviews(by_month[1], start="2024-02-01"))


def test_weekly_report_opens_only_its_months(spark, by_month):
    plain, partitioned = by_month
    as_of = datetime(2024, 3, 2)
    window = reports.report_window(partitioned.filter("at < '2024-03-01'"), 7, as_of)
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(at_month" in plan and "at_month#" in plan and ">= 2024-02-01" in plan
    early = reports.report_window(plain, 20, datetime(2024, 1, 10))
    late = in_months(reports.report_window(partitioned, 20, datetime(2024, 1, 10)), last=F.lit(datetime(2024, 2, 20)))
    assert found(late) == found(early.filter("at < '2024-03-01'"))


def test_catalog_tables_are_partitioned_by_month(spark, schema):
    tables.create_tables(spark, schema)
    raw = tables.name(schema, "reviews_raw")
    data = [("a", datetime(2024, 1, 31)), ("b", datetime(2024, 2, 1)), ("c", None)]
    new = merge.evolve(
        spark.createDataFrame(data, "review_id string, at timestamp"), tables.TABLES["reviews_raw"]
    ).drop(AT_MONTH)
    assert tables.append(new, raw) == 3
    assert rows(spark.table(raw).select("review_id", F.col(AT_MONTH).cast("string"))) == [
        ("a", "2024-01-01"), ("b", "2024-02-01"), ("c", None),
    ]
    plan = filtered_reviews(
        merge.evolve(spark.table(raw), REVIEWS_ENRICHED), start="2024-02-01", end="2024-02-02"
    )._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(at_month" in plan
    tables.create_tables(spark, schema + "_plain", by_month=False)
    assert AT_MONTH not in spark.table(tables.name(schema + "_plain", "reviews_raw")).columns


def test_run_counts_come_from_the_manifest(spark, store):
    assert published.run_counts(store).collect() == []
    run(store, "r1", *FIRST)
    run(store, "r2", ("com.b", "en", 0, 0, "b7", 7))
    assert rows(published.run_counts(store)) == [
        ("r1", "Beta", "en", 1), ("r1", "O'Neil\\x", "en", 2), ("r1", "O'Neil\\x", "pt", 1), ("r2", "Beta", "en", 1),
    ]


def test_published_rows_are_packed_with_zstd(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    folder, seen = store.stage(spark.createDataFrame([(1, "a text")], "id long, content string"), "reviews")
    files = [p.name for p in (tmp_path / "reviews" / folder).glob("*.parquet")]
    assert seen == {"_rows": 1} and files and all(".zstd." in name for name in files)
