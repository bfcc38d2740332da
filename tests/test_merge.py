from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from opinara import schemas
from opinara.operators import catalog, merge
from opinara.plans import jobs, tables

NOW = datetime(2024, 2, 1)
OLD = datetime(2024, 1, 1)


def kv(spark, *items):
    return spark.createDataFrame(list(items), "k string, v int")


def test_upsert_updates_inserts_and_keeps(spark):
    out = merge.upsert(kv(spark, ("a", 1), ("b", 2)), kv(spark, ("b", 20), ("c", 30)), ["k"])
    assert rows(out) == [("a", 1), ("b", 20), ("c", 30)]


def test_upsert_twice_is_once(spark):
    source = kv(spark, ("b", 20), ("c", 30))
    once = merge.upsert(kv(spark, ("a", 1), ("b", 2)), source, ["k"])
    assert rows(merge.upsert(once, source, ["k"])) == rows(once)


def test_duplicate_source_key_fails(spark):
    with pytest.raises(Exception, match="duplicate merge key.*b"):
        merge.upsert(kv(spark, ("a", 1)), kv(spark, ("b", 1), ("b", 2)), ["k"]).collect()


def test_a_hot_duplicate_key_is_cut_before_the_shuffle(spark):
    plan = merge.require_unique(kv(spark, ("a", 1)), ["k"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan.split("Physical Plan")[1]


def test_null_keys_never_match(spark):
    out = merge.upsert(kv(spark, (None, 1)), kv(spark, (None, 2), (None, 3)), ["k"])
    assert rows(out) == [(None, 1), (None, 2), (None, 3)]


def test_partial_upsert(spark):
    config = spark.createDataFrame(
        [("a", "old", "bundle", OLD), ("z", "keep", "ui", OLD)], schemas.GAMES_CONFIG
    )
    found = spark.createDataFrame(
        [("a", "new", "i", "a"), ("b", "pb", "i", "b")],
        "game string, package_name string, icon string, title string",
    )
    assert rows(jobs.add_to_config(config, found, F.lit(NOW))) == [
        ("a", "new", "bundle", OLD), ("b", "pb", "ui", NOW), ("z", "keep", "ui", OLD),
    ]
    meta = spark.createDataFrame([("a", "old", "oi", "ot", OLD)], schemas.GAMES_META)
    assert rows(jobs.add_to_meta(meta, found, F.lit(NOW))) == [
        ("a", "new", "i", "a", OLD), ("b", "pb", "i", "b", NOW),
    ]


def test_delete_and_report(spark):
    target, keys = kv(spark, ("a", 1), ("b", 2)), spark.createDataFrame([("a",), ("x",)], "k string")
    assert rows(merge.delete_keys(target, keys)) == [("b", 2)]
    assert rows(merge.deletion_report(target, keys)) == [("a", True), ("x", False)]


def test_evolve_adds_typed_nulls(spark):
    out = merge.evolve(spark.createDataFrame([("g",)], "game string"), schemas.WEEKLY_REPORTS)
    assert [f.dataType for f in out.schema] == [f.dataType for f in schemas.WEEKLY_REPORTS]
    assert out.first()["window_start"] is None and out.first()["game"] == "g"


def test_evolve_keeps_columns_the_schema_lacks(spark):
    out = merge.evolve(spark.createDataFrame([("g", 1)], "game string, extra int"), schemas.GAMES_META)
    assert out.columns == [*schemas.GAMES_META.names, "extra"] and out.first()["extra"] == 1


# --- tables ---------------------------------------------------------------------------------


def test_create_tables_twice_and_evolve(spark, schema):
    tables.create_tables(spark, schema)
    tables.create_tables(spark, schema)
    for table, struct in tables.TABLES.items():
        have = spark.table(tables.name(schema, table)).schema
        assert {(f.name, f.dataType) for f in have} == {(f.name, f.dataType) for f in struct}
    old = tables.name(schema, "old_reports")
    spark.sql(f"CREATE TABLE {old} (report_week date, game string) USING parquet")
    spark.sql(f"INSERT INTO {old} VALUES (DATE '2024-01-01', 'g')")
    added = tables.add_missing_columns(spark, old, schemas.WEEKLY_REPORTS)
    assert added == [c for c in schemas.WEEKLY_REPORTS.names if c not in ("report_week", "game")]
    assert spark.table(old).first()["window_start"] is None
    assert tables.add_missing_columns(spark, old, schemas.WEEKLY_REPORTS) == []


def test_optional_table(spark, schema):
    tables.create_tables(spark, schema)
    gone = tables.table_or_empty(spark, tables.name(schema, "nothing"), schemas.GAMES_CONFIG)
    assert gone.count() == 0 and gone.columns == schemas.GAMES_CONFIG.names
    games = jobs.monitored_games(spark, "no_such_schema_here", '{"A": "com.a"}')
    assert rows(games) == [("A", "com.a")]


def test_replace_may_read_the_table_it_replaces(spark, schema):
    tables.create_tables(spark, schema)
    table = tables.name(schema, "games_config")
    for _ in range(2):
        more = spark.createDataFrame([("g", "p", "ui", NOW)], schemas.GAMES_CONFIG)
        tables.replace(merge.upsert(spark.table(table), more, ["game"]), table)
        assert rows(spark.table(table)) == [("g", "p", "ui", NOW)]


def test_replace_refuses_a_table_replaced_meanwhile(spark, schema, monkeypatch):
    tables.create_tables(spark, schema)
    table = tables.name(schema, "games_config")
    mine = spark.createDataFrame([("g", "mine", "ui", NOW)], schemas.GAMES_CONFIG)
    theirs = spark.createDataFrame([("g", "theirs", "ui", NOW)], schemas.GAMES_CONFIG)
    evolve = tables.evolve

    def slow(df, struct):
        monkeypatch.setattr(tables, "evolve", evolve)
        tables.replace(theirs, table)
        return evolve(df, struct)

    monkeypatch.setattr(tables, "evolve", slow)
    with pytest.raises(RuntimeError, match="another writer"):
        tables.replace(mine, table)
    assert rows(spark.table(table)) == [("g", "theirs", "ui", NOW)]


def test_replace_partitions_touches_only_its_weeks(spark, schema):
    tables.create_tables(spark, schema)
    table = tables.name(schema, "weekly_reports")

    def report(week, game, n):
        return (week, game, "green", "r", week, week, n, 4.5, NOW)

    w1, w2 = date(2024, 1, 1), date(2024, 1, 8)
    first = spark.createDataFrame(
        [report(w1, "a", 1), report(w2, "a", 2), report(w2, "b", 3)], schemas.WEEKLY_REPORTS
    )
    tables.replace_partitions(first, table)
    again = spark.createDataFrame([report(w2, "a", 20)], schemas.WEEKLY_REPORTS)
    week = spark.table(table).filter(F.col("report_week") == F.lit(w2))
    tables.replace_partitions(merge.upsert(week, again, ["report_week", "game"]), table)
    got = spark.table(table).select("report_week", "game", "n_reviews")
    assert rows(got) == [(w1, "a", 1), (w2, "a", 20), (w2, "b", 3)]


# --- games ----------------------------------------------------------------------------------

STORE = "package_name string, icon string, title string"


def test_add_and_remove_games(spark, schema):
    tables.create_tables(spark, schema)
    store = spark.createDataFrame([("com.a", "ia", "O'Neil"), ("com.b", "ib", "B")], STORE)
    asked = spark.createDataFrame([("com.a",), ("com.zz",)], "package_name string")
    rejected = jobs.add_games(spark, schema, asked, store, NOW)
    assert rows(rejected) == [("com.zz",)]
    config = tables.name(schema, "games_config")
    assert rows(spark.table(config)) == [("O'Neil", "com.a", "ui", NOW)]
    # The configured package wins over the parameter of the same name.
    games = jobs.monitored_games(spark, schema, {"O'Neil": "com.other", "C": "com.c"})
    assert rows(games) == [("C", "com.c"), ("O'Neil", "com.a")]
    listed = catalog.configured_games(
        spark.table(config), spark.table(tables.name(schema, "games_meta"))
    )
    assert rows(listed) == [("O'Neil", "com.a", "ia")]
    assert jobs.remove_game(spark, schema, "nobody") is False
    assert jobs.remove_game(spark, schema, "O'Neil") is True
    assert spark.table(config).count() == 0
    assert spark.table(tables.name(schema, "games_meta")).count() == 1


def test_blank_packages_are_no_request(spark):
    store = spark.createDataFrame([("com.a", "ia", "A")], STORE)
    asked = spark.createDataFrame(
        [(" com.a ",), ("com.a",), ("  ",), (None,), ("com.zz",)], "package_name string"
    )
    assert rows(catalog.validated_packages(asked, store)) == [
        ("com.a", "ia", "A", True), ("com.zz", None, None, False),
    ]
    assert rows(catalog.rejected_packages(asked, store)) == [("com.zz",)]


def test_refresh_games_meta(spark, schema):
    tables.create_tables(spark, schema)
    store = spark.createDataFrame([("com.a", "i1", "A!")], STORE)
    for icon in ("i1", "i2"):
        jobs.refresh_games_meta(
            spark, schema, store.withColumn("icon", F.lit(icon)), {"A": "com.a"}, NOW
        )
    assert rows(spark.table(tables.name(schema, "games_meta"))) == [
        ("A", "com.a", "i2", "A!", NOW)
    ]


def test_unknown_game_raises(spark):
    games = spark.createDataFrame([("g",)], "game string")
    catalog.require_known_game(games, "g")
    with pytest.raises(ValueError):
        catalog.require_known_game(games, "h")


def test_list_games_blank_where_unknown(spark):
    reviews = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "game string")
    meta = spark.createDataFrame([("a", "p", "i", "t", OLD)], schemas.GAMES_META)
    got = [tuple(r) for r in catalog.list_games(reviews, meta).collect()]
    assert got == [("a", "i", "p"), ("b", "", "")]
