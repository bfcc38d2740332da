from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from opinara.operators import ingest
from opinara.plans import jobs, tables
from opinara.schemas import PAGE_PAYLOAD
from opinara.sources.landed import decode_metadata, read_pages
from opinara.sources.paged_api import fetch_pages

T0 = datetime(2024, 1, 10)
LISTED = "game string, language string, review_id string, at timestamp, page int, pos bigint"
MARKS = "game string, last_at timestamp"


def hours(n):
    return T0 + timedelta(hours=n)


def listed(spark, *items):
    """Rows of game g / language en in read order, from (id, hours) pairs, two per page."""
    data = [
        ("g", "en", rid, hours(h), i // 2, i % 2) for i, (rid, h) in enumerate(items)
    ]
    return spark.createDataFrame(data, LISTED)


def ids(df):
    return sorted(r["review_id"] for r in df.select("review_id").collect())


def test_source_cut_stops_at_first_older_row(spark):
    data = listed(spark, ("a", 1), ("b", 0), ("c", -1), ("d", 2))
    marks = spark.createDataFrame([("g", T0)], MARKS)
    assert ids(ingest.source_cut(data, marks)) == ["a", "b"]
    assert data.filter(F.col("at") >= F.lit(T0)).count() == 3  # a plain filter keeps d too


def test_source_cut_leaves_new_games_alone(spark):
    data = listed(spark, ("a", 1), ("c", -1))
    marks = spark.createDataFrame([("other", T0)], MARKS)
    assert ids(ingest.source_cut(data, marks)) == ["a", "c"]


def test_watermark_skips_null_and_supports_language(spark):
    stored = spark.createDataFrame(
        [("g", "en", T0), ("g", "pt", hours(5)), ("n", "en", None)],
        "game string, language string, at timestamp",
    )
    assert rows(ingest.watermarks(stored)) == [("g", hours(5))]
    by_language = ingest.watermarks(stored, ("game", "language"))
    assert rows(by_language) == [("g", "en", T0), ("g", "pt", hours(5))]


@pytest.mark.parametrize("cap,pages", [(1, 1), (200, 1), (201, 2), (600, 3), (0, 1)])
def test_max_pages(cap, pages):
    assert ingest.max_pages(cap, 200) == pages


def test_page_cap_modes(spark):
    data = listed(spark, ("a", 4), ("b", 3), ("c", 2), ("d", 1))
    none = spark.createDataFrame([], MARKS)
    own = spark.createDataFrame([("g", T0)], MARKS)
    other = spark.createDataFrame([("other", T0)], MARKS)
    assert ids(ingest.page_cap(data, none, 1)) == ["a", "b", "c", "d"]
    assert ids(ingest.page_cap(data, none, 1, first_load="game")) == ["a", "b"]
    assert ids(ingest.page_cap(data, own, 1, first_load="game")) == ["a", "b", "c", "d"]
    # A game added later: capped on its own, uncapped when first load means an empty table.
    assert ids(ingest.page_cap(data, other, 1, first_load="game")) == ["a", "b"]
    assert ids(ingest.page_cap(data, other, 1, first_load="table")) == ["a", "b", "c", "d"]
    assert ids(ingest.page_cap(data, none, 1, first_load="table")) == ["a", "b"]
    assert ids(ingest.page_cap(data, own, 1, backfill=True)) == ["a", "b"]
    with pytest.raises(ValueError):
        ingest.page_cap(data, none, 1, first_load="x")


def test_dedup_keeps_the_first_read(spark):
    data = listed(spark, ("a", 4), ("b", 3), ("a", 2), ("a", 1))
    out = ingest.dedup_reviews(data)
    assert sorted((r["review_id"], r["page"], r["pos"]) for r in out.collect()) == [
        ("a", 0, 0), ("b", 0, 1),
    ]


def test_copies_collapse_before_the_shuffle(spark):
    """A third of all rows being copies of one review must not meet in one task."""
    plan = ingest.dedup_reviews(listed(spark, ("a", 1)))._jdf.queryExecution().toString()
    physical = plan.split("Physical Plan")[1]
    partial = physical.index("Partial")
    assert "WindowGroupLimit" in physical and physical.index("Exchange hashpartitioning") < partial


def test_new_reviews(spark):
    stored = spark.createDataFrame([("a",), ("a",)], "review_id string")
    assert ids(ingest.new_reviews(listed(spark, ("a", 1), ("b", 2)), stored)) == ["b"]


def test_reviews_listed_once_and_not_stored_are_not_shuffled(spark):
    games = spark.createDataFrame([("g", "com.a")], "game string, package_name string")
    targets = ingest.ingest_targets(games, ["en"])
    stored = spark.createDataFrame([("s1", "other", T0)], "review_id string, game string, at timestamp")

    def plan(*items):
        new = ingest.select_new(payload(spark, *items), stored, targets, 3)
        return new, new._jdf.queryExecution().executedPlan().toString()

    fresh = [("com.a", "en", 0, i, f"r{i}", 1) for i in range(3)]
    new, whole = plan(*fresh)
    assert ids(new) == ["r0", "r1", "r2"] and "Exchange hashpartitioning" not in whole
    new, whole = plan(*fresh, ("com.a", "en", 1, 0, "r0", 1), ("com.a", "en", 1, 1, "s1", 1))
    once, others = whole.split("Union")[1].split("Window", 1)
    assert ids(new) == ["r0", "r1", "r2"] and "LeftSemi" in others
    assert "LeftAnti" in once and "Exchange hashpartitioning" not in once


@pytest.mark.parametrize("few", [0, 2, 100])
def test_first_new_equals_dedup_then_anti_join(spark, monkeypatch, few):
    """Ids that are null, repeated, stored or all of it, whichever way the rows take."""
    import random

    monkeypatch.setattr(ingest, "FEW_IDS", few)
    rng = random.Random(few)
    pick = lambda: rng.choice([None, "c", *[f"r{i}" for i in range(12)]])
    data = [
        (pick(), "g", "en", "run", i // 10, i % 10, T0) for i in range(15)
    ] + [(f"n{i}", "g", "en", "run", 9, i, T0) for i in range(3)]
    columns = "review_id string, game string, language string, run string, page int, pos long, at timestamp"
    data = spark.createDataFrame(data, columns)
    stored = spark.createDataFrame([("c",), ("c",), (None,), ("r1",)], "review_id string")
    want = ingest.new_reviews(ingest.dedup_reviews(data), stored)
    assert rows(ingest.first_new(data, stored)) == rows(want)


def test_targets_are_every_game_in_every_language(spark):
    games = spark.createDataFrame([("g", "p"), ("h", "q")], "game string, package_name string")
    out = ingest.ingest_targets(games, ["en", "pt"])
    assert rows(out) == [
        ("g", "p", "en"), ("g", "p", "pt"), ("h", "q", "en"), ("h", "q", "pt"),
    ]
    assert "Join" not in out._jdf.queryExecution().toString()


# --- the job --------------------------------------------------------------------------------

GAMES = {"O'Neil\\x": "com.a", "Beta": "com.b"}


def payload(spark, *items):
    data = [
        (pkg, lang, "run", page, pos, rid, "u", f"text {rid}", 5, 0, None, hours(h), None, None, None)
        for pkg, lang, page, pos, rid, h in items
    ]
    return spark.createDataFrame(data, PAGE_PAYLOAD)


FIRST = [
    ("com.a", "en", 0, 0, "a1", 3), ("com.a", "en", 0, 1, "a2", 2), ("com.a", "en", 1, 0, "a2", 2),
    ("com.a", "pt", 0, 0, "p1", 1), ("com.b", "en", 0, 0, "b1", 1), ("com.x", "en", 0, 0, "x1", 1),
]


def test_ingest_is_incremental_and_idempotent(spark, schema):
    tables.create_tables(spark, schema)
    pages = payload(spark, *FIRST)
    assert jobs.run_ingest(spark, schema, pages, GAMES, ["en", "pt"]) == 4
    assert jobs.run_ingest(spark, schema, pages, GAMES, ["en", "pt"]) == 0
    more = payload(spark, ("com.a", "en", 0, 0, "a4", 5), ("com.a", "en", 0, 1, "a1", 3),
                   ("com.a", "en", 0, 2, "a0", 0))
    assert jobs.run_ingest(spark, schema, more, GAMES, ["en", "pt"]) == 1  # a0 is past the cut
    # Backfill ignores the watermark and still adds nothing twice.
    assert jobs.run_ingest(spark, schema, more, GAMES, ["en", "pt"], backfill=True) == 1
    raw = spark.table(tables.name(schema, "reviews_raw"))
    assert raw.count() == 6 and raw.select("review_id").distinct().count() == 6
    assert {r["game"] for r in raw.select("game").distinct().collect()} == set(GAMES)
    assert rows(ingest.written_counts(raw)) == [
        ("Beta", "en", 1), ("O'Neil\\x", "en", 4), ("O'Neil\\x", "pt", 1),
    ]


def test_bucketed_store_is_not_shuffled_for_the_anti_join(spark, schema):
    tables.create_tables(spark, schema, id_buckets=4)
    assert jobs.run_ingest(spark, schema, payload(spark, *FIRST), GAMES, ["en", "pt"]) == 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = spark.table(tables.name(schema, "reviews_raw"))
        plan = ingest.new_reviews(
            listed(spark, ("a1", 1), ("zz", 2)), stored
        )._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_one_shuffle_serves_dedup_and_bucketed_anti_join(spark, schema):
    tables.create_tables(spark, schema, id_buckets=4)  # as many as shuffle partitions
    games = spark.createDataFrame([("g", "com.a")], "game string, package_name string")
    new = ingest.select_new(
        payload(spark, *FIRST), spark.table(tables.name(schema, "reviews_raw")),
        ingest.ingest_targets(games, ["en"]), 3,
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")  # the store is beyond it
    try:
        plan = new._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(review_id" in line]
    assert len(shuffles) == 1


def test_missing_payload_column_raises(spark):
    pages = payload(spark, *FIRST).drop("userName")
    targets = ingest.ingest_targets(
        spark.createDataFrame([("g", "com.a")], "game string, package_name string"), ["en"]
    )
    with pytest.raises(KeyError, match="userName"):
        ingest.decode_pages(pages, targets)


def test_landed_json_round_trip(spark, tmp_path):
    path = str(tmp_path / "pages")
    payload(spark, *FIRST).write.option("ignoreNullFields", False).json(path)
    assert rows(read_pages(spark, path)) == rows(payload(spark, *FIRST))


def test_metadata_must_cover_the_games(spark):
    games = spark.createDataFrame([("g", "com.a"), ("h", "com.z")],
                                  "game string, package_name string")
    store = spark.createDataFrame([("com.a", "i", "t")], "package_name string, icon string, title string")
    ok = decode_metadata(games.filter("game = 'g'"), store)
    assert rows(ok) == [("g", "com.a", "i", "t")]
    with pytest.raises(Exception, match="no store metadata for com.z"):
        decode_metadata(games, store).collect()
    with pytest.raises(KeyError):
        decode_metadata(games, store.drop("icon"))


# --- the paged API --------------------------------------------------------------------------


def _fetch(package, language, country, count, token):
    """Ten reviews per target, newest first, ``count`` per page."""
    start = token or 0
    page = [
        {
            "reviewId": f"{package}-{language}-{i}", "userName": "u", "content": "c", "score": 4,
            "thumbsUpCount": 0, "reviewCreatedVersion": None,
            "at": datetime(2024, 1, 10) - timedelta(hours=i), "replyContent": None,
            "repliedAt": None, "appVersion": country,
        }
        for i in range(start, min(start + count, 10))
    ]
    return page, (start + count if start + count < 10 else None)


def _api_targets(spark, *items):
    return spark.createDataFrame(
        list(items), "package_name string, language string, last_at timestamp, max_pages int"
    )


def test_fetch_pages_stops_at_token_mark_or_cap(spark):
    targets = _api_targets(
        spark, ("all", "en", None, None), ("mark", "en", T0 - timedelta(hours=4), None),
        ("cap", "en", None, 2),
    )
    got = fetch_pages(targets, _fetch, "br", page_count=3, pause_s=0, parallelism=2)
    counts = {r[0]: (r[1], r[2]) for r in got.groupBy("package_name").agg(
        F.count("*"), F.max("page")).collect()}
    # The mark lies on the second page; that page is read to its end and cut by source_cut.
    assert counts == {"all": (10, 3), "mark": (6, 1), "cap": (6, 1)}


def test_fetch_pages_fails_on_a_missing_field(spark):
    def broken(*args):
        page, token = _fetch(*args)
        return [{k: v for k, v in r.items() if k != "score"} for r in page], token

    with pytest.raises(Exception, match="score"):
        fetch_pages(_api_targets(spark, ("all", "en", None, None)), broken, "br", pause_s=0)


def test_fetched_pages_feed_the_ingest_job(spark, schema):
    tables.create_tables(spark, schema)
    targets = _api_targets(spark, ("com.b", "en", None, 2))
    pages = fetch_pages(targets, _fetch, "br", page_count=4, pause_s=0)
    assert jobs.run_ingest(spark, schema, pages, GAMES, ["en"]) == 8


def test_pages_are_fetched_once_and_under_one_run(spark, schema, tmp_path):
    """A review posted between two readings would shift positions; there is one reading only."""
    calls = str(tmp_path)

    def counted(*args):
        import uuid
        from pathlib import Path

        Path(calls, uuid.uuid4().hex).touch()
        return _fetch(*args)

    tables.create_tables(spark, schema)
    targets = _api_targets(spark, ("com.b", "en", T0 - timedelta(hours=20), None))
    pages = fetch_pages(targets, counted, "br", page_count=4, pause_s=0)
    assert pages.select("run").distinct().count() == 1
    assert jobs.run_ingest(spark, schema, pages, GAMES, ["en"]) == 10
    assert len(list(tmp_path.iterdir())) == 3


def test_runs_kept_in_one_folder_lose_nothing(spark, schema, tmp_path):
    """Three daily runs land in one folder; each lists a day of news and some of the day before."""
    import json

    tables.create_tables(spark, schema)
    landing, written = tmp_path / "pages", []
    landing.mkdir()
    for day in range(3):
        lines = []
        for pos, i in enumerate(range(day * 10 + 9, day * 10 - 3, -1)):
            row = _fetch("com.b", "en", "br", 1, 0)[0][0]
            at = (T0 + timedelta(hours=i)).isoformat()
            row |= {"reviewId": f"r{i}", "at": at, "package_name": "com.b", "language": "en"}
            lines.append(json.dumps(row | {"run": f"run-{day}", "page": 0, "pos": pos}))
        (landing / f"day{day}.json").write_text("\n".join(lines))
        pages = read_pages(spark, str(landing))
        written.append(jobs.run_ingest(spark, schema, pages, GAMES, '["en"]'))
    assert written == [12, 10, 10]


def test_json_page_without_a_required_key_raises(spark, tmp_path):
    import json

    row = _fetch("com.b", "en", "br", 1, 0)[0][0]
    row |= {"at": "2024-01-10T00:00:00", "package_name": "com.b", "language": "en", "page": 0, "pos": 0}
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.mkdir()
    bad.mkdir()
    (good / "x.json").write_text(json.dumps(row))
    (bad / "x.json").write_text(json.dumps({k: v for k, v in row.items() if k != "score"}))
    got = read_pages(spark, str(good)).first()
    assert got["reviewCreatedVersion"] is None and got["run"].endswith("/good")
    with pytest.raises(Exception, match="page payload lacks score"):
        read_pages(spark, str(bad)).collect()


def test_malformed_parameters_raise(spark):
    from opinara.operators import catalog

    for bad in ("not json", "[1]"):
        with pytest.raises(ValueError):
            catalog.games_param(spark, bad)
    with pytest.raises(ValueError):
        catalog.languages_param('{"a": 1}')
    assert catalog.languages_param('["pt", "en"]') == ["pt", "en"]


# --- brute force ----------------------------------------------------------------------------


def _read_by_loop(targets, stored, cap, backfill):
    """The reviews a paging loop over each target would add, one row at a time."""
    marks = {}
    for _, game, at in stored:
        marks[game] = max(marks.get(game, at), at)
    known = {rid for rid, _, _ in stored}
    seen, order = {}, []
    for (game, _), pages in targets.items():
        mark = None if backfill else marks.get(game)
        for number, page in enumerate(pages):
            if (backfill or game not in marks) and number >= cap:
                break
            stop = False
            for pos, (rid, at) in enumerate(page):
                if mark is not None and at < mark:
                    stop = True
                    break
                order.append((number, pos, rid))
            if stop:
                break
    for _, _, rid in sorted(order):
        seen.setdefault(rid, True)
    return sorted(rid for rid in seen if rid not in known)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("backfill", [False, True])
def test_run_equals_a_paging_loop_under_skew(spark, seed, backfill):
    """Disordered pages, shared ids, one target with most rows and one id with a third of them."""
    import random

    rng = random.Random(seed)
    sizes = {("hot", "en"): 12, ("hot", "pt"): 2, ("new", "en"): 4, ("cold", "en"): 1}
    targets, data = {}, []
    for (game, lang), n_pages in sizes.items():
        pages = []
        for number in range(n_pages):
            page = []
            for pos in range(10):
                rid = "copy" if rng.random() < 1 / 3 else f"{game}{rng.randrange(60)}"
                at = hours(200 - number * 10 - pos + rng.choice([0, 0, 0, -25, 15]))
                page.append((rid, at))
                data.append((f"com.{game}", lang, "", number, pos, rid, "u", "c", 5, 0, None, at,
                             None, None, None))
            pages.append(page)
        targets[game, lang] = pages
    stored = [(f"hot{i}", "hot", hours(100 + i)) for i in range(20)] + [("x", "cold", hours(150))]
    config = spark.createDataFrame([(g, f"com.{g}") for g in ("hot", "new", "cold")],
                                   "game string, package_name string")
    got = ingest.select_new(
        spark.createDataFrame(data, PAGE_PAYLOAD),
        spark.createDataFrame(stored, "review_id string, game string, at timestamp"),
        ingest.ingest_targets(config, ["en", "pt"]), 2, backfill=backfill, first_load="game",
    )
    assert ids(got) == _read_by_loop(targets, stored, 2, backfill)
