"""Registered queries: results against DuckDB, and the shape of their plans."""

import hashlib
import math
from datetime import date, datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as driver
from workload import binding

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
from workload.oracle import ORACLE  # noqa: E402
from workload.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v
        if isinstance(v, date) and not isinstance(v, datetime):
            return v.isoformat()
        return v

    out = [tuple(cell(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple(map(repr, r)))


def test_every_query_but_the_trained_one_has_an_oracle():
    assert set(QUERIES) - set(ORACLE) == {"ml_toxicity_logistic"}
    assert not set(ORACLE) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    want = canonical(columns, result.fetchall())
    got = canonical(df.columns, df.collect())
    assert got == want


def test_driver_serves_every_query():
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLE) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", ["ml_toxicity", "ml_toxicity_logistic"])
def test_trained_flag_covers_every_document(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.filter("toxicity").count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() == 30


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = sorted(set(ORACLE) - {"stream_enrich", "stream_ingest"})


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_joins_and_no_python_rows(spark, name):
    plan = physical(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ExistingRDD"):
        assert bad not in plan


def test_trend_reads_only_its_columns(spark):
    plan = physical(QUERIES["trend_score"](spark, SF))
    assert "text" not in plan and "Contains" not in plan


def test_filters_reach_the_scan(spark):
    plan = physical(QUERIES["trend_score_filtered"](spark, SF))
    assert "EqualTo(event_type,purchase)" in plan and "EqualTo(lang,en)" in plan
    assert "GreaterThanOrEqual(ts,2024-01-05" in plan and "LessThan(ts,2024-01-26" in plan


def test_theme_filter_scores_before_the_join(spark):
    """Texts are matched at the scan, so the join carries flags and not texts."""
    plan = physical(QUERIES["trend_score_by_theme"](spark, SF))
    assert plan.index("Join") < plan.index("Contains")


@pytest.mark.parametrize("name", ["weekly_agg", "weekly_report", "latest_reports", "grade"])
def test_report_figures_do_not_carry_texts(spark, name):
    """Whether a review has content is known without its text, so only flags are joined."""
    plan = physical(QUERIES[name](spark, SF))
    joins = [line for line in plan.splitlines() if "Join [doc_id" in line]
    assert joins and not any("text" in line for line in joins)
    projects = plan[plan.index("Contains") :]
    above = plan[: plan.index("Contains")]
    assert "text" in projects and " text#" not in above and "[text#" not in above


def test_texts_are_scored_whole(spark):
    """A document whose only term is at its very end is flagged."""
    from opinara.operators.enrichment import score_texts

    df = spark.createDataFrame([("x " * 200_000 + "stupid",)], "content string")
    assert score_texts(df, binding.SCORER).first()["toxicity"] is True


@pytest.mark.parametrize("name, by_id", [("anti_new_reviews", "LeftAnti"), ("dedup_reviews", "WindowGroupLimit")])
def test_digests_and_no_texts_are_shuffled_by_id(spark, tmp_path, name, by_id):
    start = datetime(2024, 1, 1)
    events = [(i, start + timedelta(days=i), i % 3, "view", 1.5 * i, f'{{"k": {i % 9}}}') for i in range(30)]
    columns = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    texts = [(i, f"text {i}" if i else None, "en", "web", 6) for i in range(5)]
    sf = str(tmp_path)
    spark.createDataFrame(events, columns).write.parquet(f"{sf}/events.parquet")
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(texts, columns).write.parquet(f"{sf}/documents.parquet")
    out = QUERIES[name](spark, sf)
    # The digest stands below what works by id.
    plan = physical(out)
    assert plan.index(by_id) < plan.index("md5(")
    got = {r["review_id"]: r["content_md5"] for r in out.collect()}
    assert len(got) == out.count() and got
    for i, md5 in got.items():
        doc, k = int(i) % 5, int(i) % 9
        text = {0: None, 1: "   "}.get(k, f"text {doc}" if doc else "")
        assert md5 == (None if text is None else hashlib.md5(text.encode()).hexdigest())


def test_ingest_shuffles_texts_once(spark):
    plan = physical(QUERIES["ingest"](spark, SF))
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "game" not in line or "package_name" in line


def test_landed_pages_deal_texts_out_by_document_alone(spark):
    plan = physical(binding.pages(spark, SF))
    assert "text" in plan and "RoundRobinPartitioning" not in plan
