"""Operators over pages, the registered queries against SQL, and the pipeline."""

import hashlib
import html
import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from opinara.llm import html_text, queries, url_filter, warc

SF = "/root/testdata/sf0.001"
BIG = "y" * 1200


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_oracle(spark, duck, name):
    result = duck.execute(queries.ORACLE[name])
    columns = sorted(c[0] for c in result.description)
    want = sorted(map(repr, result.df()[columns].astype(object).where(lambda x: x.notna(), None).values.tolist()))
    df = queries.QUERIES[name](spark, SF)
    assert set(columns) <= set(df.columns)
    got = sorted(repr(list(r)) for r in df.select(columns).collect())
    number = re.compile(r"(\d+)\.0\b")
    assert [number.sub(r"\1", x) for x in got] == [number.sub(r"\1", x) for x in want]


# --- URL rules -----------------------------------------------------------------------------------


@pytest.mark.parametrize("ranges", [1, 7])
def test_url_rules_equal_brute_force(spark, ranges):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("a.example.org", "/", "block"),
             ("a.example.org", "/x", "allow"), ("com", "/fr/", "block"), ("e.com", "", "allow"),
             ("org", "/", "block"), ("Com", "/DE", "block"), (None, "/", "block"), ("", "/", "block")]
    hosts = ["a.example.org", "b.a.example.org", "xexample.org", "org", "e.com", "E.COM", "f.e.com", "", "com:80", "a..org"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/x/y", "/es/1", "/fr/?q", "/DE#a", "?x://y")]
    urls += [None, "", "no scheme", "//x.org/", "http://a.example.org/x\n/z"] + ["http://e.com/fr/"] * 40
    rows = [(i, u, "clash") for i, u in enumerate(urls)]
    got = {r.id: r for r in url_filter.filter_urls(
        spark.createDataFrame(rows, "id long, url string, host string").select("id", "url"),
        spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=ranges).collect()}
    assert len(got) == len(rows)
    best_of = {}
    for h, p, v in rules:
        if h:
            key = (h.lower(), p)
            best_of[key] = "block" if "block" in (v, best_of.get(key)) else v
    for i, u, _ in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
        fit = [(len(h + p), len(h), h + p, v) for (h, p), v in best_of.items()
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit)[2:] if fit else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u


def test_url_ids_of_any_size_and_clashing_columns(spark, tmp_path):
    """Ids beyond 2^53 beside null ids, very long urls, and extra columns named like inner ones."""
    ids = [2**53 + 1, 2**53 + 3, 2**60 + 1, -5, None, None, 0]
    urls = ["http://example.org/es/" + "x" * 100_000] * 3 + ["http://a.com/de/", None, "http://b.org/", "x"]
    rows = [(i, u, 7, "h", "k", 0) for i, u in zip(ids, urls, strict=True)]
    pages = spark.createDataFrame(rows, "page_id long, url string, id int, host string, key string, kind int")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["op2_url_filters"](spark, str(tmp_path)).collect()
    assert sorted(map(str, (r.page_id for r in got))) == sorted(map(str, ids))
    verdicts = {r.page_id: r.verdict for r in got if r.page_id is not None}
    assert verdicts == {2**53 + 1: "block", 2**53 + 3: "block", 2**60 + 1: "block", -5: "block", 0: "allow"}


def test_no_urls(spark):
    urls = spark.createDataFrame([], "id long, url string")
    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")
    assert url_filter.filter_urls(urls, rules).count() == 0


# --- WARC ----------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a/\r\nx", "abc"), (2, None, None), (4, "u", BIG), (5, "u", BIG), (6, "é", BIG), (6, "é", BIG),
    (3, "u", "x" * 500 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\n"
             "Content-Length: 5\r\n\r\nhello\r\n\r\n"),
    (None, "n", BIG), (7, "u", "WARC/1.1\r\n" * 3), (8, "u", "ünï\r\n\r\nWARC/1.1\r\nz"), (9, "u", ""),
]


@pytest.mark.parametrize("split,compression,chunk", [("128m", "gzip", 64 << 20), ("700b", "none", 900)])
def test_archives_round_trip(spark, tmp_path, monkeypatch, split, compression, chunk):
    """Version lines inside payloads are no records, wherever a file is split."""
    monkeypatch.setattr(warc, "CHUNK", chunk)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = str(tmp_path / "warc")
        pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
        warc.write(pages.coalesce(1), path, compression)
        got = sorted(map(str, map(tuple, warc.read(spark, path).collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    want = []
    for i, _, text in PAGES:
        data = (text or "").encode()
        again = text == BIG and i != 6
        want.append(str((i, len(data), hashlib.sha1(data).hexdigest(),
                         "revisit" if again else "response", 6 if again else None)))
    assert got == sorted(want)


def test_archives_of_negative_and_null_ids(spark, tmp_path):
    rows = [(-5, "u", BIG, 1), (-9, "u", BIG, 1), (None, "u", BIG, 1), (-1, "v", BIG + "x", 1), (None, "v", BIG + "x", 1)]
    rows += [(-(2**60), "w", "small", 1), (2**60 + 1, "w", "small", 1)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, digest int"), str(tmp_path / "w"))
    got = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.read(spark, str(tmp_path / "w")).collect())
    assert got == sorted([
        (False, -5, "response", 0), (False, -9, "revisit", -5), (True, 0, "revisit", -5), (False, -1, "response", 0),
        (True, 0, "revisit", -1), (False, -(2**60), "response", 0), (False, 2**60 + 1, "response", 0),
    ])


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


# --- HTML ----------------------------------------------------------------------------------------


def test_pages_give_their_article(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = {}
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    got = html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert {r.page_id: (r.text, r.n_chars) for r in got} == {i: (t, len(t)) for i, t in want.items()}


def test_page_furniture_goes_and_short_lines_stay():
    page = """<html><head><title>t</title></head><body><header>Site</header>
    <div class="cookie-notice">We use <b>cookies</b><div>ok</div></div><ul class='menu'><li>Home</ul>
    <article><h1>Ti&amp;tle</h1><p>One  <i>li</i>ne.<br>Next<p>Two</p><div id="ad-1">Buy</div>
    <form><p>mail<input></p></form><p>5 < 6 &eacute;&nbsp;x</p><script>var a = "<p>no</p>"</script>
    <section class="comments"><p>First!</p></section><p>End.</p></article>
    <aside><p>More</p></aside><footer>(c)</footer></body></html>"""
    assert html_text.main_text(page) == "Ti&tle\nOne line. Next\nTwo\n5 < 6 é x\nEnd."


def test_pages_without_an_article_mark():
    text = "A sentence of the main text that is long enough to count as such. " * 3
    page = f"<body><div>Home</div><div>About</div><hr><hr><hr><hr><p>{text}<p>Short.<p>{text}</body>"
    assert html_text.main_text(page).endswith("\n".join([text.strip(), "Short.", text.strip()]))
    assert html_text.main_text("<body><p>Hi</p></body>") == "Hi"


@pytest.mark.parametrize(
    "raw",
    ["<script>for(i=0;i<n;i++){f(i)}</script>", "<SCRIPT async>if(a<b)c()</Script >", "<style>/* a<b */</style>",
     "<textarea>a<b</textarea>", "<script>x='</aside><p>no</p>'</script>", "<script>'<!--'</script>",
     "<iframe src='a'>a<b</iframe>", "<svg><script>a<b</script><svg></svg>no</svg>"],
)
def test_raw_elements_end_at_their_own_end_tag(raw):
    article = f"<article><p>One {raw}two</p><aside>{raw}no</aside><p>Three</p></article>"
    page = f"<html><head><title>a<b</title>{raw}</head><body>{raw}{article}{raw}</body></html>"
    assert html_text.main_text(page) == "One two\nThree"


@pytest.mark.parametrize(
    "around",
    ['<div class="layout has-sidebar">{}</div>', '<div id="page" class="no-comments">{}</div>',
     '<section class="related-work">{}</section>', '<div class="sidebar"><article>{}</article></div>',
     '<main><div class="widget"><article>{}</article></div></main>', '<form id=f><h1></h1>{}</form>',
     "<ul><li class='share'>A<li>B</ul>{}", "<div><p class=ad>A</div>{}", "<div class=ad><p>A</div>{}",
     "<table><tr><td class=ad>A<td>B</table>{}", "<dl><dt class=ad>A<dd>B</dl>{}", "<div><span class=ad>A</div>{}",
     "<div data-id=ad>{}</div>", "<div><svg><path/></div>{}", "<p><b class=x><i class=ad>A</i></b>{}"],
)
def test_names_and_open_ends_do_not_take_the_text(around):
    text = "A sentence of the main text that is long enough to count as such. " * 3
    for body in (f"<p>{text}<p>{text}</p>", f"<article><p>{text}</p><p>{text}</p></article>"):
        got = html_text.main_text(f"<body>{around.format(body)}</body>")
        assert got.split("\n")[-2:] == [text.strip()] * 2


def test_titles_stay_and_named_furniture_goes():
    kept = "<div class='post-header'><h1>T</h1></div><header><h1>H</h1></header><div class=header><h1>K</h1></div>"
    gone = "".join(f"<div class='{c}'>no<p>no</div>" for c in ("sidebar", "x site-footer", "related-posts", "ad-1 y", "cookie-notice"))
    comments = "<div id=comments><article class='comment'><p>no</p></article></div>"
    teasers = "<aside><article><p>no</p></article></aside>"
    page = f"<article>{kept}<ul><li class=share>no<li>B</ul>{gone}{comments}<p>E</p></article>{teasers}{gone}"
    assert html_text.main_text(f"<head><meta><body class='has-sidebar'>{page}") == "T\nH\nK\nB\nE"


@pytest.mark.parametrize("tag", ["<div>", "<div class=ad>", "<p>", "<li>", "<b>", "<table><td>", "</b>"])
def test_deep_pages_end(tag):
    assert isinstance(html_text.main_text(tag * 50_000), str)


@pytest.mark.parametrize("size", [1, 5, 28, 29, 100])
def test_short_articles_without_a_mark(size):
    text = "\n".join(["x" * size, "y" * size, "z" * (size + 2)])
    blocks = "".join(f"<p>{x}</p>" for x in text.split("\n"))
    page = f"<body><nav>Home</nav><div>{blocks}</div><footer>(c)</footer></body>"
    assert html_text.main_text(page) == text


LONG = "A sentence of the main text that is long enough to count as such. " * 2
LONG = LONG.strip()


@pytest.mark.parametrize(
    "body,want",
    [
        ("<p>Short lead.</p><p>Tiny.</p>", "Short lead.\nTiny."),
        ("<div><h1>Title</h1><p>Note.</p></div>", "Title\nNote."),
        (f"<p>{LONG}</p><div class=ad>Buy</div><p>Fifteen signs..</p>", f"{LONG}\nFifteen signs.."),
        (f"<div><p>Lead.</p><div class=ad>Buy</div><p>{LONG}</p></div>", f"Lead.\n{LONG}"),
        (f"<p>{LONG}</p><ul class='comment-list'><li>First!</ul>", LONG),
        ("<ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul>", ""),
        (f"<ul><li><a href=/>Home</a></ul><hr><hr><hr><hr><div><p>{LONG} <a href=x>more</a></p></div>", f"{LONG} more"),
        # The distribution speaks on marked pages too: a long passage outside surges, a line does not.
        (f"<article><p>Hi.</p></article><div><p>{LONG * 4}</p></div>", f"Hi.\n{LONG * 4}"),
        (f"<article><p>Hi.</p></article><div><p>{LONG}</p></div>", "Hi."),
    ],
)
def test_blocks_decide(body, want):
    assert html_text.main_text(f"<body><nav>Menu</nav>{body}<footer>(c)</footer></body>") == want


def test_surges_and_dives_against_brute_force():
    """Every line judged apart: it stays if a line at or before it surges and no dive lies between."""
    rnd = random.Random(12)
    for _ in range(300):
        size = [rnd.choice([0, 0, 0, 1, 5, 40, 90]) for _ in range(rnd.randint(1, 25))]
        found = [html_text.Line("x" * n, rnd.choice([0, n]), rnd.random() < 0.5, rnd.randint(0, 3)) for n in size]
        marked = rnd.random() < 0.5
        w = [
            n * (html_text.INSIDE if x.inside else html_text.OUTSIDE) if marked else n * (x.linked < html_text.LINKS * n)
            for n, x in zip(size, found, strict=True)
        ]
        assert html_text.weights(found, marked).tolist() == w
        block = [sum(w[i : i + html_text.WINDOW]) for i in range(len(w))]
        bar = [rnd.choice([1, 30, 86]) for _ in w]
        want = [
            n > 0
            and any(
                size[j] > 0 and block[j] >= bar[j] and not any(block[k] == 0 and size[k] == 0 for k in range(j, i + 1))
                for j in range(i + 1)
            )
            for i, n in enumerate(size)
        ]
        got = html_text.chosen(np.array(block), np.array(size) > 0, np.array(bar, float))
        assert got.tolist() == want


def test_extract_on_odd_rows(spark):
    page = "<p>Same text.</p>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None), (3, None, ""), (4, "w", "<p>" + "a b " * 300_000)]
    schema = "page_id long, url string, html string"
    odd = spark.createDataFrame(rows, schema).selectExpr("*", "1 as text", "'x' as n_chars", "0 as page")
    got = html_text.extract(odd).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id in (1, None)] == ["Same text."] * 3
    by_id = {r.page_id: r for r in got}
    assert by_id[2].text == by_id[3].text == "" and by_id[4].n_chars == 1_199_999
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(odd.limit(0)).count() == 0


def test_unmarked_pages_give_nearly_all_of_their_article(spark):
    """The distribution alone, article tags cut out."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    whole = [html_text.main_text(p) for p in pages]
    alone = [html_text.main_text(re.sub(r"</?(?:article|main)>", "", p)) for p in pages]
    assert all({*a.split("\n")} - {""} <= {*w.split("\n")} for a, w in zip(alone, whole, strict=True))
    assert sum(map(len, alone)) >= 0.99 * sum(map(len, whole))


@pytest.mark.parametrize("page", [None, "", "plain", "<", "<p", "<!-- open", "<script>x", "<p>" * 5000, "&#xZZ;"])
def test_odd_pages_do_not_fail(page):
    assert isinstance(html_text.main_text(page), str)


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    quality = {r.doc_id: r.predicted for r in queries.QUERIES["op3_quality_classifier"](spark, SF).collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if number == len(corpus_pipeline.STAGES) - 1:
            break
        assert out.columns == columns
        out = out.cache()
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if number == 0:
            assert ids == {i for i, p in quality.items() if p}
        assert out.count() <= kept
        kept, docs = out.count(), out
    last = sorted(map(tuple, out.collect()))
    assert len(last) == kept > 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == last
