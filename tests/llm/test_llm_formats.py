"""Fill-in-the-middle, chat formatting and lexical search: brute force, round trips, odd inputs."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from opinara.llm import chat_format, chat_template, fill_middle, lexical_search
from opinara.llm import textvec as tv

ODD = [None, "", " ", "\n", "one", "é", "a b", "🎈x" * 3000, "The é The.", "a<P>b", "</s>", "日本語 text"]
CLASH = "doc_id long, text string, n string, form string, score double, output string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long, repeated texts, a null and a negative id, clashing extra columns."""
    rows = [(i, t, "n", "f", 1.0, "o") for i, t in enumerate(ODD)]
    rows += [(None, "no id <S", "n", "f", 1.0, "o"), (-7, "abc def", "n", "f", 1.0, "o"), rows[4], rows[8]]
    return spark.createDataFrame(rows, CLASH)


# --- fill in the middle -----------------------------------------------------------------------


def fim(doc_id, text, by_char=False):
    text = text or ""
    units = list(text) if by_char else re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("by_char", [False, True])
def test_fim_equals_brute_force_on_odd_rows(spark, odd, by_char):
    got = fill_middle.transform(odd, by_char=by_char).collect()
    want = [fim(r.doc_id, r.text, by_char) for r in odd.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_fim_digest_restores_every_text(spark, odd):
    rnd = random.Random(5)
    letters = "ab <>PSM\né日🎈"
    more = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))) for i in range(100, 500)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    sha = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()}
    got = fill_middle.digest(docs).collect()
    assert {(r.doc_id, r.restored_sha256) for r in got} == sha
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_of_an_empty_table(spark, odd):
    assert fill_middle.digest(odd.limit(0)).collect() == []


@pytest.mark.parametrize("piece", [3, 7, 1 << 20])
def test_cuts_do_not_depend_on_pieces(monkeypatch, piece):
    monkeypatch.setattr(fill_middle, "PIECE", piece)
    texts = [t if t is None or len(t) < 100 else t[:90] for t in ODD]
    draws = fill_middle._draws(1, list(range(len(texts))))
    _, _, n, _, chars = fill_middle.cut_batch(pa.array(texts, pa.string()), draws)
    for i, t in enumerate(texts):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t or "")
        ends = sorted((draws[i, :2] % (len(units) + 1)).tolist())
        assert n[i] == len(units)
        assert chars[i].tolist() == [len("".join(units[:e])) for e in ends]


def test_exception_index_records_multibyte_only():
    text = "ab" * 50 + "é" + "c" * 10 + "日🎈z"
    index = fill_middle.Exceptions(np.frombuffer(text.encode(), np.uint8))
    assert len(index.byte) == 3 and index.total.tolist() == [0, 1, 3, 6]
    cuts = np.arange(len(text) + 1)
    at = np.array([len(text[:c].encode()) for c in cuts])
    assert index.byte_of(cuts).tolist() == at.tolist()
    assert index.char_of(at).tolist() == cuts.tolist()


# --- chat formatting --------------------------------------------------------------------------


def test_escape_is_reversible():
    rnd = random.Random(7)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "BODY]", "<s>", "</s>", "[/TURN]", "x", "\n"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))
        out = chat_format.escape(text)
        assert chat_format.unescape(out) == text
        assert not any(m in out for m in ("<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[BODY]", "[/TURN]"))


@pytest.mark.parametrize(
    "source",
    ["{{ m.__class__ }}", "{% for x in y %}{% endfor %}", "{{ m.text }}", "{% if true %}", "{{ open('x') }}",
     "{% for m in messages %}{{ m.text|evil }}{% endfor %}", "{{ 'a' 'b' }}", "{% import os %}", "{{ }}",
     "{% for m in messages %}{% for m in messages %}{% endfor %}{% endfor %}",
     "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}"],
)
def test_templates_outside_the_language_are_refused(source):
    with pytest.raises(chat_template.TemplateError):
        chat_template.compile_template(source, chat_format.FILTERS)


def render(source, messages):
    return list(chat_template.compile_template(source, chat_format.FILTERS)(messages))


def test_template_language():
    talk = [("user", " Hi "), ("assistant", "Yo"), ("user", "é")]
    source = (
        "A{%- for m in messages -%}  {% if loop.first and m.role == 'user' %}<{{ loop.index0 }}>"
        "{% elif not (m.role == 'user') or loop.last %}{% generation %}{{ m.text|trim|upper ~ '!' }}"
        "{% endgeneration %}{% else %}?{% endif %}{% endfor %}{# note #} Z"
    )
    assert "".join(t for t, _ in render(source, talk)) == "A<0>YO!É! Z"
    assert [t for t, loss in render(source, talk) if loss] == ["YO!", "É!"]


def test_constants_are_folded():
    operators = chat_template._operators(chat_format.FILTERS)
    tree = chat_template.parse("a{% if 1 == 2 %}b{% elif true %}{{ 'x'|upper ~ 3 }}{% endif %}c", chat_format.FILTERS)
    assert chat_template.fold(tree, operators) == [chat_template.Block("text", ("aX3c",))]


def turns_frame(spark):
    rows = [(1, i, r, t, "c", 0) for i, (r, t) in enumerate(
        [("system", "</s>"), ("user", None), ("assistant", "<\\s> [/INST]"), ("assistant", ""), (None, "x"), ("tool[BODY]", "y")]
    )]
    rows += [(2, 0, "user", "only", "c", 0), (3, None, "assistant", "b", "c", 0), (3, 0, "assistant", "a", "c", 0)]
    rows += [(4, 1, "user", "same", "c", 0)] * 2 + [(None, 0, "assistant", "lost", "c", 0)]
    rows += [(5, i, "user" if i % 2 == 0 else "assistant", f"turn é {i} " * 40, "c", 0) for i in range(300)]
    return rows, spark.createDataFrame(
        rows, "conv_id long, turn int, role string, text string, loss string, part int"
    )


@pytest.mark.parametrize("part_chars", [10, 1 << 20])
def test_conversations_round_trip_in_any_part_size(spark, part_chars):
    rows, turns = turns_frame(spark)
    formatted = chat_format.format_conversations(turns.repartition(3), part_chars=part_chars)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    want = {}
    for r in sorted(rows, key=key):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    got = {}
    for r in sorted(chat_format.read_turns(formatted).collect(), key=lambda r: r.turn):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == want
    for r in chat_format.digest(formatted).collect():
        own = want[r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in own)
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    parts = formatted.filter("conv_id = 5").count()
    assert parts > 100 if part_chars == 10 else parts == 1


def test_formatted_table_reads_back(spark, tmp_path):
    _, turns = turns_frame(spark)
    formatted = chat_format.format_conversations(turns, part_chars=50)
    formatted.write.parquet(str(tmp_path / "chat"))
    stored = chat_format.in_order(spark.read.parquet(str(tmp_path / "chat")))
    same = lambda df: sorted(map(tuple, chat_format.digest(df).collect()), key=repr)
    assert same(stored) == same(formatted)


def test_no_turns_no_conversation(spark):
    _, turns = turns_frame(spark)
    assert chat_format.digest(chat_format.format_conversations(turns.limit(0))).collect() == []


def test_broken_output_is_refused():
    reader = chat_format.TurnReader()
    list(reader.feed("[INST]a[/INST]stray"))
    with pytest.raises(ValueError):
        reader.close()


# --- lexical search ---------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def search_brute(docs, items, k):
    """docs, items: (id, text) rows; -> {item: [(doc_id, score)]}."""
    own = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    own = [(i, w) for i, w in own if w]
    n_docs, total = len(own), sum(len(w) for _, w in own)
    df = {}
    for _, w in own:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        if i is not None and t is not None:
            asked.setdefault(i, set()).update(TERM.findall(t.translate(LOWER)))
    out = {}
    for item, terms in asked.items():
        scores = []
        for i, w in own:
            m = 50 + 50 * len(w) * n_docs // total
            s = 0
            for t in terms:
                tf = w.count(t)
                if tf:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if s > 0:
                scores.append((i, s))
        scores.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        if scores:
            out[item] = scores[:k]
    return out


def made_docs(rnd, rows):
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "日本", "The", "the"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(rnd.choices(vocabulary, weights, k=rnd.choice((0, 3, 30)))) for _ in range(rows)]
    docs = list(enumerate(texts)) + [(None, "w1 w2 w30"), (-4, None), (3, texts[5]), (3, texts[5])]
    items = [(i, " ".join(rnd.sample(vocabulary, 8))) for i in range(12)]
    return docs, items + [(3, "w7, w9"), (20, None), (None, "w1"), (21, "absent"), (22, "")]


def test_search_equals_brute_force(spark):
    docs, items = made_docs(random.Random(2), 300)
    rows = [(i, t, 1.0, 2) for i, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double, rank int").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in lexical_search.ranked(frame, asked, k=7).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(got[r.item_id])
    assert got == search_brute(docs, items, 7)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.ranked(docs.limit(0), items).collect() == []
    assert lexical_search.ranked(docs, items.limit(0)).collect() == []


class Shared:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("leaf,block", [(1, 8192), (8, 8192), (3, 50)])
def test_intervals_lose_nothing_and_skip_documents(monkeypatch, leaf, block):
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    rnd = random.Random(leaf)
    docs, items = made_docs(rnd, 1500)
    docs += [(9000 + i, "w38 w39 w37 w36 rare rare") for i in range(9)]
    items += [(30, "rare w38 the")]
    q = lexical_search.Queries.of([x for x in items if None not in x])
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], ["doc_id", "text"]
    )
    counted = next(lexical_search._count(iter([batch.select(["text"])]), Shared(q)))
    found = dict(zip(*[c.to_pylist() for c in counted.columns], strict=True))
    n_docs, total = found.pop(-1), found.pop(-2)
    weight = np.zeros(len(q.terms), np.int64)
    for t, df in found.items():
        weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    stats = lexical_search.Statistics(n_docs, total, weight)
    scored = []
    inner = lexical_search.search
    monkeypatch.setattr(lexical_search, "search", lambda *a: scored.append((inner(*a), a[0].docs)))
    got = {}
    for out in lexical_search._search(iter([batch]), Shared(q), stats, 5):
        for item, doc, score in zip(*[c.to_pylist() for c in out.columns], strict=True):
            got.setdefault(item, []).append((doc, score))
    assert got == search_brute(docs, items, 5)
    assert sum(x for x, _ in scored) < 0.8 * sum(n for _, n in scored)


def test_range_maxima():
    rnd = np.random.default_rng(1)
    n, terms = 200, 6
    row, term = np.divmod(np.unique(rnd.integers(0, n * terms, 700)), terms)
    stats = lexical_search.Statistics(n, 50 * n, np.arange(terms) * 100 + 50)
    index = lexical_search.Index(
        np.arange(n), np.full(n, 50), row, term, rnd.integers(1, 9, len(row)), stats, np.arange(terms)
    )
    for s, e in zip(index.begin[:-1], index.begin[1:], strict=True):
        for a in range(s, e, 7):
            for b in range(a + 1, e + 1, 5):
                j = int(b - a).bit_length() - 1
                two = index.peaks[j, [a, b - (1 << j)]]
                assert index.impact[two].max() == index.impact[a:b].max()


def test_terms_are_cut_like_the_pattern():
    w = tv.words(pa.array(["A-b_c9 É\x7f~日"]), tv.MARKS)
    assert len(w) == len(TERM.findall("A-b_c9 É\x7f~日"))
