"""Operators over documents: brute force, exact round trips, held-out accuracy, odd inputs."""

import collections
import hashlib
import random
import re
import tracemalloc
import types

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opinara.llm import (
    bpe,
    decontamination,
    jaccard_join,
    quality_knn,
    quality_rules,
    queries,
    secrets_crf,
    toxicity,
)
from opinara.llm import textvec as tv

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = [None, "", " ", "\n", "one", "é", "a b", "x" * 5000, "The. \t The.\n\nThe. The.", "w " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long and repeated texts, a null id, and extra columns with clashing names."""
    rows = [(i, t, "en", 1.0, "k") for i, t in enumerate(ODD)] + [(None, "no id at all", "en", 2.0, "k")]
    rows += rows[4:6]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, score double, key string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def peak_mb(work):
    """Most MB that numpy and Python hold while ``work`` runs, and its result."""
    tracemalloc.start()
    try:
        out = work()
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_many_short_texts_are_counted_in_blocks():
    texts = [f"Word{i % 7} {'x' * (i % 5)}\n2" if i % 11 else None for i in range(10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(texts)], ["doc_id", "text"])
    x = quality_knn.counts(pa.array(texts[:600]))
    known = np.random.default_rng(1).random((600, quality_knn.TERMS), np.float32)
    model = quality_knn.Model.fit(known, np.arange(600) % 2 == 0)
    shared = types.SimpleNamespace(value=model)
    mb, got = peak_mb(lambda: [b.to_pylist() for b in quality_knn._scored(iter([batch]), shared)])
    rows = [row for part in got for row in part]
    assert mb < 60, mb
    assert [r["doc_id"] for r in rows] == list(range(10_000))
    np.testing.assert_allclose([r["score"] for r in rows[:600]], model.score(x), atol=1e-6)
    kept = pa.Table.from_batches(quality_knn._kept(iter([batch]), shared, 0.5))
    assert kept["doc_id"].to_pylist() == [r["doc_id"] for r in rows if r["score"] >= 0.5]


def test_secrets_of_a_batch_are_scanned_in_parts():
    text = "a1 b Cd key=abc123def456 77 " * 75
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array([text] * 800)], ["doc_id", "text"])
    shared = types.SimpleNamespace(value=secrets_crf.train([]))
    mb, rows = peak_mb(lambda: sum(b.num_rows for b in secrets_crf._scan(iter([batch]), shared)))
    assert rows == 800
    assert mb < 50, mb


def test_lean_gives_the_same_batches(monkeypatch):
    released = []
    monkeypatch.setattr(tv, "release", lambda: released.append(1))
    parts = [pa.RecordBatch.from_arrays([pa.array([i])], ["a"]) for i in range(2 * tv.TRIM + 1)]
    assert list(tv.lean(iter(parts))) == parts
    assert len(released) == 3
    assert list(tv.lean(iter([]))) == []
    assert len(released) == 4


def test_words_of_any_piece_size(monkeypatch):
    rnd = random.Random(3)
    for size in (5, 37, 1 << 16):
        monkeypatch.setattr(tv, "PIECE", size)
        texts = ["".join(rnd.choice("ab Cé\n\t.") for _ in range(rnd.randint(0, 90))) for _ in range(40)]
        w = tv.words(pa.array([None, *texts, ""]))
        want = [
            (i + 1, m.start(), m.end())
            for i, t in enumerate(texts)
            for m in re.finditer(rb"[^\x20\x09-\x0d]+", t.encode())
        ]
        assert list(zip(w.row.tolist(), w.start.tolist(), w.end.tolist(), strict=True)) == want


# --- n-gram Jaccard join ----------------------------------------------------------------------


def shingles(text, k=3):
    w = words((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def linked_components(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                u, v = sorted((top(i), top(j)))
                root[v] = u
    return {i: (len(s), top(i)) for i, s in sets}


def edited(rnd, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("hubs", [2, 16])
def test_join_equals_brute_force(spark, monkeypatch, hubs):
    """Chains, hubs that do not link, copies, small sets and sets around the threshold."""
    monkeypatch.setattr(jaccard_join, "MORE_HUBS", hubs)
    rnd, rows = random.Random(hubs), []
    for size in (4, 8, 12, 30, 80, 200):
        base = " ".join(f"v{rnd.randrange(200)}" for _ in range(size))
        for _ in range(12):
            rows.append(edited(rnd, base, rnd.randint(0, max(1, size // 40))))
            base = edited(rnd, base, 1) if rnd.random() < 0.3 else base
    rows += [rows[0], rows[0].upper(), "", None, " ", "a", "a b", "A  B", "b a"]
    rows = list(enumerate(rows))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}
    assert got == linked_components(rows, 90)


def test_links_at_the_threshold_across_bands(spark):
    """Pairs of 66 and 67 shingles with 63 in common meet in the band below too, as others share
    keys with each of them there."""
    texts = []
    for i in range(400):
        ends = (f" a{i} b{i} c{i}", f" d{i} e{i} f{i} g{i}")
        base = [f"p{i}w{j}" for j in range(65)]
        texts += [" ".join(base) + end for end in ends]
        texts += [" ".join([f"q{i}{k}w{j}" for j in range(8)] + base[8:]) + ends[k] for k in (0, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs).collect()
    want = {i: i - 1 if i % 4 == 1 else i for i in range(len(texts))}
    assert {r.doc_id: r.component_id for r in got} == want


def test_every_linked_pair_shares_a_key():
    """The pigeonhole argument, with and without deletions."""
    rnd = np.random.default_rng(1)
    for rows in (1, 10**9):
        bands = jaccard_join.Bands(90, rows)
        assert (bands.deleting[:8].max() > 0) == (rows > 1)
        for n in [*range(1, 60), 150, 400]:
            a = rnd.integers(0, 1 << 62, n).astype(np.uint64)
            for _ in range(4):
                out = int(rnd.integers(0, n // 9 + 1))
                b = np.concatenate([a[out:], rnd.integers(0, 1 << 62, int(rnd.integers(0, n // 9 + 1))).astype(np.uint64)])
                both = len(a) - out
                if 100 * both < 90 * (len(a) + len(b) - both):
                    continue
                row = np.repeat([0, 1], [len(a), len(b)])
                at, keys, slots, _ = jaccard_join.signatures(row, np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)]), bands)
                same = {(k, s >> 32) for k, s in zip(keys[at == 0].tolist(), slots[at == 0].tolist(), strict=True)}
                same &= {(k, s >> 32) for k, s in zip(keys[at == 1].tolist(), slots[at == 1].tolist(), strict=True)}
                # Some band in which they share more keys than either record may leave out.
                assert any(
                    sum(y == band for _, y in same) > min(s & 0xFFFFFFFF for s in slots.tolist() if s >> 32 == band)
                    for band in {y for _, y in same}
                )


def test_tags_never_differ_more_than_the_sets(spark):
    """Unequal packed tags against the symmetric difference, for near and for unrelated sets."""
    rng = np.random.default_rng(5)
    bands = jaccard_join.Bands(80, 1000)
    near, pairs = [], []
    for _ in range(30):
        a = np.unique(rng.integers(1, 1 << 62, rng.integers(40, 400)).astype(np.uint64))
        kept = a[rng.random(len(a)) < rng.choice([0.5, 0.9, 0.98, 1.0])]
        new = rng.integers(1, 1 << 62, rng.integers(0, 9)).astype(np.uint64)
        near.append((a, np.unique(np.concatenate([kept, new]))))
    for x, y in near:
        row = np.repeat([0, 1], [len(x), len(y)])
        idx, band, numbers, packed = jaccard_join.cell_tags(
            row, np.concatenate([x, y]), np.array([len(x), len(y)]), bands
        )
        ends = np.cumsum(numbers)
        tags = {(int(i), int(b)): packed[e - m : e] for i, b, m, e in zip(idx, band, numbers, ends)}
        for b in {b for i, b in tags if i == 0} & {b for i, b in tags if i == 1}:
            lists = [tags[i, b].view(np.int64).tolist() for i in (0, 1)]
            # Counted tag by tag, without the packing's arithmetic.
            plain = sum(
                (p >> s & 15) != (q >> s & 15)
                for p, q in zip(tags[0, b].tolist(), tags[1, b].tolist())
                for s in range(0, 64, 4)
            )
            pairs.append((*lists, plain, len(np.setxor1d(x, y))))
    got = spark.createDataFrame(pairs, "a array<long>, b array<long>, plain int, apart int")
    each = F.aggregate(F.zip_with("a", "b", jaccard_join.unequal_tags), F.lit(0), lambda t, c: t + c)
    rows = got.select(each.alias("n"), "plain", "apart").collect()
    assert len(rows) > 20 and all(r.n == r.plain <= r.apart for r in rows)
    assert any(r.n > 0.8 * r.apart > 5 for r in rows)


def test_near_copies_meet_in_few_of_their_buckets(spark):
    """A group of near copies, some of them edited too much to link: no pair is lost, few meet again and again."""
    rnd = random.Random(6)
    base = " ".join(f"v{rnd.randrange(900)}" for _ in range(150))
    rows = [(i, edited(rnd, base, rnd.choice((1, 2, 3, 8)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    member = jaccard_join.buckets(*jaccard_join.document_sets(docs, 5, 80))
    hubs = member.select("bucket", F.col("id").alias("hub"), F.col("earlier").alias("hub_earlier"))
    met = hubs.join(member, "bucket").filter("hub < id")
    every = met.select("hub", "id").distinct().count()
    first = met.filter(jaccard_join.meet_first()).select("hub", "id")
    assert every > 2000 and met.count() > 10 * every
    assert first.distinct().count() == every
    assert first.count() < 4 * every


def test_tags_stay_out_of_buckets_and_few_texts_are_read(spark, monkeypatch):
    """Texts that share a passage share keys, but only those in pairs that the tags allow are dealt out."""
    rnd, rows, tables = random.Random(7), [], []
    passage = " ".join(f"p{i}" for i in range(90))
    for i in range(150):
        rows.append(passage + "".join(f" u{i}w{j}" for j in range(90)))
    rows += [edited(rnd, rows[i], 1) for i in (3, 50, 149)]
    stage = jaccard_join.staged

    def kept(df, purpose):
        out = stage(df, purpose)
        tables.append((purpose, set(out.columns), out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "staged", kept)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs, 5, 80).collect()
    want = {**{i: i for i in range(150)}, 150: 3, 151: 50, 152: 149}
    assert {r.doc_id: r.component_id for r in got} == want
    assert max(n for purpose, _, n in tables if purpose == "jaccard-active") > 150
    assert not any({"bucket", "tags"} <= names or {"bucket", "hub_tags"} <= names for _, names, _ in tables)
    assert 6 <= max(n for purpose, _, n in tables if purpose == "jaccard-texts") < 30


def test_texts_without_a_partner_get_no_keys(spark):
    """Keys are made of near copies alone, in a table large enough to be sieved; texts of their own meet nowhere."""
    rnd = random.Random(11)
    rows = [" ".join(f"v{rnd.randrange(3000)}" for _ in range(rnd.randint(30, 120))) for _ in range(600)]
    near = [0, 7, 311, 599]
    rows += [edited(rnd, rows[i], 1) for i in near] + [rows[5], rows[6].upper()]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets, keys, *_ = jaccard_join.document_sets(docs, 5, 80)
    assert sets.count() == len(rows)
    want = {*near, *range(600, 604)}
    assert {r.id for r in keys.filter("slice >= 0").select("id").distinct().collect()} == want


def test_sieved_join_equals_brute_force(spark, monkeypatch):
    """The sieves with sets at and beside the threshold, of one shingle and more, copies, nulls and repeated ids."""
    monkeypatch.setattr(jaccard_join, "SIEVED", 0)
    monkeypatch.setattr(jaccard_join, "PACKED", 50)
    monkeypatch.setattr(jaccard_join, "SLICED", 5000)
    k, percent, rnd, rows = 5, 80, random.Random(13), []
    for size in (1, 2, 4, 8, 12, 30, 80, 200):
        base = [f"v{rnd.randrange(400)}" for _ in range(size)]
        rows += [" ".join(base), " ".join(base) + " end"]
        for more in range(0, size // 2, max(1, size // 20)):  # some of them are just linked, others just not
            rows.append(" ".join(base) + "".join(f" x{more}y{j}" for j in range(more)))
        rows += [edited(rnd, " ".join(base), rnd.randint(0, max(1, size // 40))) for _ in range(6)]
    rows += [rows[0], rows[9].upper(), "", None, " ", *[" ".join(f"s{i}t{j}" for j in range(40)) for i in range(30)]]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([*rows, rows[20], (None, rows[25][1])], "doc_id long, text string").repartition(3)
    got = jaccard_join.jaccard_components(docs, k, percent).collect()
    assert len(got) == len(rows) + 2
    sets = [(i, shingles(t, k)) for i, t in rows]
    link = {i: i for i, _ in sets}
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x & y and 100 * len(x & y) >= percent * len(x | y) and link[i] != link[j]:
                u, v = sorted((link[i], link[j]))
                link = {n: u if c == v else c for n, c in link.items()}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == link
    assert len(set(link.values())) < len(link) - 20


def test_lone_shingles_against_plain_counts(spark):
    rng = np.random.default_rng(12)
    held = [(int(h), np.unique(rng.integers(0, 900, 60)).astype(np.uint64)) for h in rng.integers(-(1 << 62), 1 << 62, 40)]
    held += held[:3]  # another task's copy of a set, under the same number
    for parts in (1, 7):
        rows = []
        for h, x in held:
            packets = jaccard_join.Packets(parts, np.uint32, np.int64)
            at, part, short = jaccard_join.universe_share(x, 0.5, parts)
            packets.add(part, short, np.full(len(at), h))
            rows += zip(*[c.to_pylist() for c in packets.take()], strict=True)
        got = jaccard_join.lone_shingles(spark.createDataFrame(rows, jaccard_join.PACKETS).repartition(3), parts)
        got = {r.holder: r.lone for r in got.collect()}
        sets = {h: set(x[jaccard_join.universe_share(x, 0.5, parts)[0]].tolist()) for h, x in held}
        want = {h: len(x.difference(*[y for i, y in sets.items() if i != h])) for h, x in sets.items()}
        assert got == {h: n for h, n in want.items() if n} and len(got) > 20


def test_sieves_keep_links_of_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SIEVED", 0)
    test_null_and_repeated_ids_lose_no_link(spark, 4)


def test_join_of_odd_and_empty_inputs(spark, odd):
    got = jaccard_join.jaccard_components(odd).collect()
    assert len(got) == odd.count()
    assert all(r.component_id == r.doc_id for r in got if r.doc_id is not None and r.doc_id < 4)
    assert jaccard_join.jaccard_components(odd.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_null_and_repeated_ids_lose_no_link(spark, parts):
    """Copies beside rows without an id, and two texts under one id, each with near copies."""
    rnd = random.Random(4)
    a, b, c, d = (" ".join(f"{x}{rnd.randrange(900)}" for _ in range(90)) for x in "abcd")
    near = lambda t: edited(rnd, t, 1)
    rows = [(None, a), (1, a), (2, a), (None, near(a)), (9, near(a)), (5, b), (5, c), (7, near(b)), (8, near(c)),
            (5, ""), (-3, near(c)), (11, d), (11, d), (2**60 + 1, near(d)), (None, None), (12, "one"), (12, None)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, id string, key int")
    got = jaccard_join.jaccard_components(docs.repartition(parts)).collect()
    assert len(got) == len(rows)
    want = {1: 1, 2: 1, 9: 1, 5: -3, 7: -3, 8: -3, -3: -3, 11: 11, 2**60 + 1: 11, 12: 12, None: None}
    assert {r.doc_id: r.component_id for r in got} == want
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t)) for _, t in rows)


def test_pipeline_stage_links_at_its_own_threshold(spark):
    """Edited copies of 0.8 and more on five words are one group, also below 0.9 on three."""
    rnd, rows = random.Random(8), []
    for size in (6, 20, 45, 60, 120, 300):
        for _ in range(6):
            base = " ".join(f"v{rnd.randrange(3000)}" for _ in range(size))
            rows += [base, *(edited(rnd, base, rnd.randint(0, 1 + size // 30)) for _ in range(3))]
    rows = list(enumerate(rows))
    sets = [shingles(t, 5) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert got == set(group)
    assert got < {top for _, top in linked_components(rows, 90).values()}


def test_pipeline_stage_keeps_rows_without_an_id(spark):
    rows = [(None, "no id at all here", 1), (4, "one text of its own", 2), (None, "a second one", 3), (5, "one text of its own", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r.n_chars for r in got.collect()) == [1, 2, 3]


# --- BPE ---------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    rnd = random.Random(2)
    bits = ["the", "ing", " ", " ", "\n", "Ab", "ééà", "1", "...", "'s", "<|endoftext|>", "\xa0", "  ", "zz"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(500)]
    vocab = bpe.vocabulary(path)
    assert vocab.ids(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for data in (docs, odd):
        texts = collections.defaultdict(set)
        for r in data.select("doc_id", "text").collect():
            texts[r.doc_id].add(r.text or "")
        got = bpe.encode(data, path).collect()
        assert len(got) == data.count()
        for r in got:
            assert any(
                r.ids == library.encode(t, add_special_tokens=False).ids and r.decoded == t
                for t in texts[r.doc_id]
            )
    r = bpe.encode_digest(odd.filter("doc_id = 4"), path).first()
    ids = np.array(library.encode("one").ids, "<u4")
    assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())


# --- quality rules -----------------------------------------------------------------------------


def test_quality_rules_equal_brute_force(docs, odd):
    for data in (docs, odd):
        texts = {r.doc_id: r.text or "" for r in data.collect()}
        for r in quality_rules.judge(data).collect():
            t = texts[r.doc_id]
            w = words(t)
            runs = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            repeat = {
                j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)
            }
            lines = [x for x in t.split("\n") if words(x)]
            want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)),
                    len(lines) - len(set(lines)), len(repeat))
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w))
            assert not (r.base_failed and r.kept)


def test_failing_lines_go_and_clean_ones_stay():
    good = "A plain sentence about nothing in particular, with enough words."
    bad = ["Home | News | Sport | Weather | About", "BUY!! NOW!! CHEAP!! PILLS!! HERE!!", "We use cookies.",
           "x### y### z### a### b###", "la " * 30]
    text, lost, total = quality_rules.clean_lines("\n".join([good, *bad, "", good]))
    assert text == f"{good}\n\n{good}" and 0 < lost < total


# --- classifiers -------------------------------------------------------------------------------


@pytest.mark.parametrize("name,target,least", [("op3_quality_classifier", "quality", 0.97), ("op7_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, target, least):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, {target} FROM '{sf}/labels.parquet'").fetchall()
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())
    held = [got[i].predicted == y for i, y in labels if got[i].held_out]
    assert len(held) > 80 and sum(held) >= least * len(held)


@pytest.mark.parametrize("module", [quality_knn, toxicity])
def test_classifiers_on_odd_inputs(spark, docs, odd, module):
    target = "quality" if module is quality_knn else "toxic"
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    both = docs.select("doc_id", "text").union(odd.selectExpr("doc_id + 100000", "text"))
    got = module.classify(both, labels).collect()
    assert len(got) == both.count() and all(0 <= r.score <= 1 and r.held_out in (True, False) for r in got)
    nothing = labels.limit(0).select("doc_id", target)
    assert module.classify(odd, nothing).count() == odd.count()
    assert module.classify(odd.limit(0), labels).count() == 0


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.2).astype(int)
    votes = np.stack([np.where(rng.random(4000) < p, 2 * y - 1, 0) for p in (0.9, 0.5, 0.05)], 1)
    model = toxicity.LabelModel.fit(votes, y)
    strong, middle, weak = model.accuracies()
    assert strong > middle > weak and ((model.posterior(votes) > 0.5) == y).mean() > 0.93
    measured = votes[y == 1].mean(0) - votes[y == 0].mean(0)
    assert np.abs(model.accuracies() - measured).max() < 0.05
    # A voter counted twice shares its weight: the posteriors hardly move.
    twice = np.column_stack([votes, votes[:, 1]])
    double = toxicity.LabelModel.fit(twice, y)
    assert np.allclose(double.share, [1, 0.5, 1, 0.5], atol=0.05)
    assert np.abs(double.posterior(twice) - model.posterior(votes)).max() < 0.1


def test_label_model_overrules_wrong_labels():
    rng = np.random.default_rng(1)
    y = (rng.random(3000) < 0.3).astype(int)
    votes = np.stack([np.where(rng.random(3000) < p, y, 0) for p in (0.9, 0.8, 0.85)], 1).astype(float)
    noisy = np.where(rng.random(3000) < 0.1, 1 - y, y)
    target = toxicity.LabelModel.fit(votes, noisy).posterior(votes) > 0.5
    assert (target != noisy).sum() > 200 and (target == y).mean() > 0.98


def test_toxicity_learns_from_posteriors_not_labels(spark, monkeypatch):
    seen = {}
    fit, train = toxicity.LabelModel.fit, toxicity.train_linear

    def spy_fit(votes, label, rounds=10):
        seen["votes"], seen["label"], seen["model"] = votes, label, fit(votes, label, rounds)
        return seen["model"]

    def spy_train(rows, columns, scale, n, target, **more):
        seen["target"] = target
        return train(rows, columns, scale, n, target, **more)

    monkeypatch.setattr(toxicity.LabelModel, "fit", spy_fit)
    monkeypatch.setattr(toxicity, "train_linear", spy_train)
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    toxicity.classify(docs, labels)
    votes, y, target = seen["votes"], seen["label"], seen["target"]
    assert np.array_equal(target, seen["model"].posterior(votes))
    assert not any(np.array_equal(np.abs(v), y) or np.array_equal((v + 1) / 2, y) for v in votes.T)
    assert ((target > 0.5) != y).sum() > 0  # some label stays without a sign in the text
    measured = votes[y == 1].mean(0) - votes[y == 0].mean(0)
    assert np.abs(seen["model"].accuracies() - measured).max() < 0.1


def test_toxicity_scores_against_brute_force(spark):
    """Scores of a fixed model, feature by feature with dictionaries and Python's own words."""
    rnd = random.Random(8)
    vocabulary = ["you", "idiot", "STUPID", "stupidly", "moro", "Ärger", "abcd", "abcdef", "xy", "é"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 6))) for _ in range(60)]

    def known(word):
        data = word.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
        whole = int(tv.words(pa.array([data.decode()]), tv.MARKS).hash[0])
        out = {whole}
        for k in toxicity.HEADS:
            if len(data) >= k:
                head = tv.words(pa.array([word]), tv.MARKS, heads=(k,)).extra[f"head{k}"][0]
                base = whole if len(data) == k else int(head)
                out.add(int(tv.mix(np.array([base], np.uint64), 40 + k)[0]))
        return out

    lists = toxicity.lexicons([], [])
    keys = np.array(sorted(set().union(*map(known, vocabulary[2:]))), np.uint64)
    weights = np.random.default_rng(2).normal(size=len(keys) + len(lists))
    model = toxicity.Classifier(keys, lists, weights, -0.5)
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(ODD)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model)
    got = {r.doc_id: (r.score, r.predicted) for r in got.collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ws = re.findall(r"[A-Za-z0-9\x80-\U0010FFFF]+", t or "")
        found = set().union(*map(known, set(ws))) if ws else set()
        z = -0.5 + sum(w for k, w in zip(keys.tolist(), weights, strict=False) if k in found)
        z += sum(w for x, w in zip(lists, weights[len(keys) :], strict=True) if found & set(x.tolist()))
        want = 1 / (1 + np.exp(-z))
        assert abs(got[i][0] - want) < 1e-9 and got[i][1] == (got[i][0] >= 0.7)


# --- decontamination ---------------------------------------------------------------------------


@pytest.mark.parametrize("block", [50, 10**6])
def test_edited_items_are_found_and_others_are_not(spark, block):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(40)) for i in range(20)] + [(99, "too short"), (98, None), (97, "")]
    docs, want = [], set()
    for i in range(60):
        body = text(200)
        if i < 20:
            body = f"{body} {edited(rnd, items[i][1], i % 7)} {text(30)}"
            want.add((i, i))
        docs.append((i, body, "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, "w1", "x"), (3, docs[3][1], "x")]
    got = decontamination.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string, item_id string"),
        spark.createDataFrame(items, "item_id long, text string"), size=block,
    ).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_heavily_edited_and_partly_quoted_items_are_found(spark):
    """An edit in every five words and 45% quotes, alone, beside exact copies and with a common start."""
    rnd = random.Random(6)
    text = lambda n: [f"w{rnd.randrange(400)}" for _ in range(n)]
    start = text(8)
    items = [start * (i % 2) + text(40 - 8 * (i % 2)) for i in range(20)]
    docs, want = [], set()
    for i, item in enumerate(items):
        worn = [f"e{rnd.randrange(10**6)}" if j % 5 == 4 else x for j, x in enumerate(item)]
        for quote in ([worn], [item[:18]], [item[11:29]], [worn, item])[i // 2 % 4]:
            want.add((len(docs), i))
            docs.append(text(120) + quote + text(30))
    docs += [text(60) + start + text(60) for _ in range(30)]
    got = decontamination.contaminated(
        spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"),
    ).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("most", [1, 7, 50])
def test_parts_of_seeds_give_the_same_seeds(monkeypatch, most):
    rnd = random.Random(most)
    text = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    items = decontamination.Items.of([0, 1, 2], [text(9), text(12), text(5)])
    w = tv.words(pa.array([text(rnd.randrange(30)) for _ in range(12)]), tv.MARKS)
    keys = np.unique(items.grams)

    def met():
        parts = list(decontamination.hits(w, items, keys, tv.sieve(keys)))
        rows = [set(p[0].tolist()) for p in parts]
        assert sum(map(len, rows)) == len(set().union(*rows))
        return len(parts), sorted(x for p in parts for x in zip(*map(np.ndarray.tolist, p), strict=True))

    whole = met()
    monkeypatch.setattr(decontamination, "SEEDS", most)
    parts = met()
    assert whole[0] == 1 < parts[0] and whole[1] == parts[1]


def test_alignment_equals_a_plain_table():
    rnd = np.random.default_rng(2)
    for _ in range(30):
        a, b = rnd.integers(1, 5, (1, 7)).astype(np.uint64), rnd.integers(1, 5, (1, 12)).astype(np.uint64)
        h = np.zeros((8, 13), int)
        for i in range(7):
            for j in range(12):
                hit = 2 if a[0, i] == b[0, j] else -1
                h[i + 1, j + 1] = max(0, h[i, j] + hit, h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontamination.align(a, b)[0][0] == h.max()


def brute_force_score(item, text):
    """Best plain Smith-Waterman score of all words of both, over that of a perfect match."""
    above, best = [0] * (len(text) + 1), 0
    for x in item:
        row = [0]
        for j, y in enumerate(text, 1):
            hit = decontamination.MATCH if x == y else decontamination.MISS
            row.append(max(0, above[j - 1] + hit, above[j] + decontamination.MISS, row[-1] + decontamination.MISS))
        above, best = row, max(best, *row)
    return best / (decontamination.MATCH * len(item))


@pytest.mark.parametrize("vocabulary", [60, 400])
def test_whole_query_against_alignment_of_every_pair(spark, vocabulary):
    """Copies with a word put in or changed every two, three or five words, quotes and clean texts."""
    rnd = random.Random(vocabulary)
    text = lambda n: [f"w{int(vocabulary * rnd.random() ** 2)}" for _ in range(n)]
    items = [text(rnd.choice([3, 10, 10, 25])) for _ in range(24)]
    docs = [text(60) for _ in range(20)]
    for i, item in enumerate(items):
        every = (2, 3, 5)[i % 3]
        put_in = [y for j, x in enumerate(item) for y in ([x, f"e{i}"] if j % every == every - 1 else [x])]
        changed = [f"e{i}" if j % every == every - 1 else x for j, x in enumerate(item)]
        docs += [text(40) + x + text(20) for x in (put_in, changed, item[: len(item) // 2 + 1])]
    got = decontamination.contaminated(
        spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"),
    ).collect()
    scores = {(d, i): brute_force_score(x, t) for d, t in enumerate(docs) for i, x in enumerate(items)}
    want = {k for k, v in scores.items() if v >= decontamination.THRESHOLD}
    found = {(r.doc_id, r.item_id): r.score for r in got}
    assert found.keys() <= want and len(found) == len(got)
    assert all(abs(v - scores[k]) < 1e-9 or v < scores[k] for k, v in found.items())
    long = {(d, i) for d, i in want if len(items[i]) >= 10}
    own = {(20 + 3 * i + k, i) for i in range(len(items)) for k in range(2)} & want
    missed = own - found.keys()
    assert len(long & found.keys()) >= 0.9 * len(long) and len(missed) <= 0.1 * len(own)


def test_items_of_one_and_two_words_match_their_lines(spark):
    items = [(1, "Paris"), (2, "forty two"), (3, "Paris"), (4, "!?")]
    docs = [(1, "The capital of France:\nPARIS.\nMore."), (2, "Paris is large, forty two times."), (3, "Forty-two"),
            (4, "Paris\nParis"), (5, None), (6, ""), (7, "\n\n"), (None, "Paris"), (8, "forty\ntwo"), (9, "x " * 300_000 + "\nforty two!\n")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'k' as item_id", "0 as score")
    marks = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = decontamination.contaminated(docs, marks).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 3), (3, 2), (4, 1), (4, 3), (9, 2)]
    assert all(r.score == 1 for r in got)
    assert {r.doc_id: r.last_word for r in got} == {1: 4, 3: 1, 4: 1, 9: 300_001}
    assert decontamination.contaminated(docs.limit(0), marks).count() == 0


def test_no_benchmark_no_hits(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, empty).count() == 0


# --- secrets -----------------------------------------------------------------------------------


def test_secret_spans(spark, docs, odd):
    field = secrets_crf.fit(docs)
    for data in (docs, odd):
        texts = collections.defaultdict(list)
        for r in data.collect():
            texts[r.doc_id].append(r.text or "")
        for r in secrets_crf.scan(data, field).collect():
            digests = []
            for t in texts[r.doc_id]:
                found = [
                    (m.start(), 0, f"assign:{m.start()}:{m.end()}")
                    for m in re.finditer(
                        r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t
                    )
                    if len(m.group(2)) >= 8
                ]
                for rank, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 16), (2, "hex", "[0-9a-f]+", 32)):
                    found += [
                        (m.start(), rank, f"{kind}:{m.start()}:{m.end()}")
                        for m in re.finditer(pattern, t) if len(m.group()) >= least
                    ]
                digests.append(hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest())
            assert r.base_sha256 in digests


def test_field_decoding_is_exact_and_masks(spark):
    key = "9f3b7c1d2e4a5f60718293a4b5c6d7e8f9a0b1c2"
    texts = [f"some words here {i} token = \"{key[i:]}{key[:i]}\" and more words" for i in range(30)]
    texts += [f"plain prose number {i} about nothing at all" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    field = secrets_crf.fit(df)
    w, cats = secrets_crf.tokens(pa.array(texts))
    tags = field.decode(w.row, cats)
    scores = field.scores(cats)
    for r in range(len(texts)):
        own = w.row == r
        assert (field.viterbi(scores[own]) == tags[own]).all()
        assert (tags[own] == secrets_crf.B).any() == (r < 30)
    masked = {r.doc_id: r.text for r in secrets_crf.mask(df, field).collect()}
    assert all("[SECRET]" in masked[i] and key[i:] not in masked[i] for i in range(30))
    assert all(masked[i] == texts[i] for i in range(30, 60))


def test_windows_come_from_all_sampled_texts(monkeypatch):
    """The bound on windows does not prefer texts that come first."""
    secret = ' password = "9f3b7c1d2e4a5f60718293a4"'
    texts = [f"plain prose number {i} about nothing{secret * (i >= 100)}" for i in range(200)]
    every = secrets_crf.training_windows(texts)
    monkeypatch.setattr(secrets_crf, "WINDOWS", len(every) // 4)
    same = lambda got: sorted((c.tobytes(), t.tobytes()) for c, t in got)
    some = secrets_crf.training_windows(texts)
    assert len(some) == len(every) // 4 and same(some) == same(secrets_crf.training_windows(texts[::-1]))
    assert any((tags == secrets_crf.B).any() for _, tags in some)
