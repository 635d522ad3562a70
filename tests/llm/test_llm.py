"""The corpus operators: brute force, edge rows, round trips."""

import hashlib
import json
import random
import re

import brute
import numpy as np
import pytest
from answerloom.llm import (
    decontaminate, forest, imatch, langid, licenses, lines, mixing, queries, sharding, suffixes, warc)
from answerloom.llm.common import read, settle
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def spark(spark):
    return settle(spark)


def frame(spark, texts, first=0, sources=None):
    rows = [(first + i, t, "en", (sources or ["a", None, "b"])[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def edge(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "same text of some length here", "en", "a", 29),
        (3, "same text of some length here", "en", "a", 29), (None, "no id at all in this one", "de", "b", 24),
        (5, long, "en", "a", len(long)), (6, "\n\n \t\n", "en", "b", 5), (7, "É Ü ß ΑΒΓ", "fr", "c", 9), (8, "12 34 !!", "en", "c", 8),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("mine") for c in ("shard", "size", "rank", "hash", "pos", "kept", "score", "node", "label", "draws")})


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


# ------------------------------------------------------------------ sharding

@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2), (3, 5), (1, 6)])
def test_hilbert_curve_visits_neighbours(n, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    index = sharding.hilbert_index(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    assert np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1).max() == 1


def test_shards_have_equal_counts_and_gapless_slots(spark, sf):
    rows = sharding.hilbert_shards(read(spark, sf, "documents"), 7).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    counts = [len(v) for v in by.values()]
    assert set(by) == set(range(7)) and max(counts) - min(counts) <= 1
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in rows)


def test_long_common_prefixes_still_prune(spark):
    rng = random.Random(3)
    rows = [(i, "t" * (i % 50), "en", f"https://{rng.choice('abcd')}.example.org/path", i % 50) for i in range(400)]
    rows += [(1000 + i, "t", "en", "https://e.example.org/path", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    placed = sharding.hilbert_shards(docs, 4, ["source"], carry=["source"]).collect()
    assert max(len({r.shard for r in placed if r.source == s}) for s in {r.source for r in placed}) <= 2
    ordered = sorted(placed, key=lambda r: r["rank"])
    assert [r.source for r in ordered] == sorted(r.source for r in placed)


def test_shards_against_plain_code(spark):
    """Curve and shards worked out again from bins by sorting."""
    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(40), rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "c", None]), rng.randrange(5)) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in sharding.hilbert_shards(docs, 5, ["source", "lang"], bits=3).collect()}

    def bins(values):
        order = sorted(values, key=lambda v: (v is not None, v or ""))
        return {v: order.index(v) * 8 // len(values) for v in set(values)}

    source, lang = bins([r[3] for r in rows]), bins([r[2] for r in rows])
    cells = np.array([[source[r[3]], lang[r[2]]] for r in rows])
    curve = sharding.hilbert_index(cells, 3)
    assert [got[r[0]].curve for r in rows] == curve.tolist()
    ranked = sorted(got.values(), key=lambda r: r["rank"])
    assert [r.shard for r in ranked] == [i * 5 // 300 for i in range(300)]
    assert [r.curve for r in ranked] == sorted(curve.tolist())


def test_shards_of_edge_rows(spark, tmp_path):
    docs = edge(spark)
    placed = sharding.hilbert_shards(docs, 4, carry=["lang", "source", "n_chars"])
    rows = placed.collect()
    assert len(rows) == 9 and {r.size for r in rows if r.doc_id == 1} == {1}
    assert sharding.hilbert_shards(docs.limit(0), 4).count() == 0
    sharding.write_shards(placed, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 9
    assert sum(r["rows"] for r in sharding.manifest(placed).collect()) == 9


# ------------------------------------------------------------ decontamination

def test_decontamination_of_edge_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, "!!"), (3, "one two"), (4, "Same text of SOME length, here"), (None, "id at all in")], "item_id bigint, text string")
    rows = decontaminate.hits(edge(spark), bench).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in rows}
    assert got[3] == (6, 6, ["4"]) and got[1] == (0, 0, []) and got[None][1] == 4 and got[7][0] == 4
    assert decontaminate.hits(edge(spark).limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.hits(edge(spark), bench.limit(0)).collect()} == {0}


def test_a_short_item_leaves_the_shingles_of_others_alone(spark, tmp_path):
    rng = random.Random(8)
    words = vocabulary(8, 300)
    items = [prose(rng, words, 20) for _ in range(30)]
    texts = [prose(rng, words, 120) for _ in range(80)] + [f"{prose(rng, words, 30)} {i} {prose(rng, words, 9)}" for i in items[:10]]
    texts.append("Some RareWord here, and rareword.")
    rows = [(i, t) for i, t in enumerate(items)]
    alone = decontaminate.item_windows(spark.createDataFrame(rows, "item_id bigint, text string"), 10)
    both = spark.createDataFrame([*rows, (90, "rareword"), (91, "two words"), (92, None), (93, "...")], "item_id bigint, text string")
    assert {r.k for r in alone.collect()} == {4} and sorted({r.k for r in decontaminate.item_windows(both, 10).collect()}) == [1, 2, 4]
    got = {r.doc_id: r for r in decontaminate.hits(frame(spark, texts), both).collect()}
    assert got[90].items == ["90"] and got[90].n_hit == 2
    for i, text in enumerate(texts[:90]):
        flat = f" {' '.join(re.findall('[a-z0-9]+', text.lower()))} "
        want = {n for n, item in enumerate(items) if any(f" {' '.join(item.split()[a:a + 10])} " in flat for a in range(11))}
        assert got[i].items == sorted(map(str, want))


def test_decontamination_against_plain_code(spark):
    rng, words = random.Random(3), vocabulary(3, 6)
    docs = [prose(rng, words, rng.randint(0, 60)) for _ in range(60)]
    items = [prose(rng, words, rng.choice([2, 3, 9, 10, 11])) for _ in range(12)]
    got = {r.doc_id: (r.n_hit, r.items) for r in decontaminate.hits(
        frame(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"), 4).collect()}
    for i, d in enumerate(docs):
        w, hit, names = d.split(), set(), set()
        for j, item in enumerate(items):
            v = item.split()
            for a in range(max(1, len(v) - 3)):
                win = v[a:a + 4]
                for at in range(len(w) - len(win) + 1):
                    if w[at:at + len(win)] == win:
                        hit |= set(range(at, at + len(win)))
                        names.add(str(j))
        assert got[i] == (len(hit), sorted(names))


# ------------------------------------------------------------------ lines

def test_lines_of_edge_rows(spark):
    rows = lines.dedup_lines(edge(spark), carry=["kept", "lang"]).collect()
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in rows}
    assert len(rows) == 9 and got[1] == (1, 0) and got[2] == (1, 0) and got[6] == (4, 0)
    assert got[3] == (1, 0)  # the same doc_id twice is one document
    assert lines.dedup_lines(edge(spark).limit(0)).count() == 0


@pytest.mark.parametrize("max_bits", [1 << 19, 1 << 26])
def test_crowded_filters_change_nothing(spark, max_bits):
    rng = random.Random(5)
    pool = ["line number %d of the pool" % i for i in range(60)]
    texts = ["\n".join(rng.choice(["  %s\t", "%s", "%s\r"]) % rng.choice(pool).upper() for _ in range(rng.randint(1, 9))) for _ in range(80)]
    first = {}
    for i, t in enumerate(texts):
        for line in t.split("\n"):
            first.setdefault(line.strip().lower(), set()).add(i)
    got = {r.doc_id: r.kept_text for r in lines.dedup_lines(frame(spark, texts), max_bits=max_bits).collect()}
    for i, t in enumerate(texts):
        assert got[i] == "\n".join(x for x in t.split("\n") if min(first[x.strip().lower()]) == i)


# ------------------------------------------------------------- language

def test_language_of_held_out_documents(spark, sf):
    docs = read(spark, sf, "documents").select("*", langid.held_out().alias("_out"))
    learned = langid.train(docs.filter("not _out"))
    rows = langid.classify(docs.filter("_out"), learned, carry=["lang"]).collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert right >= 0.97 * len(rows) and sum(r.rejected for r in rows) <= 0.02 * len(rows)


def test_language_of_edge_rows(spark):
    learned = langid.train(edge(spark))
    got = {r.doc_id: r for r in langid.classify(edge(spark), learned, carry=["score", "kept"]).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[6].lang_pred == got[8].lang_pred == "und" and got[1].rejected
    assert got[7].lang_pred != "und" and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.classify(edge(spark), {}).collect()} == {"und"}
    assert langid.train(edge(spark).limit(0)) == {} and langid.classify(edge(spark).limit(0), learned).count() == 0


# ------------------------------------------------------------------ WARC

def test_warc_records_and_keys():
    raw = warc.pack_record(-4, "http://A.example.org/x?y=1#z", b"<p>\r\n\r\n</p>", "d" * 64, None, None)
    head, payload = warc.parse_record(raw)
    assert payload == b"<p>\r\n\r\n</p>" and warc.page_of(head["WARC-Record-ID"]) == -4
    assert warc.url_key("http://A.example.org:80/x?y=1#z") == "org,example,a)/x?y=1"
    assert warc.page_of(warc.record_id(None)) is None
    keys = [warc.capture_key("u.org", i) for i in (-5, -1, 0, 7, 1 << 40, None)]
    assert keys == sorted(keys)


def test_warc_round_trip_of_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    body = "<p>" + "x" * 200 + "é</p>"
    rows = [(i, f"http://h{i % 2}.org/{i}", body) for i in range(20)] + [
        (None, "http://h.org/null", body), (100, None, None), (101, "", ""), (102, "not a url [", "short"), (103, "http://[bad", "short"),
        (104, "http://h.org/a b\nc", body + "!"), (105, "http://h.org/twice", "twice"), (105, "http://h.org/twice", "twice")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("mine"))
    got = sorted(((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.round_trip(spark, pages).collect()), key=str)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        revisit = html == body and page != 0
        want.append((page is None, page or 0, "revisit" if revisit else "response", 0 if revisit else None, len(raw), hashlib.sha256(raw).hexdigest()))
    assert got == sorted(want, key=str)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


# ----------------------------------------------------------- fingerprints

def test_fingerprints_of_edge_rows(spark):
    docs = edge(spark)
    rows = imatch.fingerprints(docs, low=0.0, high=1.0).collect()
    assert len(rows) == 9
    got = [r for r in rows if r.doc_id == 3]
    assert got[0].fingerprint == got[1].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert imatch.fingerprints(docs.limit(0)).count() == 0
    (one,) = imatch.fingerprints(docs.filter("doc_id = 7")).collect()
    assert one.near_next == 1.0 and one.n_chars == 9


def test_edited_texts_and_likeness(spark, sf):
    docs = read(spark, sf, "documents")
    text = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), reverse=True)
    rows = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    for i, (doc, t) in enumerate(text):
        k = len(t) // 3
        edited = t[:len(t) - k] + text[(i + 1) % len(text)][1][:k]
        assert rows[doc].n_chars == len(t) and rows[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    prints = {}
    for doc, t in text:
        assert prints.setdefault(t, rows[doc].fingerprint) == rows[doc].fingerprint
    assert np.mean([r.near_edited for r in rows.values()]) > 5 * np.mean([r.near_next for r in rows.values()])


def test_copies_keep_their_terms_and_edits_stay_alike(spark):
    rng, words = random.Random(3), vocabulary(3)
    texts = [prose(rng, words, 60) for _ in range(200)]
    hot = "crowd " + " ".join(f"hot{i}" for i in range(60))
    docs = frame(spark, texts + [hot] * 100)
    band = {r.term for r in imatch.lexicon(docs, imatch.LOW, imatch.HIGH).collect()}
    wanted = {r.t for r in spark.createDataFrame([(hot,)], "text string").select(F.explode(imatch.terms(F.col("text"))).alias("t")).collect()}
    # One text of 201: under LOW, over HIGH if its copies counted; a wider band shows which.
    wide = {r.term for r in imatch.lexicon(docs, 0.001, imatch.HIGH).collect()}
    assert wanted <= wide and band <= wide
    # A third of all rows, each with its own edit: no distinct text to fold, its words are over the band.
    near = [hot + f" edit{i}" for i in range(100)]
    rows = {r.doc_id: r for r in imatch.fingerprints(frame(spark, texts + near)).collect()}
    assert all(rows[i].near_next > 0.5 for i in range(201, 300))
    # The edit drops a third of their terms; all are nearly the same draw, which comes out at 1 of 12 subsets.
    assert sum(rows[i].near_edited > 0 for i in range(201, 300)) > 90
    assert np.mean([rows[i].near_next for i in range(1, 200)]) < 0.2


# ------------------------------------------------------------- suffixes

def _suffix_results(df):
    return {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize("batches,few", [(1, 4096), (3, 4096), (4, 1)])
def test_repeats_against_plain_code(spark, monkeypatch, batches, few):
    monkeypatch.setattr(suffixes, "FEW_CONTEXTS", few)
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    rng, words = random.Random(8), vocabulary(8)
    passages = [prose(rng, words, 30) for _ in range(4)] + ["ab" * 90, "é" * 60]
    texts = []
    for _ in range(40):
        parts = [prose(rng, words, rng.randint(0, 20)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.randint(0, 25)
            parts.insert(rng.randint(0, len(parts)), p[cut:])
        texts.append("".join(parts))
    texts += [texts[0], None, "", "x" * 500]
    got = _suffix_results(suffixes.drop_repeats(frame(spark, texts), window=60, gram=16, batches=batches))
    assert [got[i] for i in range(len(texts))] == brute.repeats(texts, 60)


def test_repeats_of_edge_rows(spark):
    rows = suffixes.drop_repeats(edge(spark), carry=["kept", "lang"]).collect()
    got = {r.doc_id: (r.n_bytes, len(r.kept)) for r in rows}
    assert len(rows) == 9 and got[1] == (0, 0) and got[3] == (29, 29) and got[5][1] < got[5][0]
    assert suffixes.drop_repeats(edge(spark).limit(0)).count() == 0


def test_levels_grow_geometrically(spark):
    texts = frame(spark, ["word " * 100] * 9).select(F.col("doc_id").alias("doc"), F.encode("text", "utf-8").alias("raw"))
    family = suffixes.Family()
    for i in range(7):
        family.add(suffixes.anchors(texts.filter(f"doc = {i}"), 60, 16))
        assert sorted(family.levels) == [r for r in range(3) if (i + 1) >> r & 1]


# -------------------------------------------------------------- licenses

def test_base_places_against_plain_code(spark, sf):
    docs = read(spark, sf, "documents")
    hits, _ = licenses.scan(docs)
    got = {r.doc_id: r for r in hits.collect()}
    for r in docs.collect():
        text = (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places = brute.phrase_places(w, licenses.PHRASES)
        at = sorted(x for v in places.values() for x in v)
        h = got[r.doc_id]
        assert (h.n_words, h.n_base, h.base_labels) == (len(w), len(at), ",".join(sorted(places)))
        assert (h.first_word, h.last_word) == ((at[0], at[-1]) if at else (None, None))


def test_templates_with_edits_and_edge_rows(spark):
    texts = [
        "Start. Licensed under the Apache License, Version 2.0. End", "licensed under the new apache license version 2 0",
        "apache things under the version", "cc by cc by cc BY", "all rights reserved. All rights, reserved", None, "", "x"]
    hits, spans = licenses.scan(frame(spark, texts))
    got = {r.doc_id: (r.n_base, r.labels, round(r.score, 2)) for r in hits.collect()}
    assert got[0] == (0, "apache-2.0", 1.0) and got[1][1] == "apache-2.0" and got[2] == (0, "", 0.0)
    assert got[3][:2] == (3, "cc-by") and got[4][:2] == (2, "reserved") and got[5] == got[6] == got[7] == (0, "", 0.0)
    assert {(r["first"], r["last"]) for r in spans.filter("doc_id = 0 and not exact").collect()} == {(1, 8)}
    rows = licenses.scan(edge(spark))[0].collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, None, 5, 6, 7, 8}
    assert licenses.scan(edge(spark).limit(0))[0].count() == 0


# ---------------------------------------------------------------- forest

def near_texts(seed, groups=12, star=True):
    """Groups of edited copies; with ``star``, copies that are alike only to their centre."""
    rng, words = random.Random(seed), vocabulary(seed, 3000)
    texts = []
    for _ in range(groups):
        base = prose(rng, words, rng.randint(60, 200)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            w = list(base)
            for _ in range(max(1, len(w) // (18 if star else 60))):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    texts += texts[:3] + [None, "", "  \t", "One", "one", "two words", "Two Words"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,block", [(1, 1 << 17), (2, 300)])
def test_components_against_plain_code(spark, seed, block):
    texts = near_texts(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in forest.near_duplicates(frame(spark, texts), k=2, block_shingles=block).collect()}
    sets = brute.shingle_sets(texts, 2)
    want = brute.components(sets)
    assert len(set(want)) < len(texts)
    assert got == {i: (len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, want))}


def test_crowded_region_goes_deeper(spark):
    texts = near_texts(4, groups=3)
    few = {r.doc_id: r.component_id for r in forest.near_duplicates(frame(spark, texts), k=2, reach=3).collect()}
    assert few == dict(enumerate(brute.components(brute.shingle_sets(texts, 2))))


def test_forest_of_edge_rows(spark):
    rows = forest.near_duplicates(edge(spark)).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert len(rows) == 9 and got[1] == (0, 1, True) and got[None] == (3, None, True) and got[3] == (2, 3, True)
    assert forest.near_duplicates(edge(spark).limit(0)).count() == 0


def test_words_put_into_a_statement_keep_its_label(spark):
    texts = [
        "Released under the terms of the MIT License.",
        "This work is licensed under the terms of the GNU General Public License, version 3.",
        "Nothing but the plain terms of a holiday by the sea.",
    ]
    rows = sorted(licenses.scan(frame(spark, texts))[0].collect(), key=lambda r: r.doc_id)
    assert rows[0].labels == "mit" and "gpl-3.0" in rows[1].labels.split(",") and rows[2].labels == ""


def test_more_languages_than_allowed_are_an_error(spark):
    rows = [(i, "some text", f"l{i}", "a", 9) for i in range(4)]
    with pytest.raises(ValueError, match="max_languages"):
        langid.train(spark.createDataFrame(rows, DOCS), max_languages=3)
    assert len(langid.train(spark.createDataFrame(rows, DOCS), max_languages=4)) == 4


# ---------------------------------------------------------------- mixing

def test_hypergeometric_draws_follow_the_law(spark):
    n, m, d = 60, 25, 30
    df = spark.range(20_000).select(mixing.hypergeometric(
        F.lit(n), F.lit(m), F.lit(d), F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") / float(1 << 53)).alias("x"))
    x = np.array([r.x for r in df.collect()])
    assert x.min() >= max(0, d - (n - m)) and x.max() <= min(m, d)
    mean, var = d * m / n, d * (m / n) * (1 - m / n) * (n - d) / (n - 1)
    assert abs(x.mean() - mean) < 5 * (var / len(x)) ** 0.5 and abs(x.var() / var - 1) < 0.1


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_quotas_are_exact_and_disjoint(spark, shards):
    counts = {"a": 1000, "b": 7, None: 0, "c": 331}
    df = spark.createDataFrame([(k, v) for k, v in counts.items()], "source string, blocks bigint")
    rows = mixing.split_quotas(df, shards, 5).collect()
    total = sum(counts.values())
    for s, n in counts.items():
        own = sorted((r.from_block, r.to_block) for r in rows if r.source == s)
        assert own[0][0] == 0 and max(b for _, b in own) == n and all(x[1] == y[0] for x, y in zip(own, own[1:]))
    for j in range(shards):
        assert sum(r.to_block - r.from_block for r in rows if r.shard == j) == (j + 1) * total // shards - j * total // shards


def test_mix_of_edge_rows_and_reruns(spark, tmp_path):
    docs = edge(spark)
    once, again = ([tuple(r) for r in mixing.mix(docs).orderBy("doc_id", "size").collect()] for _ in range(2))
    assert once == again and len(once) == 9
    rows = mixing.taken(mixing.mix(docs)).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target) and all(r.taken <= 2 * r["size"] for r in own)
        places = sorted((d.epoch, r.doc_id or 0, d.from_word, d.words) for r in own for d in r.draws)
        assert len(places) == len({p[:3] for p in places}) or any(r.doc_id == 3 for r in own)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.copies(docs).columns == docs.columns
    mixing.write_shards(mixing.mix(docs), str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).agg(F.sum("words")).first()[0] == sum(r.taken for r in rows)


# -------------------------------------------------------------- pipeline

def test_pipeline_against_plain_steps(spark, sf):
    import corpus_pipeline as p

    docs = read(spark, sf, "documents")
    kept = p.language(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() >= 0.95 * docs.count()
    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    groups = brute.components(brute.shingle_sets([r.text for r in rows], 5))
    single = p.near_dedup(spark, kept, sf)
    assert sorted(r.doc_id for r in single.collect()) == [r.doc_id for i, r in enumerate(rows) if groups[i] == i]
    bad = {r.doc_id for r in decontaminate.hits(single, read(spark, sf, "benchmark")).filter("contaminated").collect()}
    clean = p.decontamination(spark, single, sf)
    assert bad and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - bad
    mixed = p.mixture(spark, clean, sf)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    out = p.shards(spark, mixed, sf).groupBy("shard").count().collect()
    assert sum(r["count"] for r in out) == mixed.count() and max(r["count"] for r in out) - min(r["count"] for r in out) <= 1


def test_pipeline_stages_take_edge_rows(spark, sf):
    import corpus_pipeline as p

    for docs in (edge(spark), edge(spark).limit(0)):
        for name, step in p.STAGES:
            out = step(spark, docs, sf)
            assert name == "shards" or out.columns == docs.columns
            out.collect()


def test_pipeline_runs_on_clashing_columns_and_unclear_ids(spark, sf, tmp_path):
    import corpus_pipeline as p

    rows = read(spark, sf, "documents").filter("n_chars > 200").orderBy("doc_id").limit(60).collect()
    given = [(None if i < 5 else 7 if i < 8 else r.doc_id + 1000, r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(rows)]
    given += [given[3], (5, given[9][1], "en", "a", 1), (4, given[9][1] + " end", "en", "a", 1)]
    clash = ("shard", "slot", "_text", "_row", "_number", "doc_slot", "component_id")
    docs = spark.createDataFrame(given, DOCS).withColumns({c: F.concat(F.lit(f"{c} "), F.col("text")) for c in clash})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    read(spark, sf, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    single = p.near_dedup(spark, read(spark, str(tmp_path), "documents"), str(tmp_path))
    groups = brute.components(brute.shingle_sets([r[1] for r in given], 5))
    kept = single.collect()
    assert single.columns == docs.columns and len(kept) == len(set(groups)) and len({r.text for r in kept}) == len(kept)
    assert {4} <= {r.doc_id for r in kept} and 5 not in {r.doc_id for r in kept}
    out = p.run(spark, str(tmp_path))
    assert out.columns == ["doc_shard" if c == "shard" else "doc_slot_" if c == "slot" else c for c in docs.columns] + ["shard", "slot"]
    got = out.collect()
    assert got and {r.text for r in got} <= {r.text for r in kept}
    for r in got:
        assert all(r[to] == f"{c} {r.text}" for c, to in zip(clash, ["doc_shard", "doc_slot_", *clash[2:]]))
    assert sorted(r.slot for r in got if r.shard == 0) == list(range(sum(r.shard == 0 for r in got)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_have_the_agreed_columns(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    table, key = {
        "op5": ("pages", "page_id"), "op11": ("conversations", "conv_id"), "op12": ("embeddings", "vec_id"), "op13": ("embeddings", "anchor_id"),
    }.get(name.split("_")[0], ("documents", "doc_id"))
    if key == "conv_id":
        assert df.count() == read(spark, sf, table).select(key).distinct().count()
    elif key != "anchor_id":
        assert df.count() == read(spark, sf, table).count()
    assert json.loads(df.schema.json())["fields"][0]["name"] == key


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_groups_by_contraction(spark, shape):
    from answerloom.llm.components import components

    rng = random.Random(6)
    links = {
        "path": [(i, i + 1) for i in range(300)], "star": [(0, i) for i in range(1, 200)] + [(7, 7)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)], "none": [],
    }[shape]
    label = {x: x for e in links if e[0] != e[1] for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    got = {r.id: r.group_id for r in components(spark.createDataFrame(links, "src bigint, dst bigint")).collect()}
    assert got == label
