"""Periodic runs, ranked search and language identification against brute force, planted cases and held-out rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import ball_search, exact_dedup, language_id, periodic, queries

SCHEMA = "doc_id long, text string"


def all_runs(words, least=12):
    """Every stretch for every shift; the smallest shift of equal stretches."""
    out = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - p:
            x = i
            while i < len(words) - p and words[i] == words[i + p]:
                i += 1
            if i > x and i - x + p >= max(least, 2 * p):
                out.setdefault((x, i + p), p)
            i += 1
    return sorted((a, b, p) for (a, b), p in out.items())


def words_at_random(rng, longest=100):
    n, k = rng.randrange(longest), rng.choice([1, 2, 2, 3, 6])
    w = [rng.randrange(k) for _ in range(n)]
    if n > 5 and rng.random() < 0.5:
        a, p = rng.randrange(n), 1 + rng.randrange(n // 2 + 1)
        w[a:] = [w[a + (i - a) % p] for i in range(a, n)]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_in_one_go_and_word_by_word(seed):
    rng = random.Random(seed)
    for _ in range(150):
        w, least = words_at_random(rng), rng.choice([10, 12, 15])
        told = all_runs(w, least)
        assert [tuple(r) for r in periodic.runs_of(np.array(w, np.int64), least).tolist()] == told
        state, i = periodic.Catchers(least), 0
        while i < len(w):
            step = rng.choice([1, 1, 3, 17])
            state.append(np.array(w[i : i + step], np.int64))
            i += step
        assert [tuple(r) for r in state.runs().tolist()] == told


def test_squares_are_reported_when_they_are_complete():
    state = periodic.Catchers(12)
    seen = [state.append(np.array([i % 7])).tolist() for i in range(20)]
    assert all(not s for s in seen[:13]) and [0, 14, 7] in seen[13] and [0, 20, 7] in seen[19]


def test_many_equal_words_and_long_periods():
    assert periodic.runs_of(np.zeros(100_000, np.int64)).tolist() == [[0, 100_000, 1]]
    w = np.random.default_rng(3).integers(0, 1 << 20, 40_000)
    assert periodic.runs_of(np.concatenate([w, w, w[:11]])).tolist() == [[0, 80_011, 40_000]]
    assert periodic.runs_of(np.zeros(0, np.int64)).tolist() == []


def test_runs_of_rows(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{x}" for x in words_at_random(rng)) for _ in range(60)] + [None, "", " \t\n", "é " * 30, "a\x0bb " * 9, "x\x1cy " * 12, "same " * 20, "same " * 20]
    rows = [(i if i != 5 else None, t, 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, `runs.start` int").repartition(3)
    got = {(r["doc_id"], r["n_words"], r["collapsed"]): [tuple(x) for x in r["runs"]] for r in periodic.find_runs(df).collect()}
    for i, t in enumerate(texts):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        runs = all_runs(w)
        gone = {i for a, b, p in runs for i in range(a + p, b)}
        assert got[(i if i != 5 else None, len(w), " ".join(x for i, x in enumerate(w) if i not in gone))] == [(a, b - a, p) for a, b, p in runs]
    assert periodic.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        periodic.Catchers(5)


def test_tails_are_repeated_for_a_tenth_of_the_ids(spark):
    import zlib

    text = " ".join(f"w{i}" for i in range(50))
    rows = queries.tails_repeated(spark.createDataFrame([(i, text) for i in range(60)] + [(60, None), (61, ""), (None, text)], SCHEMA)).collect()
    for doc, got in rows:
        h, w = zlib.crc32(str(doc).encode()), text.split()
        want = {60: None, 61: ""}.get(doc, text)
        if doc is not None and doc < 60 and h % 10 == 0:
            g = h // 10
            a = g % 50
            p = 1 + (50 - a) // (3 + g % 8)
            want = " ".join(w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w))
        assert got == want


def ranking(docs, items, k=10):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    of = [(i, Counter(terms(t))) for i, t in docs]
    of = [(i, c) for i, c in of if c]
    total, length = len(of), sum(sum(c.values()) for _, c in of)
    out = []
    for item, text in items:
        scores = []
        for i, c in of:
            m = 10 + (90 * sum(c.values()) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * sum(t in x for _, x in of) + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_ranking_is_exact(spark, monkeypatch):
    """Ties, few and many terms, several trees a task and several blocks of queries."""
    monkeypatch.setattr(ball_search, "TREE", 16)
    rng = random.Random(5)
    word = lambda: rng.choice(["Alpha", "beta", "été", "x1", "漢字", "rare%d" % rng.randrange(60), "w%d" % rng.randrange(8)])
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 25)))) for i in range(150)]
    docs += [(200 + i, "beta x1 beta") for i in range(15)] + [(300, None), (301, ""), (302, "!? .")]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 9)))) for i in range(20)] + [(50, None), (51, "..."), (52, "nowhere"), (53, "beta"), (54, "BETA, beta_x1")]
    d, q = (spark.createDataFrame(x, s).repartition(3) for x, s in ((docs, SCHEMA), (items, "item_id long, text string")))
    want = ranking(docs, items)
    assert sorted(map(tuple, ball_search.search(d, q).rows.collect()), key=str) == want
    monkeypatch.setattr(ball_search, "ITEMS", 7)
    found = ball_search.search(d, q)
    assert sorted(map(tuple, found.rows.collect()), key=str) == want
    work = found.work.agg(F.sum("scored"), F.sum("documents")).first()
    assert 0 < work[0] < work[1]  # some subtrees were left out


def test_ranking_of_nothing_and_of_odd_columns(spark):
    d = spark.createDataFrame([("b", "x y", 1), ("a", "x y", 2), (None, "x y", 3), ("a", "y", 4)], "doc_id string, text string, `id.x` int")
    q = spark.createDataFrame([(1, "x", 5)], "item_id int, text string, score int")
    assert [tuple(r)[:3] for r in sorted(ball_search.search(d, q).rows.collect(), key=lambda r: r["rank"])] == [(1, 1, "a"), (1, 2, "b"), (1, 3, None)]
    assert ball_search.search(d.limit(0), q).rows.collect() == [] and ball_search.search(d, q.limit(0)).rows.collect() == []
    assert ball_search.search(d, q.limit(0)).work.columns == ["item_id", "scored", "documents"]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    rows = np.where(rng.random((200, 60)) < 0.1, rng.integers(1, 10**9, (200, 60)), 0)
    tree, q = ball_search.Tree(rows), (rng.random((60, 9)) < 0.2).astype(float)
    scores, bounds = rows @ q.astype(int), tree.bounds(q)
    for (a, b), bound in zip(tree.members, bounds):
        assert (scores[tree.order[a:b]].max(axis=0) <= bound).all()


def test_codes_part_all_languages():
    for k in (2, 3, 4, 7, 8, 30):
        c = language_id.code(k).astype(int)
        assert c.shape[0] == k and (np.abs(c.sum(axis=0)) < k).all()
        apart = (c.shape[1] - c @ c.T) // 2
        assert (apart + k * np.eye(k, dtype=int) * 99).min() >= (1 if k == 2 else 2)
    assert language_id.code(0).shape == (0, 1) and language_id.code(1).shape == (1, 1)


def test_held_out_languages(spark, sf_dir):
    rows = queries.op13_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 200 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_predictions_read_texts_only(spark):
    texts = {"en": "the quick brown fox and the lazy dog", "fr": "le renard brun et le chien paresseux", "de": "der schnelle braune fuchs und der hund"}
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts.items())] + [(7, None, "en"), (8, "12 34!", "fr"), (9, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.languages == ("de", "en", "fr") and model.code.shape == (3, 3)
    asked = [(1, "The dog", "fr", "a"), (1, "le chien", "en", "b"), (None, "DER HUND", None, "c"), (4, None, "en", "d"), (5, "  7 _ ", "en", "e"), (6, "", "en", "f"), (7, "漢", "en", "g"), (8, "fuchs " * 400_000, "en", "h")]
    out = language_id.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string, `lang.pred` string"), model, F.col("doc_id"), F.col("`lang.pred`").alias("k")).collect()
    got = {r["k"]: (r["lang_pred"], r["score"]) for r in out}
    assert [got[k][0] for k in "abcdef"] == ["en", "fr", "de", "und", "und", "und"] and got["d"][1] == 0.0 and got["h"][0] == "de"
    assert got["g"][0] in model.languages and next(r for r in out if r["k"] == "g")["ambiguous"]
    one = language_id.fit(df.filter("lang = 'en'"))
    assert [r["lang_pred"] for r in language_id.identify(df, one, F.col("doc_id")).orderBy("doc_id").collect()] == ["en", "en", "en", "und", "und", "und"]
    none = language_id.fit(df.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(df, none, F.col("doc_id")).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model, F.col("doc_id")).count() == 0


def test_margins_do_not_depend_on_company():
    share = np.random.default_rng(1).normal(size=(language_id.BUCKETS, 3))
    model = language_id.Model(("a", "b", "c"), share, language_id.code(3), np.ones((3, 3)) / 3)
    texts = [b"one two", b"", b"three " * 90_000, "née".encode(), b"x"]
    together = model.margins(texts)
    assert np.allclose(together, np.concatenate([model.margins([t]) for t in texts]))


def test_dedup_keeps_columns_of_any_name(spark):
    rows = [(1, "a  b", "x", 7, 1), (2, "a b", "y", 8, 2), (3, "c", "z", 9, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _file string, _ROW int, `a.b` int")
    assert sorted(map(tuple, exact_dedup.keep_first(df).collect())) == [rows[0], rows[2]]
    decisions, content = exact_dedup.exact_dedup(df)
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in decisions.collect()) == [(1, 1, True), (2, 1, False), (3, 3, True)]
    assert content.columns == [*df.columns, "__file", "__row"]
