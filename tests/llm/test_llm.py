"""The training-data operators against plain Python on small tables, with nulls, empty texts, ties and repeated rows."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from palisade.llm import bpe, exact_dedup, licenses, line_dedup, neighbours, packing, quality, simhash, substring_dedup, url_filter
from palisade.llm._shared import Scratch
from palisade.llm.components import components

TEXTS = [
    (1, "The cat sat on the mat and the dog lay by the door of the old house"), (2, "The cat  sat on the mat and the dog lay by the door of the old house"), (3, None), (4, ""), (5, " \t\n"), (6, "é漢😀 \x1c x\x85y <|endoftext|>"),
    (7, "a " * 300), (8, "one\nTwo\n\n one \none"), (9, "x" * 5000), (10, "The cat sat on the mat and the dog lay by the door of the old house"), (10, "The cat sat on the mat and the dog lay by the door of the old house"), (None, "lost"), (11, "don't we'll  go\n  there 123abc"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", r[0]) for r in TEXTS], SCHEMA + ", keep_id string, row long")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 0)])
def test_exact_dedup(docs, digest):
    """Also with a digest that is the same for all texts, so that only their bytes tell them apart."""
    rows = exact_dedup.exact_dedup(docs, digest=digest, files_per_batch=1)[0].collect()
    import re

    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    expected = Counter((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows) == expected
    assert sum(r["kept"] for r in rows) == len(groups)


def test_keep_first_keeps_columns(docs):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == 9


def test_substrings(docs):
    for window in (35, 4, 1):
        count = Counter(tuple(w[i : i + window]) for _, t in TEXTS for w in [words(t)] for i in range(len(w) - window + 1))
        expected = []
        for i, t in TEXTS:
            w = words(t)
            gone = {k for s in range(len(w) - window + 1) if count[tuple(w[s : s + window])] > 1 for k in range(s, s + window)}
            expected.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
        rows = substring_dedup.remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", "kept").collect()
        assert Counter(map(tuple, rows)) == Counter(expected)


def test_substrings_in_extra_columns(docs):
    out = substring_dedup.strip_repeats(docs, 4)
    assert out.columns == docs.columns and out.count() == len(TEXTS)


def test_lines(spark):
    long = "A line that is surely longer than forty characters"
    rows = [(i, f"{long}\n  {long.upper()} \nown {i}") for i in range(6)] + [(6, long), (7, None), (8, "short\nshort")]
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.drop_common_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {i: (3, 2, f"own {i}") for i in range(6)} | {6: (1, 0, long), 7: (1, 0, ""), 8: (2, 0, "short\nshort")}


def test_line_runs_compact_and_tell_new_lines(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for b in range(5):
        batch = spark.createDataFrame([(b, 0, k, k) for k in range(b, b + 3)], "id long, pos int, h1 long, h2 long")
        assert {r["h1"] for r in line_dedup.drop_seen_lines(batch, runs).collect()} == (set(range(3)) if not b else {b + 2})
    assert sorted(level for level, names in runs.levels.items() if names) == [0, 2]
    assert {r["h1"]: r["documents"] for r in runs.known().collect()} == Counter(k for b in range(5) for k in range(b, b + 3))


def test_fingerprints(docs):
    def plain(text):
        w = (text or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    rows = simhash.fingerprints(docs).collect()
    assert Counter((r["doc_id"], r["fp0"] % 2**64) for r in rows) == Counter((i, plain(t)) for i, t in TEXTS)


def test_near_links_lose_nothing(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:30].tolist():
        for _ in range(12):
            b ^= int(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False)))
            fps.add(b)
    fps = np.array(sorted(fps), np.uint64)
    signed = fps.view(np.int64).tolist()
    parent = np.arange(len(fps))
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)
        simhash._root(parent, np.full(len(j), i), j)
    for chunk, blocks in ((2048, 5), (16, 6)):
        links = simhash.near_links(spark.createDataFrame([(x, x) for x in signed], "node long, fp0 long"), [simhash.Search(simhash.block_keys(4, blocks), 4)], chunk=chunk)
        own = np.arange(len(fps))
        at = {x: i for i, x in enumerate(signed)}
        rows = links.collect()
        simhash._root(own, np.array([at[r["u"]] for r in rows]), np.array([at[r["v"]] for r in rows]))
        assert (own == parent).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    rows = components(spark.createDataFrame(chain, "u long, v long"), Scratch(spark, "test")).collect()
    assert {r["node"]: r["root"] for r in rows} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_near_dedup_of_few(docs, none):
    rows = simhash.near_dedup(docs).collect()
    assert len(rows) == len(TEXTS) and {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 10)} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4, 5)} == {3}
    assert simhash.near_dedup(none).count() == 0 and simhash.keep_one(docs).columns == docs.columns


def test_keep_one_by_exact_similarity(spark):
    """Against all pairs: short texts, and similarities on both sides of the threshold, also chained."""
    rng, texts = np.random.default_rng(4), []
    some = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    for n in (1, 4, 5, 8, 9, 12, 19, 30, 60, 120, 400):
        for _ in range(12):
            base = some(n)
            texts.append(base)
            texts.append(base + some(1))
            texts.append(base + some(max(1, n // rng.integers(4, 9))))
            texts.append(base[max(1, n // 8) :] + some(max(1, n // 14)))
    line = some(12)  # common to many that have little else
    texts += [some(2) + line + some(k % 4) for k in range(60)] + [[], [], line]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} or ({tuple(t)} if t else set()) for t in texts]
    parent, at = np.arange(len(texts)), []
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 9 * len(x & y) >= 4 * (len(x) + len(y)):
                simhash._root(parent, np.array([i]), np.array([j]))
            at += [len(x & y) / len(x | y)] if x & y else []
    assert sum(0.65 <= s < 0.8 for s in at) > 20 and sum(0.8 <= s <= 0.85 for s in at) > 20
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in kept) == np.unique(parent).tolist()


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, reference):
    path, plain = reference
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN)
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in ids.collect()) == sorted((i or 0, plain.encode_ordinary(t or "")) for i, t in TEXTS)
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"])) for r in bpe.decode(ids, path).collect()) == sorted((i or 0, (t or "").encode()) for i, t in TEXTS)


def test_bpe_appends_and_edits(docs, reference, spark):
    path, plain = reference
    rng, letters = np.random.default_rng(5), list(" \n\t ab'sZ9,.é漢😀\r")
    some = lambda n: "".join(rng.choice(letters, n))
    vocabulary = bpe.Vocabulary.read(path)
    for _ in range(200):
        e = bpe.Encoding(vocabulary, public_tokenizers.PATTERN, some(20))
        a, b = sorted(rng.integers(0, 21, 2).tolist())
        text = e.text[:a] + (by := some(3)) + e.text[b:]
        e.replace(a, b, by)
        e.append(" more")
        assert e.ids == plain.encode_ordinary(text + " more")
    rows = [(i, t or "", plain.encode_ordinary(t or ""), some(4)) for i, t in TEXTS if i]
    out = bpe.append(spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, more string"), path, public_tokenizers.PATTERN).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in out) == sorted((i, plain.encode_ordinary(t + m)) for i, t, _, m in rows)


def test_packing(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, public_tokenizers.PATTERN, longest=64).withColumn("crc", F.crc32("ids")).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 for r in rows)
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        if r["doc_id"] in (1, 3, 6, 7, 9, 11):
            assert r["crc"] == zlib.crc32(bytes(r["ids"])) and sum(map(len, got[r["doc_id"]])) == r["start"]
            got[r["doc_id"]].append(np.frombuffer(bytes(r["ids"]), "<u4").tolist())
    texts = {i: t for i, t in TEXTS}
    assert {i: sum(x, []) for i, x in got.items()} == {i: [*plain.encode(texts[i] or "", add_special_tokens=False).ids, 1] for i in got}
    assert packing.pack(none, path, public_tokenizers.PATTERN).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(300)] + [(i, [1.0] * 16) for i in range(300, 320)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0] * 3), (None, [1.0] * 16), (404, [None] * 16), (5, rows[5][1])]
    out = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows[:320]}
    hit = total = 0
    for q in range(0, 320, 20):
        score = {i: v @ x[q] / np.linalg.norm(v) / np.linalg.norm(x[q]) for i, v in x.items() if i != q}
        best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and all(abs(score[i] - s) < 1e-9 for _, i, s in got)
        hit, total = hit + len({g[1] for g in got} & set(best)), total + 5
    assert len(out) == total and hit / total >= 0.9
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_neighbours_of_sibling_cells(spark, monkeypatch):
    """Cells deeper than the prefixes that queries ascend to, as in large tables: 7 bits against about 4."""
    monkeypatch.setattr(neighbours, "CELL", 32)
    x = np.random.default_rng(2).normal(size=(4000, 64))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(rows, F.col("vec_id") % 50 == 0).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[::50] @ unit.T
    near[np.arange(80), np.arange(0, 4000, 50)] = -2
    best = {(50 * q, int(i)) for q, row in enumerate(np.argsort(-near, axis=1)[:, :5]) for i in row}
    assert len(got) == len(best) == 400 and len(got & best) >= 0.9 * 400, len(got & best)


def test_url_lists(spark):
    ts = "timestamp_ntz"
    changes = spark.createDataFrame([("spam", "domain", "bad.test", 1, "add", False), ("spam", "domain", "bad.test", 5, "remove", False), ("ok", "host", "a.bad.test", 2, "add", True), ("p", "prefix", "x.test/en", 0, "add", False), (None, "host", "x.test", 0, "add", False)], "list string, kind string, value string, day int, action string, allow boolean")
    at = lambda df: df.withColumn("at", F.timestamp_add("DAY", F.col("day"), F.lit("2024-01-01").cast(ts)))
    pages = [(1, "http://w.bad.test/", 0), (2, "http://w.bad.test/", 1), (3, "https://u@A.BAD.test.:80/q", 3), (4, "http://bad.test", 5), (5, "http://x.test/en/1", 9), (6, "http://x.test/english", 9), (7, None, 1), (8, "nonsense", 1), (9, "http://w.bad.test/", None)]
    captures = at(spark.createDataFrame(pages, "page_id int, url string, day int")).withColumnRenamed("at", "fetched_at")
    out = {r["page_id"]: (r["accepted"], r["list"], r["n_entries"]) for r in url_filter.judge(captures, at(changes)).collect()}
    assert out == {1: (True, None, 0), 2: (False, "spam", 1), 3: (True, "ok", 2), 4: (True, None, 0), 5: (False, "p", 1), 6: (True, None, 0), 7: (True, None, 0), 8: (True, None, 0), 9: (True, None, 0)}


def test_licenses(spark):
    rows = [(1, "r/LICENSE", "Released under the MIT License."), (2, "r/a/b/c.py", "nothing"), (3, "r/a/h.py", "x\nLicensed under the Apache License, Version 2.0."), (4, "q/x.py", ""), (5, None, None), (6, "r/a/COPYING", "This work is licensed under the GNU General Public License, version 3."), (7, "r/a/b/d.py", None)]
    out = {r["doc_id"]: (r["license"], r["source"], r["declared_in"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert out == {1: ("MIT", "licence file", None), 2: ("GPL-3.0", "inherited", "r/a"), 3: ("Apache-2.0", "header", None), 4: (None, "none", None), 5: (None, "none", None), 6: ("GPL-3.0", "licence file", None), 7: ("GPL-3.0", "inherited", "r/a")}


def test_notices_belong_to_rows(spark):
    """Rows with one id, null ids, repeated rows, odd columns."""
    rows = [(1, "r/x", "Released under the MIT License."), (1, "r/y", "nothing"), (None, "q/z", "Released under the MIT License."), (None, None, None), (1, "r/x", "Released under the MIT License.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, path string, text string, `a.b` string, file int").repartition(2)
    out = sorted(((r["doc_id"], r["path"], r["license"], r["source"]) for r in licenses.scan(df).collect()), key=str)
    assert out == sorted([(1, "r/x", "MIT", "header")] * 2 + [(1, "r/y", None, "none"), (None, "q/z", "MIT", "header"), (None, None, None, "none")], key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_whole_licenses_headers_and_tags(spark):
    prose = [(100 + i, f"p/{i}.txt", f"word{i} of the work is under the {i} and in a version of it, with software to use") for i in range(40)]
    comment = lambda text, mark: "\n".join(f"{mark} {text[i : i + 70]}" for i in range(0, len(text), 70))
    mit = f"MIT License\n\nCopyright (c) 2020 Jane Roe\n\n{licenses.MIT_GRANT}\n\n{licenses.MIT_REST}\n"
    cases = [
        (1, "a/LICENSE", licenses.MIT_GRANT, "MIT"), (2, "b/x.c", "Copyright (c) 2020 X. Licensed under the MIT License.", "MIT"), (3, "c/x.py", "# SPDX-License-Identifier: MIT\nimport os", "MIT"), (4, "d/LICENSE.txt", mit, "MIT"),
        (5, "e/x.c", comment(licenses.GPL_HEADER.format(v=3), " *") + "\n\nint main() { return 0; }", "GPL-3.0"), (6, "f/x.c", "/*\n" + comment(licenses.GPL_HEADER.format(v=2), " *") + "\n */\nint x;", "GPL-2.0"),
        (7, "g/COPYING", f"Copyright 2001, 2003 Some Body\nAll rights reserved.\n\n{licenses.BSD_GRANT}\n\n{licenses.BSD_TWO}\n\n{licenses.BSD_THIRD}\n\n{licenses.BSD_REST}", "BSD-3-Clause"),
        (8, "h/LICENSE", f"Copyright 2001 Some Body\n\n{licenses.BSD_GRANT}\n\n{licenses.BSD_TWO}\n\n{licenses.BSD_REST}", "BSD-2-Clause"),
        (9, "i/x.java", "/*\n" + comment(licenses.APACHE_HEADER, " *") + "\n */\npackage x;", "Apache-2.0"), (10, "j/x.js", "// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), (11, "k/README", "The license of this work is not told here; see elsewhere.", None),
        (12, "l/x.h", comment(licenses.MPL_HEADER, "//"), "MPL-2.0"), (13, "m/LICENSE", f"ISC License\n\n{licenses.ISC_GRANT}\n\n{licenses.ISC_REST}", "ISC"), (14, "a/deep/er/file", "x", "MIT"),
    ]
    out = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame([c[:3] for c in cases] + prose, "doc_id long, path string, text string")).collect()}
    assert {c[0]: out[c[0]] for c in cases} == {c[0]: c[3] for c in cases}
    assert all(out[i] is None for i, _, _ in prose)


def test_needed_terms_lose_no_notice():
    vectors = {0: {"a": 3.0, "b": 2.0, "c": 1.0}, 1: {"b": 1.0, "c": 1.0, "d": 1.0}, 2: {"e": 1.0}}
    gate = licenses.needed(vectors, 0.7, {"b": 9})
    for v in vectors.values():
        without = {t: w for t, w in v.items() if t not in gate}
        assert sum(w * w for w in without.values()) < 0.49 * sum(w * w for w in v.values())


def test_quality_on_held_out_labels(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = quality.score(docs, model).select("document.doc_id", "accept").join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r["accept"] == bool(r["quality"]) for r in rows) / len(rows) > 0.95
    assert quality.keep_good(docs.limit(20), labels.limit(0)).count() == 20


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = Scratch(spark, "test").save(stage(spark, docs, sf_dir), name)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        ids = docs.select("doc_id")
        assert ids.distinct().count() == docs.count() and ids.join(before, "doc_id", "left_anti").count() == 0
    texts = [hashlib.sha256(r["text"].encode()).hexdigest() for r in docs.select("text").collect() if r["text"]]
    assert len(texts) == len(set(texts))
    count = Counter(tuple(w[i : i + 35]) for r in docs.select("text").collect() for w in [words(r["text"])] for i in range(len(w) - 34))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.count() and max(count.values(), default=1) <= 2
