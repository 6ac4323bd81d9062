"""Cases that once went wrong, and operators that are opened again."""

import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palisade.llm import line_dedup, neighbours, packing, substring_dedup
from palisade.llm._shared import Scratch
from palisade.llm.components import components, contracted

SCHEMA = "doc_id long, text string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_packed_ids_are_the_librarys(spark):
    """Also where a text holds an added token: inside words, at ends, repeated, cut short; and where white space is longer than the fast reader takes."""
    library = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y<|endoftext|><|endoftext|>", "<|endoftext|", " " * 1_200_000 + "a", "don't\n\n  é漢😀 \x1c x\x85y", None, "", "same", "same"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts[:-1])) + [(8, "same")], SCHEMA), PATH, public_tokenizers.PATTERN, longest=16).collect()
    got = Counter()
    for s in {(r["doc_id"]) for r in rows} - {8}:
        pieces = sorted((r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == s)
        ids = np.frombuffer(b"".join(p for _, p in pieces), "<u4").tolist()
        assert ids == [*library.encode(texts[s] or "", add_special_tokens=False).ids, 1]
        assert [p for p, _ in pieces] == np.cumsum([0, *(len(x) // 4 for _, x in pieces[:-1])]).tolist()
        got[s] = len(ids)
    assert len([r for r in rows if r["doc_id"] == 8]) == 2 * len([r for r in rows if r["doc_id"] == 8 and r["sequence_id"] in {min(q["sequence_id"] for q in rows if q["doc_id"] == 8)}]) * len({r["start"] for r in rows if r["doc_id"] == 8})
    assert got[0] == 5


def test_buckets_of_equal_length(spark, tmp_path):
    pieces = packing.pack(spark.createDataFrame([(i, "word " * i) for i in range(20)], SCHEMA), PATH, public_tokenizers.PATTERN, longest=8)
    packing.write_buckets(pieces, str(tmp_path / "b"))
    assert sorted(d for d in os.listdir(tmp_path / "b") if d.startswith("bucket")) == [f"bucket={b}" for b in range(4)]
    assert all({r["length"] for r in spark.read.parquet(str(tmp_path / "b")).filter(F.col("bucket") == b).collect()} == {1 << b} for b in range(4))


def test_words_that_powers_cannot_tell_apart(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2 ** 64, whatever the base."""
    x = [0]
    while len(x) < 1024:
        x += [1 - v for v in x]
    a, b = ("".join("ab"[v ^ k] for v in x) for k in (0, 1))
    same = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{same} {a}"), (2, f"{same} {b}"), (3, f"{same} z {same} z")]
    out = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: 0, 2: 0, 3: 70}
    tables = spark.catalog.listTables()
    assert not any(t.name.startswith("palisade") for t in tables)


def test_long_and_empty_texts(spark):
    long = " ".join(f"v{i % 50_000}" for i in range(100_000))
    out = substring_dedup.remove_repeats(spark.createDataFrame([(1, long), (2, ""), (3, None), (3, " ")], SCHEMA + "")).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in out) == Counter({(1, 100_000, 100_000): 1, (2, 0, 0): 1, (3, 0, 0): 2})
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_of_rows_with_equal_ids(spark):
    """Positions of one row's lines are not those of another row with the same id, or without one."""
    line = "a line that is surely longer than forty characters"
    rows = [(2, f"{line}\nown 2"), (2, "keep me\nkeep too"), (None, f"n1\n{line}"), (None, "n2 first\nn2"), *((i, line) for i in range(10, 15)), (14, f"x\n{line.upper()} ")]
    out = line_dedup.drop_common_lines(spark.createDataFrame([(*r, "f", 0) for r in rows], SCHEMA + ", file string, row long"))
    got = Counter((r["doc_id"], r["kept"]) for r in out.collect())
    assert got == Counter([(2, "own 2"), (2, "keep me\nkeep too"), (None, "n1"), (None, "n2 first\nn2"), (10, ""), (11, ""), (12, ""), (13, ""), (14, line), (14, f"x\n{line.upper()} ")])
    assert line_dedup.drop_common_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_are_opened_again(spark, tmp_path):
    kind = "id long, pos int, h1 long, h2 long"
    for b in range(4):
        runs = line_dedup.LineRuns(spark, fanout=3, folder=str(tmp_path / "runs"), buckets=4)
        batch = spark.createDataFrame([(b, 0, k, k) for k in range(b, b + 3)], kind)
        assert {r["h1"] for r in line_dedup.drop_seen_lines(batch, runs).collect()} == (set(range(3)) if not b else {b + 2})
    again = line_dedup.LineRuns(spark, fanout=3, folder=str(tmp_path / "runs"))
    assert {r["h1"]: r["documents"] for r in again.known().collect()} == Counter(k for b in range(4) for k in range(b, b + 3))
    assert sorted(level for level, names in again.levels.items() if names) == [0, 1]


def test_anti_join_moves_no_run(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, folder=str(tmp_path / "runs"), buckets=4)
    runs.add(spark.range(50).selectExpr("id", "id AS h1", "id AS h2"))
    batch = spark.range(20, 90).selectExpr("id AS h1", "id AS h2").repartition(4, "h1", "h2")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = batch.join(runs.runs()[0].select("h1", "h2"), ["h1", "h2"], "left_anti")
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert plan.count() == 40 and text.count("Exchange hashpartitioning") == 1, text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_neighbours_of_one_direction(spark):
    """Many distinct vectors with equal cosines: the smallest ids win."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=24)
    rows = [(i, (base * f).tolist(), i, "x") for i, f in zip(range(981, 1001), rng.permutation(np.linspace(0.3, 7, 20)))] + [(i, rng.normal(size=24).tolist(), i, "x") for i in range(300)]
    out = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, v string"), F.col("vec_id").isin(1000, 983)).collect()
    got = {q: [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (1000, 983)}
    assert got == {1000: [981, 982, 983, 984, 985], 983: [981, 982, 984, 985, 986]}


def test_descent_beyond_the_table():
    """Codes that share 12 bits: the longest prefix with enough of them is read, and no more."""
    codes = np.sort(np.array([0b101 << 45 | v for v in (0, 1, 2, 3, 1 << 20, 1 << 21, 1 << 30)], np.int64))
    for need, end in ((1, 1), (2, 2), (3, 4), (5, 5), (6, 6), (7, 7)):
        lo, hi = neighbours.reach(codes, codes[:1], np.array([neighbours.COUNTED]), need)
        assert (lo[0], hi[0]) == (0, end), (need, lo, hi)
    lo, hi = neighbours.reach(codes, codes[:1], np.array([3]), 1)
    assert (lo[0], hi[0]) == (0, 7)


def test_contracted_links_connect_the_same(spark):
    rng = np.random.default_rng(3)
    group = rng.integers(0, 6, 400)
    pairs = [(u, v) for u, v in rng.integers(0, 400, (6000, 2)).tolist() if group[u] == group[v]] + [(5, 5)]
    few = [(max(p), min(v for v in p if group[v] == group[p[0]])) for p in pairs]
    # what tasks return: many nodes, each linked to some of a few small ones
    few += [(u, int(np.flatnonzero(group == group[u])[k])) for u in range(400) for k in range(3)]
    links = spark.createDataFrame(few, "u long, v long")
    fewer = contracted(links)
    assert fewer.filter("u <= v").isEmpty() and fewer.count() < links.filter("u <> v").distinct().count()
    whole, part = ({r["node"]: r["root"] for r in components(x, Scratch(spark, "test")).collect()} for x in (links, fewer))
    assert whole == part and len(set(part.values())) == 6
    assert contracted(spark.createDataFrame([], "u long, v long")).isEmpty()
