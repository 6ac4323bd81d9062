"""Exact deduplication whose state lasts over several calls."""

import re

import pytest
from pyspark.sql import functions as F

from palisade.llm import exact_dedup

SCHEMA = "doc_id long, text string"
CALLS = [
    [(5, "a  b"), (6, "c"), (None, None), (7, "a b")],
    [],
    [(1, "a\tb"), (2, "d"), (3, "d"), (9, ""), (8, "e")],
    [(4, "c"), (0, "e"), (10, "f"), (11, "f"), (12, "c "), (13, "c")],
]
DIGESTS = [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 0)]


def expected(calls):
    """Per call, (id, keep_id, group_size, kept): the first call that has a text keeps its smallest id."""
    keep, size, out = {}, {}, []
    for rows in calls:
        keys = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
        new = {}
        for (i, _), k in zip(rows, keys):
            size[k] = size.get(k, 0) + 1
            if k not in keep and (k not in new or (i is not None and (new[k] is None or i < new[k]))):
                new[k] = i
        out.append(sorted(((i, {**new, **keep}[k], size[k], k not in keep and new[k] == i) for (i, _), k in zip(rows, keys)), key=str))
        keep = new | keep
    return out


@pytest.mark.parametrize("digest,as_files", list(zip(DIGESTS, (False, True))))
def test_a_later_call_goes_on(spark, tmp_path, digest, as_files):
    """Frames of files, also in folders with odd names, and frames of rows; also with one digest for all texts."""
    got = []
    for n, rows in enumerate(CALLS):
        df = spark.createDataFrame(rows, SCHEMA)
        if as_files:
            df.write.parquet(str(tmp_path / f"in [{n}] %20 é"))
            df = spark.read.parquet(str(tmp_path / f"in \\[{n}\\] %20 é"))
        decisions, content = exact_dedup.exact_dedup(df, digest=digest, folder=str(tmp_path / "state"))
        got.append(sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in decisions.collect()), key=str))
        assert content.count() == len(rows)
    assert got == expected(CALLS)


@pytest.mark.parametrize("digest", DIGESTS[1:])
def test_a_call_that_was_cut_off(spark, tmp_path, digest, monkeypatch):
    """Made again it counts its rows once; other rows are refused until then."""
    frames = []
    for n, rows in enumerate(CALLS):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / f"in{n}"))
        frames.append(spark.read.parquet(str(tmp_path / f"in{n}")))
    folder = str(tmp_path / "state")
    exact_dedup.exact_dedup(frames[0], digest=digest, folder=folder)
    save = exact_dedup.Scratch.save

    def fail(self, df, name, *by):
        if name.startswith("collisions"):
            raise RuntimeError("cut off")
        return save(self, df, name, *by)

    monkeypatch.setattr(exact_dedup.Scratch, "save", fail)
    with pytest.raises(RuntimeError):
        exact_dedup.exact_dedup(frames[2], digest=digest, folder=folder)
    monkeypatch.setattr(exact_dedup.Scratch, "save", save)
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(frames[3], digest=digest, folder=folder)
    decisions, _ = exact_dedup.exact_dedup(frames[2], digest=digest, folder=folder)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in decisions.collect()), key=str)
    assert got == expected([CALLS[0], CALLS[2]])[1]


def test_bitmap_lets_all_hits_through(spark, monkeypatch):
    """With few bits, so that others share them: none of the digests is lost, others mostly go."""
    monkeypatch.setattr(exact_dedup, "BITS", 1 << 16)
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).cast("binary").alias("digest"), "id")
    got = {r["id"] for r in exact_dedup.maybe_in(rows, rows.filter("id % 7 = 0")).collect()}
    assert {i for i in range(0, 5000, 7)} <= got and len(got) < 900
    assert exact_dedup.maybe_in(rows, rows.limit(0)).count() == 0
