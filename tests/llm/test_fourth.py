"""Line runs whose anti-join decides, and quality classification over a whole pool."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import line_dedup, quality

KIND = "id long, h1 long, h2 long"


def test_a_line_is_in_one_run(spark, tmp_path):
    """Without the anti-join a known line would get a second row, and its count would be in parts."""
    runs = line_dedup.LineRuns(spark, fanout=3, folder=str(tmp_path / "runs"), buckets=4)
    for b in range(7):
        runs.add(spark.createDataFrame([(10 - b, k, k) for k in (1, b, b + 1)] + [(None, 100, 100)], KIND))
        rows = [r["h1"] for run in runs.runs() for r in run.collect()]
        assert len(rows) == len(set(rows))
    got = sorted((r["h1"], r["documents"], r["last"]) for r in runs.known().collect())
    assert got == sorted([(0, 1, 10), (1, 7, 10), *((k, 2, 11 - k) for k in range(2, 7)), (7, 1, 4), (100, 7, None)])


def test_an_unfinished_batch_is_added_anew(spark, tmp_path):
    folder = str(tmp_path / "runs")
    runs = line_dedup.LineRuns(spark, folder=folder, buckets=4)
    batches = [spark.createDataFrame([(b, k, k) for k in range(b, b + 3)], KIND) for b in range(2)]
    for b in batches:
        runs.add(b)
    runs.scratch.drop("run-0-000001-000001-4")  # as if the session had ended between the notes and the run
    again = line_dedup.LineRuns(spark, folder=folder, buckets=4)
    assert again.made == 1 and not again.notes
    again.add(batches[1])
    assert {r["h1"]: r["documents"] for r in again.known().collect()} == {0: 1, 1: 2, 2: 2, 3: 1}


@pytest.fixture(scope="module")
def corpus(spark):
    """Pages whose text and metadata each tell good from bad, most without a label."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        good = i % 2
        words = ["river", "stone", "letter", "garden", "window"] if good else ["BUY!!", "$$$", "now!!!", "|||", "@@@"]
        rows.append((i, " ".join(rng.choice(words, 30)), ["en", "xx"][good ^ int(rng.random() < 0.05)], "s", 100))
        if i % 4 < 2:
            labels.append((i, good))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int"), rows


def test_pool_sums_are_those_of_all_rows(spark, corpus):
    docs, labels, rows = corpus
    features = quality._feature_table(quality._view(docs, F.col("doc_id").alias("id"), "text", ("lang", "source", "n_chars")))
    table = features.orderBy("id").toArrow()
    xs = quality._stored(table)
    y = np.arange(600) % 2
    views = [quality.Logistic.fit(x[:200], y[:200].astype(float)) for x in xs]
    calibration = [quality.Logistic.fit(quality._logit(v.predict(x))[:, None], y.astype(float)) for v, x in zip(views, xs)]
    now = quality.Round(views, views, calibration, 0.8)
    plain, spread = now.sums(xs), quality.pool_sums(features.repartition(7), bins=3)(now)
    assert {k: v[0] for k, v in plain.items()} == {k: v[0] for k, v in spread.items()} and plain[0, 0][0] > 100
    for k in plain:
        assert np.allclose(plain[k][1], spread[k][1]) and np.allclose(plain[k][2], spread[k][2])


def test_co_training_moves_by_the_pool(spark, corpus):
    """The pool counts in whole, right decisions stay right, and repeated, null and odd rows have results."""
    docs, labels, rows = corpus
    alone, told = (quality.fit(docs, labels, rounds=n, confident=0.9) for n in (0, 3))
    assert any(not np.allclose(a.weights, b.weights) for a, b in zip(alone.views, told.views))
    one_sided = lambda now: {(v, k): (50 * k, k * np.eye(len(now.views[v].weights)), np.full(len(now.views[v].weights), 9.0 * k)) for v in (0, 1) for k in (0, 1)}
    xs, y = tuple(np.random.default_rng(1).normal(size=(90, n)) for n in (3, 4)), np.arange(90) % 2.0
    by = [quality.co_train(xs, y, one_sided, n) for n in (0, 2)]
    assert all(np.allclose(a.weights, b.weights, atol=1e-3) for a, b in zip(by[0].views, by[1].views))
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (1, "river stone " * 20_000, "xx", "s", 5)], docs.schema)
    wide = docs.unionByName(odd).withColumn("a.b", F.lit("x")).withColumn("document", F.lit(1))
    model = quality.fit(wide, labels)
    out = quality.score(wide, model).select("document.*", "accept").collect()
    assert len(out) == 603 and {"a.b", "document"} <= set(out[0].asDict())
    assert sum(r["accept"] == bool(r["doc_id"] % 2) for r in out if r["doc_id"] is not None) > 590
    # 600 rows with one id, all labelled: the bound is on rows
    same = docs.withColumn("doc_id", F.lit(7))
    assert quality.fit(same, spark.createDataFrame([(7, 1)], "doc_id long, quality int"), max_labelled=50).views is None
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    from palisade.llm import simhash, substring_dedup

    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 5, "p"), (2, text, 5, "q"), (3, "own words", 9, "r")], "doc_id long, text string, n_chars long, v string").withColumnRenamed("v", "a.b`c")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {(r[0], r[3]) for r in kept.collect()} == {(1, "p"), (3, "r")}
    out = substring_dedup.strip_repeats(df)
    assert out.columns == df.columns and {(r[0], r[1], r[3]) for r in out.collect()} == {(1, "", "p"), (2, "", "q"), (3, "own words", "r")}
