"""The committed store, and ingest, rescan, pipeline and bulk ingest into it."""

import os
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palisade.operators import ingest, intel, reports, scan
from palisade.sources import store as S

MAIL = "The team met nora.weiss@mail.test in the garden and talked for a long while about the harvest of this year."
KEY = "AKIA" + "AB12" * 4
AT = datetime(2024, 5, 1, 10)


def documents(spark, *rows):
    return spark.createDataFrame([(i, f"{i}.note.txt", "text/plain", t) for i, t in rows], "document_id string, filename string, mime_type string, text string")


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "document_id string")


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """Folders are named from the root on, so a store can be copied."""
    root = str(tmp_path_factory.mktemp("filled") / "store")
    ingest.ingest_into(S.Store(spark, root, buckets=4), documents(spark, ("a", MAIL), ("b", f"key {KEY}"), ("c", " ​ "), ("d", "All is quiet on this day in the garden.")), at=AT)
    return root


@pytest.fixture()
def store(spark, tmp_path, filled):
    shutil.copytree(filled, tmp_path / "store")
    return S.Store(spark, str(tmp_path / "store"), buckets=4)


def files(store, table):
    return {b: tuple(fs) for b, fs in store.manifest()["tables"][table].items()}


def test_one_commit_feeds_four_tables(spark, store):
    t = store.tables()
    docs = {r["document_id"]: r for r in t["documents"].collect()}
    assert set(docs) == {"a", "b", "d"} and docs["a"]["title"] == "a.note" and docs["a"]["status"] == "SCANNED" and docs["a"]["metadata"]["word_count"] == len(MAIL.split())
    assert docs["a"]["metadata"]["scan_config"]["pii"] and docs["b"]["classification"] == "INTERNAL" and docs["d"]["risk_score"] == 0
    assert {(r["document_id"], r["type"], r["stage"]) for r in t["findings"].collect()} == {("a", "EMAIL", "INPUT"), ("b", "API_KEY", "INPUT")}
    reports_ = {r["document_id"]: r for r in t["intelligence"].collect()}
    assert set(reports_) == {"a", "b", "d"} and reports_["a"]["entities"][0]["type"] == "EMAIL" and reports_["a"]["model"] == "heuristic-v1"
    assert sorted((r["document_id"], r["action"]) for r in t["audit"].collect()) == sorted((d, a) for d in "abd" for a in ("UPLOAD", "INTELLIGENCE_EXTRACT"))


def test_a_crash_between_tables_changes_nothing(spark, store, monkeypatch):
    before, write, calls = store.table("documents").count(), S.Store._write, []

    def fail(self, name, *rest):
        calls.append(name)
        if name == "intelligence":
            raise OSError("lost")
        return write(self, name, *rest)

    monkeypatch.setattr(S.Store, "_write", fail)
    with pytest.raises(OSError):
        ingest.ingest_into(store, documents(spark, ("x", MAIL)), at=AT)
    monkeypatch.undo()
    assert calls == ["documents", "findings", "intelligence"] and store.manifest()["version"] == 1
    assert store.table("documents").count() == before and store.table("findings").filter("document_id = 'x'").count() == 0
    ingest.ingest_into(store, documents(spark, ("x", MAIL)), at=AT)
    assert store.table("documents").count() == before + 1


def test_a_manifest_cut_short_and_a_rival(spark, store):
    path = f"{store.root}/manifest/v0000000002.json"
    with open(path, "w") as f:
        f.write('{"version": 2, "tab')
    assert store.manifest()["version"] == 1 and store.table("documents").count() == 3
    assert store.commit(S.Change("audit", store.table("audit").limit(0))) == 3
    with pytest.raises(Exception, match="exist"):
        store._publish({"version": 3})
    assert store.table("documents", 1).count() == 3
    with pytest.raises(ValueError):
        store.manifest(9)


def test_only_touched_buckets_are_written(spark, store):
    ingest.ingest_into(store, documents(spark, *((str(i), f"{MAIL} {i}") for i in range(40))), at=AT)
    before = files(store, "findings")
    new = spark.createDataFrame([("7", "PII", "PHONE", "LOW", 0.5, "MASK", None, "INPUT", 0, 1, "x", "y", "z")], S.SCHEMAS["findings"])
    S.write_findings(spark, store.root, new, ids(spark, "7"))
    after, touched = files(store, "findings"), {str(b) for b in store.touched("findings", ids(spark, "7"))}
    assert len(touched) == 1 and {b for b in after if after[b] != before.get(b)} == touched
    assert {(r["document_id"], r["type"]) for r in store.table("findings").filter("document_id IN ('7', '8')").collect()} == {("7", "PHONE"), ("8", "EMAIL")}
    assert store.of("findings", ids(spark, "7", "none")).count() == 1
    plan = store.of("findings", ids(spark, "7"))._jdf.queryExecution().toString()
    assert all(f not in plan for b, fs in after.items() if b not in touched for f in fs)


def test_rescan_replaces_and_keeps_the_configuration(spark, store):
    ingest.run_pipeline_into(store, ids(spark, "a"), "PUBLIC_RELEASE", ["FAQ"], at=AT)
    held = store.table("transformations").count()
    before = files(store, "documents")
    ingest.rescan_into(store, ids(spark, "a", "nobody"), scan.ScanConfig(pii=False), at=AT)
    row = store.table("documents").filter("document_id = 'a'").first()
    assert (row["status"], row["sanitized_content"], row["risk_after"], row["risk_score"]) == ("SCANNED", None, 0, 0)
    assert row["metadata"]["scan_config"]["pii"] is False and row["metadata"]["sanitized_policy"] is None and row["metadata"]["sha256"]
    assert store.table("findings").filter("document_id = 'a'").count() == 0 and store.table("findings").filter("document_id = 'b'").count() == 1
    assert store.table("intelligence").filter("document_id = 'a'").count() == 1 and store.table("transformations").count() == held
    assert store.table("audit").filter("action = 'SCAN'").count() == 1
    changed = {b for b, fs in files(store, "documents").items() if fs != before.get(b)}
    assert changed <= {str(b) for b in store.touched("documents", ids(spark, "a", "nobody"))}


def test_pipeline_states_actions_and_failures(spark, store):
    _, errors = ingest.run_pipeline_into(store, ids(spark, "a", "b", "d", "zz"), "PUBLIC_RELEASE", ["FAQ", "NO_SUCH", "BLOG_POST"], batch_id="B1", at=AT)
    docs = {r["document_id"]: r for r in store.table("documents").collect()}
    assert {d: r["status"] for d, r in docs.items()} == {"a": "TRANSFORMED", "b": "BLOCKED", "d": "TRANSFORMED"}
    assert "nora.weiss" not in docs["a"]["sanitized_content"] and docs["a"]["metadata"]["sanitized_policy"] == "PUBLIC_RELEASE" and docs["b"]["sanitized_content"] == docs["b"]["raw_content"]
    assert docs["b"]["risk_after"] == docs["b"]["risk_before"] and docs["a"]["risk_after"] == 0
    made = store.table("transformations").collect()
    assert sorted((r["document_id"], r["output_type"]) for r in made) == [("a", "BLOG_POST"), ("a", "FAQ"), ("d", "BLOG_POST"), ("d", "FAQ")]
    assert all(r["batch_id"] == "B1" and r["citations"] and r["output_dlp"] == "PASS" for r in made)
    assert sorted(map(tuple, errors.collect()), key=str) == sorted([("a", "NO_SUCH", "unknown output type NO_SUCH"), ("d", "NO_SUCH", "unknown output type NO_SUCH"), ("zz", None, "Not found.")], key=str)
    assert {(r["document_id"], r["applied_action"]) for r in store.table("findings").collect()} == {("a", "MASK"), ("b", "REDACT")}
    audit = store.table("audit").groupBy("action").count().collect()
    assert {r["action"]: r["count"] for r in audit} == {"UPLOAD": 3, "INTELLIGENCE_EXTRACT": 3, "POLICY_APPLY": 3, "TRANSFORM": 6, "RELEASE": 4}
    _, again = ingest.run_pipeline_into(store, ids(spark, "b"), at=AT)
    assert [r["error"] for r in again.collect()] == [ingest.BLOCKED]


def test_generated_outputs_fail_one_by_one(spark, store):
    made = spark.createDataFrame([("a", "FAQ", "Write to nora.weiss@mail.test for more of it.", None), ("a", "BLOG_POST", None, "model timed out")], "document_id string, output_type string, output string, error string")
    _, errors = ingest.run_pipeline_into(store, ids(spark, "a"), output_types=["FAQ", "BLOG_POST"], generated=made, at=AT)
    row = store.table("transformations").first()
    assert row["output_dlp"] == "FAIL" and "nora.weiss" not in row["output_content"] and row["leakage_count"] == 1 and row["model"] == "generated"
    assert [tuple(r) for r in errors.collect()] == [("a", "BLOG_POST", "model timed out")]
    assert store.table("audit").filter("action = 'DLP_BLOCK'").count() == 1 and store.table("documents").filter("document_id = 'a'").first()["status"] == "TRANSFORMED"


def test_reviewers_choices_in_the_pipeline(spark, store):
    row = store.table("findings").filter("document_id = 'a'").first()
    place = f"{row['start']}-{row['end']}"
    kind = "document_id string, seq int, finding_id string, location string, type string, action string"
    chosen = spark.createDataFrame([("a", 1, None, place, "EMAIL", "MASK"), ("a", 2, "gone", place, "EMAIL", "ALLOW"), ("d", 1, None, "0-1", "EMAIL", "ALLOW")], kind)
    ingest.run_pipeline_into(store, ids(spark, "a", "d"), overrides=chosen, at=AT)
    assert "nora.weiss" in store.table("documents").filter("document_id = 'a'").first()["sanitized_content"]
    place = store.table("findings").filter("document_id = 'b'").select(F.concat_ws("-", "start", "end")).first()[0]
    _, errors = ingest.run_pipeline_into(store, ids(spark, "b"), overrides=spark.createDataFrame([("b", 1, None, place, "API_KEY", "ALLOW")], kind), at=AT)
    assert [r["error"] for r in errors.collect()] == [ingest.FORBIDDEN] and store.table("documents").filter("document_id = 'b'").first()["status"] == "SCANNED"


def test_choices_match_both_ways_and_the_last_counts(spark):
    f = spark.createDataFrame([("d", "f1", "0-5", "EMAIL", "PII", "INPUT"), ("d", "f2", "9-12", "API_KEY", "SECRET", "INPUT"), ("d", "f3", "0-5", "EMAIL", "PII", "OUTPUT")], "document_id string, finding_id string, location string, type string, category string, stage string")
    kind = "document_id string, seq int, finding_id string, location string, type string, action string"
    told = lambda *rows: {r["finding_id"]: (r["override"], r["override_error"]) for r in reports.resolve_overrides(f, spark.createDataFrame(list(rows), kind)).collect()}
    assert told(("d", 1, "nope", "0-5", "EMAIL", "MASK"))["f1"] == ("MASK", False)
    assert told(("d", 1, "f1", None, None, "MASK"), ("d", 2, None, "0-5", "EMAIL", "ALLOW")) == {"f1": ("ALLOW", False), "f2": (None, False), "f3": (None, False)}
    assert told(("d", 1, "f2", None, None, "ALLOW"), ("d", 2, "f2", None, None, "MASK"))["f2"] == ("MASK", True)


def test_bulk_ingest_of_contents(spark, store):
    rows = [("B", 1, MAIL + " More of it."), ("B", 2, MAIL), ("B", 3, ""), ("B", 4, MAIL + " More of it."), ("B", 5, "xq" * 300), ("B", 6, f"token {KEY}"), ("C", 1, ""), ("C", 2, "A quiet day in the garden with the team and a book.")]
    items = spark.createDataFrame([(b, i, f"{i}.txt", "text/plain", t) for b, i, t in rows], "batch_id string, seq int, filename string, mime_type string, text string")
    out = {(r["batch_id"], r["seq"]): r["outcome"] for r in ingest.bulk_ingest_into(store, items, pipeline=True, output_types=["FAQ"], stop_on_error=False, at=AT).collect()}
    assert out == {("B", 1): "pipelined", ("B", 2): "skipped", ("B", 3): "failed", ("B", 4): "skipped", ("B", 5): "failed", ("B", 6): "blocked", ("C", 1): "failed", ("C", 2): "pipelined"}
    assert {"B-1", "B-6", "C-2"} == {r[0] for r in store.table("documents").select("document_id").collect()} - {"a", "b", "d"}
    stopped = {(r["batch_id"], r["seq"]): r["outcome"] for r in ingest.bulk_ingest_into(store, items.withColumn("text", F.concat("text", F.when(F.col("text") != "", " Again.").otherwise(""))), stop_on_error=True, at=AT).collect()}
    assert [stopped[("B", i)] for i in range(1, 7)] == ["ingested", "ingested", "failed", "cancelled", "cancelled", "cancelled"] and stopped[("C", 2)] == "cancelled"


def test_a_batch_that_comes_twice(spark, store):
    new = documents(spark, ("s1", MAIL))
    new = new.unionByName(documents(spark, ("e", "")))
    first, rejected = ingest.ingest_into(store, new, at=AT, batch=("uploads", 0))
    assert [tuple(r) for r in rejected.collect()] == [("e", "No content")]
    second, _ = ingest.ingest_into(store, new, at=AT, batch=("uploads", 0))
    assert first == second and store.table("documents").filter("document_id = 's1'").count() == 1


def test_reports_follow_the_contents(spark):
    docs = scan.scan_array(spark.createDataFrame([("a", MAIL), ("b", "phishing was used to steal passwords from the users")], "document_id string, text string"))
    first = intel.intelligence_report(docs).withColumn("content_hash", intel.content_hash(F.col("text"))).select("document_id", "content_hash", *intel.REPORT)
    changed = docs.withColumn("text", F.when(F.col("document_id") == "a", F.concat("text", F.lit(" More."))).otherwise(F.col("text")))
    old = first.withColumn("summary", F.lit("old"))
    got = {r["document_id"]: r["summary"] for r in intel.ensure_intelligence(changed, old).collect()}
    assert got["b"] == "old" and got["a"].startswith("Analyzed")
    assert all(r["summary"] != "old" and r["counts"]["entities"] == len(r["entities"]) for r in intel.ensure_intelligence(changed, old, force=True).collect())
    b = first.filter("document_id = 'b'").first()
    assert not b["ttps"] or f"{b['ttps'][0]['mitre_id']} ({b['ttps'][0]['technique']})" in b["summary"]


def test_named_files(spark, tmp_path):
    rows = [("My Title!", "FAQ", "one"), ("my title", "FAQ", "two"), (None, "BLOG_POST", None), ("My Title!", "FAQ", "one")]
    S.export_artefacts(spark.createDataFrame(rows, "title string, output_type string, output string").repartition(3), str(tmp_path / "out"))
    got = {n: (tmp_path / "out" / n).read_text() for n in os.listdir(tmp_path / "out")}
    assert set(got) == {"my-title-faq.md", "my-title-faq-2.md", "my-title-faq-3.md", "output-blog-post.md"} and sorted(got[n] for n in got if "faq" in n) == ["one", "one", "two"]
