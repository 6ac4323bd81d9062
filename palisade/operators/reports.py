"""Reports, lists and joins over the stored tables: documents, findings, transformations, audit, policies, intelligence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.operators.risk import half_up

# Orders of classes, severities and statuses.
CLASSES = ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED", "UNCLASSIFIED"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
CATEGORIES = ["PII", "SECRET", "PROMPT_INJECTION", "INTERNAL_ASSET", "UNSAFE_URL"]
STATUSES = ["UPLOADED", "SCANNED", "SANITIZED", "TRANSFORMED", "BLOCKED"]
DONE = ["SANITIZED", "TRANSFORMED"]
#: Fixed value: characters of a report's preview.
PREVIEW = 600
OUTCOMES = ["ingested", "pipelined", "skipped", "blocked", "pipeline-failed", "failed", "cancelled"]


def _share(n: Column, total: Column) -> Column:
    return half_up(100.0 * n / total)


def status_counts(documents: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return documents.agg(F.count(F.lit(1)).alias("total"), *map(count, STATUSES), F.count_if(F.col("risk_score") >= 50).alias("high_risk"))


def findings_by_category(findings: DataFrame) -> DataFrame:
    return findings.filter("stage = 'INPUT'").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def documents_by_classification(documents: DataFrame) -> DataFrame:
    """Counts, rounded shares and rank; the window spans a row per class."""
    n = documents.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("classification"))
    return n.select("classification", "n", _share(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("share"), rank.alias("rank"))


def avg_risk_reduction(documents: DataFrame) -> DataFrame:
    done = documents.filter(F.col("status").isin(DONE))
    return done.agg(F.coalesce(half_up(F.avg(F.col("risk_before") - F.col("risk_after"))), F.lit(0)).alias("reduction"))


def released_outputs(transformations: DataFrame) -> DataFrame:
    return transformations.agg(F.count_if(F.col("output_dlp") == "PASS").alias("released"))


def intel_totals(reports: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(F.size(F.coalesce(F.col(c), F.array()))), F.lit(0)).alias(f"n_{c}")
    return reports.agg(F.count(F.lit(1)).alias("reports"), total("entities"), total("iocs"), total("ttps"))


def tactic_counts(reports: DataFrame) -> DataFrame:
    return reports.select(F.explode("ttps").alias("t")).groupBy(F.col("t.tactic").alias("tactic")).agg(F.count(F.lit(1)).alias("n"))


def severity_breakdown(findings: DataFrame) -> DataFrame:
    """Per document a count and a share for each severity."""
    rows = findings.filter("stage = 'INPUT'").groupBy("document_id").pivot("severity", SEVERITIES).agg(F.count(F.lit(1))).fillna(0)
    total = sum((F.col(s) for s in SEVERITIES[1:]), F.col(SEVERITIES[0]))
    return rows.select("document_id", *(F.col(s).alias(s.lower()) for s in SEVERITIES), *(_share(F.col(s), total).alias(f"{s.lower()}_share") for s in SEVERITIES))


def latest_transformation(transformations: DataFrame, *more: str) -> DataFrame:
    """The newest one per document (and further keys); of equally new ones the largest id."""
    fields = [c for c in transformations.columns if c not in ("document_id", *more)]
    newest = transformations.groupBy("document_id", *more).agg(F.max_by(F.struct(*fields), F.struct("created_at", "transformation_id")).alias("t"))
    return newest.select("document_id", *more, "t.*")


def category_breakdown(findings: DataFrame, transformations: DataFrame) -> DataFrame:
    """Counts per category and document; output_leakage adds the newest transformation's leaks to the findings of outputs."""
    count = lambda c: F.count_if((F.col("category") == c) & (F.col("stage") == "INPUT")).alias(c.lower())
    rows = findings.groupBy("document_id").agg(*map(count, CATEGORIES), F.count_if(F.col("stage") == "OUTPUT").alias("_out"))
    last = latest_transformation(transformations).select("document_id", F.col("leakage_count").alias("_leaks"))
    return rows.join(last, "document_id", "left").withColumn("output_leakage", F.col("_out") + F.coalesce("_leaks", F.lit(0))).drop("_out", "_leaks")


def security_report(documents: DataFrame, findings: DataFrame, transformations: DataFrame) -> DataFrame:
    """One row per document: stored risk, counts by category and severity, the newest output's statuses, top findings, and a preview of the working copy, never of the raw text.

    documents: document_id, classification, risk_score, risk_before, risk_after, sanitized_content.
    Children are grouped before the joins, each of which is on the document's id.
    """
    count = lambda c, v: F.count_if((F.col(c) == v) & (F.col("stage") == "INPUT")).alias(v.lower())
    counts = findings.groupBy("document_id").agg(*(count("category", c) for c in CATEGORIES), *(count("severity", s) for s in SEVERITIES), F.count_if(F.col("stage") == "OUTPUT").alias("_out"))
    last = latest_transformation(transformations).select("document_id", "grounding", "policy_status", "output_dlp", "leakage_count")
    top = top_findings(findings).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("rank", "category", "type", "severity", "confidence", "shown"))).alias("top_findings"))
    rows = documents.join(counts, "document_id", "left").join(last, "document_id", "left").join(top, "document_id", "left")
    text = F.col("sanitized_content")
    preview = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "No sanitized copy yet.").when(F.length(text) > PREVIEW, F.concat(F.left(text, F.lit(PREVIEW)), F.lit("…"))).otherwise(text)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select(
        "document_id", "classification", "risk_score", "risk_before", "risk_after", *(zero(c.lower()) for c in CATEGORIES), *(zero(s.lower()) for s in SEVERITIES),
        (F.coalesce("_out", F.lit(0)) + F.coalesce("leakage_count", F.lit(0))).alias("output_leakage"),
        *(F.coalesce(F.col(c), F.lit("SKIPPED")).alias(c) for c in ("grounding", "policy_status", "output_dlp")), F.coalesce("top_findings", F.array()).alias("top_findings"), preview.alias("sanitized_preview"),
    )


def bulk_summary(items: DataFrame) -> DataFrame:
    """Per batch the items of each outcome; failed counts failed pipelines too."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o.replace("-", "_"))
    rows = items.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"), *map(count, OUTCOMES))
    return rows.withColumn("failed", F.col("failed") + F.col("pipeline_failed")).drop("pipeline_failed")


def risk_trend(documents: DataFrame, n: int = 14) -> DataFrame:
    """The newest ``n`` documents, oldest first, labelled D1 and so on."""
    newest = documents.orderBy(F.desc("created_at"), F.desc("document_id")).limit(n)  # so few rows that one window is no matter
    i = F.row_number().over(Window.orderBy("created_at", "document_id"))
    after = F.when(F.col("status").isin(*DONE, "BLOCKED"), F.col("risk_after")).otherwise(F.col("risk_before"))
    return newest.select(F.concat(F.lit("D"), i.cast("string")).alias("label"), "document_id", F.col("risk_before").alias("before"), after.alias("after"))


def top_findings(findings: DataFrame, n: int = 8) -> DataFrame:
    """The most confident findings of each document's input, in order of start among equals; secrets withheld, others cut."""
    w = Window.partitionBy("document_id").orderBy(F.desc("confidence"), "start", "type")
    rows = findings.filter("stage = 'INPUT'").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    shown = F.when(F.col("category") == "SECRET", "[withheld]").otherwise(F.left("matched_text", F.lit(48)))
    return rows.select("document_id", "rank", "category", "type", "severity", "confidence", shown.alias("shown"))


def list_documents(documents: DataFrame, status: str | None = None, take: int = 100, skip: int = 0) -> DataFrame:
    if not (1 <= take <= 200 and 0 <= skip <= 10_000):
        raise ValueError("take 1 to 200, skip 0 to 10000")
    rows = documents.filter(F.col("status") == status) if status else documents
    return rows.orderBy(F.desc("created_at"), F.desc("document_id")).offset(skip).limit(take)


def search_documents(documents: DataFrame, text: str = "", classification: str | None = None, status: str | None = None, sort: str = "date") -> DataFrame:
    found = F.lit(False)
    for c in ("title", "classification", "filename"):
        found = found | F.contains(F.lower(c), F.lit(text.lower()))
    rows = documents.filter(found)
    rows = rows.filter(F.col("classification") == classification) if classification else rows
    rows = rows.filter(F.col("status") == status) if status else rows
    order = {"risk": [F.desc("risk_score")], "name": ["title"], "date": [F.desc("created_at")]}[sort]
    return rows.orderBy(*order, "document_id")


def audit_feed(audit: DataFrame, n: int = 100, document_id=None) -> DataFrame:
    rows = audit.filter(F.col("document_id") == document_id) if document_id is not None else audit
    return rows.orderBy(F.desc("timestamp"), F.desc("audit_id")).limit(n)


def search_audit(audit: DataFrame, text: str) -> DataFrame:
    found = F.lit(False)
    for c in ("detail", "actor", "action"):
        found = found | F.contains(F.lower(c), F.lit(text.lower()))
    return audit.filter(found)


def list_policies(policies: DataFrame, active_only: bool = False) -> DataFrame:
    return (policies.filter("active") if active_only else policies).orderBy("name")


def audit_with_titles(audit: DataFrame, documents: DataFrame) -> DataFrame:
    return audit.join(documents.select("document_id", "title", "filename"), "document_id", "left")


def documents_with_children(documents: DataFrame, findings: DataFrame, transformations: DataFrame, reports: DataFrame) -> DataFrame:
    """Documents with arrays of findings (by start) and transformations (newest first) and their report's counts; children are grouped before the joins."""
    f = findings.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type", "category", "severity"))).alias("findings"))
    t = transformations.groupBy("document_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "transformation_id", "output_type")))).alias("transformations"))
    r = reports.select("document_id", F.size("ttps").alias("n_ttps"))
    return documents.join(f, "document_id", "left").join(t, "document_id", "left").join(r, "document_id", "left")


def resolve_overrides(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """``findings`` with override: the last choice, in order of seq, that a reviewer made for the finding.

    A choice is for the input finding with its id, else for the first one (smallest id) of its place and
    type, also if it has an id that no finding has; whichever way it was matched, the last one counts.
    Choices that match nothing are ignored. override_error: a choice, superseded or not, would allow an
    injection or a secret.
    """
    inputs = findings.filter("stage = 'INPUT'").select("document_id", "finding_id", "location", "type", "category")
    by_id = inputs.filter("finding_id IS NOT NULL").select("document_id", "finding_id", F.struct("location", "type", "category").alias("_by_id"))
    by_place = inputs.groupBy("document_id", "location", "type").agg(F.min(F.struct("finding_id", "category")).alias("_one"))
    by_place = by_place.select("document_id", "location", "type", F.struct("location", "type", F.col("_one.category").alias("category")).alias("_by_place"))
    matched = overrides.join(by_id, ["document_id", "finding_id"], "left").join(by_place, ["document_id", "location", "type"], "left")
    matched = matched.select("document_id", "seq", "action", F.coalesce("_by_id", "_by_place").alias("t")).filter("t IS NOT NULL")
    bad = (F.col("action") == "ALLOW") & F.col("t.category").isin("PROMPT_INJECTION", "SECRET")
    chosen = matched.groupBy("document_id", F.col("t.location").alias("location"), F.col("t.type").alias("type")).agg(F.max_by("action", "seq").alias("override"), F.bool_or(bad).alias("override_error"))
    rows = findings.join(chosen, ["document_id", "location", "type"], "left")
    mine = F.col("stage") == "INPUT"
    return rows.withColumn("override", F.when(mine, F.col("override"))).withColumn("override_error", F.coalesce(mine & F.col("override_error"), F.lit(False)))


def skip_duplicates(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """``batch`` with outcome ingested or skipped: known content, and all but the first of equal content in the batch, is skipped."""
    known = corpus.select("sha256").distinct().withColumn("_known", F.lit(True))
    first = batch.groupBy("sha256").agg(F.min("seq").alias("_first"))
    rows = batch.join(first, "sha256").join(known, "sha256", "left")
    return rows.withColumn("outcome", F.when(F.col("_known") | (F.col("seq") != F.col("_first")), "skipped").otherwise("ingested")).drop("_known", "_first")


def stored_or_live(documents: DataFrame, stored: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings to go on with, live ones to be stored).

    The stored input findings of documents that have any; of the other documents the live ones, all of
    which are used and of which those are stored whose place and type no stored finding has.
    """
    inputs = stored.filter("stage = 'INPUT'")
    without = documents.select("document_id").distinct().join(inputs, "document_id", "left_anti")
    fresh = live.join(without, "document_id", "left_semi")
    used = inputs.join(documents, "document_id", "left_semi").unionByName(fresh)
    return used, fresh.join(stored.select("document_id", "location", "type"), ["document_id", "location", "type"], "left_anti")


def bulk_delete(documents: DataFrame, ids: DataFrame, children: list[DataFrame], audit: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame], DataFrame]:
    """(deleted ids, documents left, children left, audit with the ids of deleted documents set to null); unknown ids are ignored."""
    gone = ids.select("document_id").distinct().join(documents.select("document_id"), "document_id", "left_semi")
    without = lambda df: df.join(gone, "document_id", "left_anti")
    marked = audit.join(gone.withColumn("_gone", F.lit(True)), "document_id", "left").withColumn("document_id", F.when(F.col("_gone"), None).otherwise(F.col("document_id"))).drop("_gone")
    return gone, without(documents), [without(c) for c in children], marked


def upsert(current: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``current`` with the rows of ``new`` in place of those with the same keys."""
    return current.join(new.select(*keys), list(keys), "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def update_actions(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """``findings`` with applied_action from (document_id, location, action), for findings of inputs."""
    new = actions.groupBy("document_id", "location").agg(F.max("action").alias("_a"))
    rows = findings.join(new, ["document_id", "location"], "left")
    return rows.withColumn("applied_action", F.when((F.col("stage") == "INPUT") & F.col("_a").isNotNull(), F.col("_a")).otherwise(F.col("applied_action"))).drop("_a")


def bulk_outcomes(items: DataFrame, stop_on_error: bool = False, most_files: int = 20, most_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """``items`` (batch_id, seq, size_bytes, error, duplicate, blocked, pipeline, pipeline_error) with outcome.

    Batches over the limits fail as a whole; with ``stop_on_error`` what follows a failure is cancelled.
    """
    whole = Window.partitionBy("batch_id")
    over = (F.count(F.lit(1)).over(whole) > most_files) | (F.sum("size_bytes").over(whole) > most_bytes)
    failed = over | F.col("error").isNotNull()
    plain = (
        F.when(failed, "failed").when(F.col("duplicate"), "skipped").when(F.col("pipeline") & F.col("blocked"), "blocked")
        .when(F.col("pipeline") & F.col("pipeline_error").isNotNull(), "pipeline-failed").when(F.col("pipeline"), "pipelined").otherwise("ingested")
    )
    if not stop_on_error:
        return items.withColumn("outcome", plain)
    before = Window.partitionBy("batch_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(failed.cast("int")).over(before) > 0, F.lit(False))
    return items.withColumn("_failed", failed).withColumn("_stopped", stopped).withColumn("outcome", F.when(F.col("_stopped"), "cancelled").otherwise(plain)).drop("_failed", "_stopped")


def audit_events(documents: DataFrame, transformations: DataFrame) -> DataFrame:
    """(document_id, actor, action, detail): what the life of documents and outputs leaves in the audit."""
    upload = documents.select("document_id", F.lit("api").alias("actor"), F.lit("UPLOAD").alias("action"), F.concat(F.lit("Uploaded "), "filename", F.lit(" ("), F.col("size_bytes").cast("string"), F.lit(" bytes)")).alias("detail"))
    scan = documents.filter("status <> 'UPLOADED'").select("document_id", F.lit("scanner").alias("actor"), F.lit("SCAN").alias("action"), F.concat(F.lit("Risk "), F.col("risk_before").cast("string"), F.lit(", "), "classification").alias("detail"))
    policy = documents.filter(F.col("status").isin(*DONE, "BLOCKED")).select("document_id", F.lit("policy").alias("actor"), F.lit("POLICY_APPLY").alias("action"), F.concat(F.lit("Risk "), F.col("risk_before").cast("string"), F.lit(" to "), F.col("risk_after").cast("string")).alias("detail"))
    made = transformations.select("document_id", F.lit("pipeline").alias("actor"), F.lit("TRANSFORM").alias("action"), F.col("output_type").alias("detail"))
    dlp = transformations.select("document_id", F.lit("dlp").alias("actor"), F.when(F.col("output_dlp") == "PASS", "RELEASE").otherwise("DLP_BLOCK").alias("action"), F.concat(F.col("leakage_count").cast("string"), F.lit(" leaks")).alias("detail"))
    return upload.unionByName(scan).unionByName(policy).unionByName(made).unionByName(dlp)


def bulk_audit(batches: DataFrame) -> DataFrame:
    """(document_id, actor, action, detail): a row per batch of ``bulk_summary``."""
    counts = [F.concat(F.col(c).cast("string"), F.lit(f" {c}")) for c in OUTCOMES if c in batches.columns]
    detail = F.concat(F.lit("Batch "), F.col("batch_id").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" files: "), F.concat_ws(", ", *counts))
    return batches.select(F.lit(None).cast("string").alias("document_id"), F.lit("analyst").alias("actor"), F.lit("BULK_INGEST").alias("action"), detail.alias("detail"))


def deletion_audit(gone: DataFrame, bulk: bool = True, named: int = 5) -> DataFrame:
    """(document_id, actor, action, detail) for deleted documents (document_id, title): one row that names the first few by id, or, unless ``bulk``, one each; none for none."""
    quoted = F.concat(F.lit('"'), F.coalesce("title", F.lit("")), F.lit('"'))
    said = lambda rows, action, detail: rows.select(F.lit(None).cast("string").alias("document_id"), F.lit("analyst").alias("actor"), F.lit(action).alias("action"), detail.alias("detail"))
    if not bulk:
        return said(gone, "DELETE", F.concat(F.lit("Deleted "), F.col("document_id").cast("string"), F.lit(" "), quoted))
    first = gone.select("document_id", quoted.alias("title")).orderBy("document_id").limit(named).agg(F.array_sort(F.collect_list(F.struct("document_id", "title"))).alias("first"))
    rows = gone.agg(F.count(F.lit(1)).alias("n")).join(first).filter("n > 0")
    more = F.when(F.col("n") > named, F.concat(F.lit(" and "), (F.col("n") - named).cast("string"), F.lit(" more"))).otherwise("")
    return said(rows, "BULK_DELETE", F.concat(F.lit("Deleted "), F.col("n").cast("string"), F.lit(": "), F.array_join(F.transform("first", lambda x: x["title"]), ", "), more))


def comparison_audit(compared: DataFrame) -> DataFrame:
    """(document_id, actor, action, detail): a row per document and output type whose policies (document_id, output_type, profile) were compared, at most a few dozen."""
    names = F.array_sort(F.collect_set("profile"))
    rows = compared.groupBy("document_id", "output_type").agg(names.alias("names"))
    detail = F.concat(F.lit("Compared "), F.size("names").cast("string"), F.lit(" policies for "), "output_type", F.lit(": "), F.array_join("names", ", "))
    return rows.select("document_id", F.lit("policy_engine").alias("actor"), F.lit("POLICY_COMPARE").alias("action"), detail.alias("detail"))


def rescan(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``documents`` with those listed set back: scanned, without a sanitized copy and risk after."""
    marked = documents.join(ids.select("document_id").distinct().withColumn("_again", F.lit(True)), "document_id", "left")
    again = F.coalesce("_again", F.lit(False))
    return marked.withColumns({
        "status": F.when(again, "SCANNED").otherwise(F.col("status")), "risk_after": F.when(again, 0).otherwise(F.col("risk_after")), "sanitized_content": F.when(~again, F.col("sanitized_content")),
    }).drop("_again")


def precision_recall(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Per category how many findings overlap a labelled span of the document and category, and the other way round."""
    meet = (F.col("f.document_id") == F.col("l.document_id")) & (F.col("f.category") == F.col("l.category")) & (F.col("f.start") < F.col("l.end")) & (F.col("f.end") > F.col("l.start"))
    found = findings.alias("f").join(labels.alias("l"), meet, "left_semi").groupBy("category").agg(F.count(F.lit(1)).alias("right"))
    caught = labels.alias("l").join(findings.alias("f"), meet, "left_semi").groupBy("category").agg(F.count(F.lit(1)).alias("caught"))
    n_f, n_l = findings.groupBy("category").agg(F.count(F.lit(1)).alias("found")), labels.groupBy("category").agg(F.count(F.lit(1)).alias("labelled"))
    rows = n_f.join(n_l, "category", "full").join(found, "category", "left").join(caught, "category", "left").fillna(0, ["found", "labelled", "right", "caught"])
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return rows.select("category", "found", "labelled", rate("right", "found").alias("precision"), rate("caught", "labelled").alias("recall"))


def dashboard(documents: DataFrame, findings: DataFrame, transformations: DataFrame, reports: DataFrame) -> DataFrame:
    """One row of totals, each of them aggregated on its own table."""
    by_category = findings.filter("stage = 'INPUT'").agg(F.count(F.lit(1)).alias("findings"), *(F.count_if(F.col("category") == c).alias(c.lower()) for c in CATEGORIES))
    return status_counts(documents).join(avg_risk_reduction(documents)).join(by_category).join(released_outputs(transformations)).join(intel_totals(reports))
