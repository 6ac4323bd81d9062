"""Documents on their way into the store, through a policy and to released outputs.

Each step is a chain of narrow expressions whose result is staged once and then fans out to the tables
that one commit changes. Failures are rows: what is wrong with one document or one output is told beside
the others, which go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.spans import each
from palisade.functions.text import normalize_text, quality_gate, strip, text_stats
from palisade.operators import intel, outputs, policy, reports, risk, sanitize, scan
from palisade.operators.detectors import FINDING
from palisade.sources.store import Change, Store

EMPTY, BLOCKED, FORBIDDEN = "No content", "Blocked documents are not transformed.", "A choice allows an injection or a credential."
FIELDS = [f.split(":")[0] for f in FINDING[len("array<struct<") : -2].split(",")]


def ingest(df: DataFrame, id_col: str = "document_id", text_col: str = "text", config: scan.ScanConfig = scan.ScanConfig()) -> DataFrame:
    """Documents (id, filename, text) as stored rows with findings: normalized, measured, scanned, scored. Empty texts have error set."""
    rows = df.withColumn("raw_content", normalize_text(F.col(text_col)))
    rows = scan.scan_array(rows, config, text_col="raw_content").withColumn("_r", risk.risk(F.col("findings")))
    stats = text_stats(F.col("raw_content"))
    return rows.withColumns({
        "metadata": F.struct(*(stats[k].alias(k) for k in ("sha256", "char_count", "word_count", "pages", "sections")), _settings(config).alias("scan_config")), "size_bytes": stats["size_bytes"], "status": F.lit("SCANNED"),
        "risk_score": F.col("_r.total"), "risk_before": F.col("_r.total"), "risk_after": F.lit(0), "classification": F.col("_r.classification"), "error": F.when(F.length(strip(F.col("raw_content"))) == 0, EMPTY),
    }).drop("_r", text_col)


def _settings(c: scan.ScanConfig) -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in vars(c).items()))


def event(rows: DataFrame, actor: str, action: str | Column, detail: Column, at: Column, document: Column | None = None) -> DataFrame:
    """Audit rows. Ids follow from what they say, so making them again makes the same."""
    action = F.lit(action) if isinstance(action, str) else action
    said = rows.select((F.col("document_id") if document is None else document).alias("document_id"), F.lit(actor).alias("actor"), action.alias("action"), detail.alias("detail"), at.alias("timestamp"))
    return said.select(F.sha2(F.concat_ws("|", "document_id", "actor", "action", "detail", F.col("timestamp").cast("string")), 256).alias("audit_id"), "*")


def _findings(wide: DataFrame, stage: str = "INPUT") -> DataFrame:
    return each(wide, F.col("findings"), "f", "document_id").select("document_id", "f.*", F.lit(stage).alias("stage"))


def _reported(wide: DataFrame, at: Column) -> DataFrame:
    """``wide`` with the intelligence report's columns."""
    return intel.intelligence_report(wide, "raw_content").withColumn("created_at", at)


def ingest_into(store: Store, df: DataFrame, config: scan.ScanConfig = scan.ScanConfig(), at: datetime | None = None, batch: tuple[str, int] | None = None) -> tuple[int, DataFrame]:
    """(version, rejected): new documents (document_id, filename, mime_type, text; more columns of the table if there are) with findings, reports and audit rows, in one commit.

    One scan feeds all four tables. rejected: document_id and error of texts that are empty after normalization.
    """
    at = F.current_timestamp() if at is None else F.lit(at)
    rows = df.withColumn("title", F.coalesce(F.col("title"), _title()) if "title" in df.columns else _title())
    rows = rows if "source_kind" in rows.columns else rows.withColumn("source_kind", F.lit("UPLOAD"))
    wide = store.stage(_reported(store.stage(ingest(rows, config=config)), at))
    good = wide.filter("error IS NULL")
    n = lambda c: F.size(c).cast("string")
    extracted = F.concat(n("entities"), F.lit(" entities, "), n("iocs"), F.lit(" IOCs, "), n("ttps"), F.lit(" TTPs."))
    uploaded = F.concat(F.lit('"'), "title", F.lit('" ('), F.coalesce("mime_type", F.lit("?")), F.lit(", "), F.col("metadata.word_count").cast("string"), F.lit(" words): risk "), F.col("risk_score").cast("string"), F.lit(", "), "classification", F.lit("."))
    audit = event(good, "intelligence_engine", "INTELLIGENCE_EXTRACT", extracted, at).unionByName(event(good, "analyst", "UPLOAD", uploaded, at))
    added = {"parser": F.lit("direct"), "warnings": F.array().cast("array<string>"), "sanitized_policy": F.lit(None).cast("string")}
    fields = ("sha256", "char_count", "word_count", "pages", "sections", *added, "scan_config")
    documents = good.withColumn("metadata", F.struct(*(added.get(k, F.col(f"metadata.{k}")).alias(k) for k in fields)))
    version = store.commit(Change("documents", documents), Change("findings", _findings(good)), Change("intelligence", good), Change("audit", audit), batch=batch)
    return version, wide.filter("error IS NOT NULL").select("document_id", "error")


def _title() -> Column:
    return F.regexp_replace("filename", r"\.[^.]+$", "")


def rescan_into(store: Store, ids: DataFrame, config: scan.ScanConfig | None = None, at: datetime | None = None) -> int:
    """Scan stored documents again, in one commit: input findings and report replaced, sanitized copy and risk after cleared, the configuration kept with the document.

    Only buckets with such documents are written; unknown ids are ignored. config: without it all families are reported.
    """
    at = F.current_timestamp() if at is None else F.lit(at)
    config = config or scan.ScanConfig()
    rows = store.of("documents", ids).drop("risk_score", "risk_before", "risk_after", "classification", "status")
    rows = scan.scan_array(rows, config, text_col="raw_content").withColumn("_r", risk.risk(F.col("findings")))
    rows = rows.withColumns({
        "risk_score": F.col("_r.total"), "risk_before": F.col("_r.total"), "risk_after": F.lit(0), "classification": F.col("_r.classification"), "status": F.lit("SCANNED"), "sanitized_content": F.lit(None).cast("string"),
        "metadata": F.col("metadata").withField("sanitized_policy", F.lit(None).cast("string")).withField("scan_config", _settings(config)),
    }).drop("_r")
    created = store.stage(rows.withColumn("_created", F.col("created_at")))
    wide = store.stage(_reported(created, at).withColumn("report_at", F.col("created_at")).withColumn("created_at", F.col("_created")).drop("_created"))
    known = wide.select("document_id")
    on = ", ".join(f"{k}={str(v).lower()}" for k, v in vars(config).items())
    detail = F.concat(F.lit('"'), F.coalesce("title", F.lit("")), F.lit('" again: risk '), F.col("risk_score").cast("string"), F.lit(", "), F.size("findings").cast("string"), F.lit(" findings, "), "classification", F.lit(f". {on}."))
    return store.commit(
        Change("documents", wide, known), Change("findings", _findings(wide), known, "stage = 'INPUT'"), Change("intelligence", wide.withColumn("created_at", F.col("report_at")), known),
        Change("audit", event(wide, "policy_engine", "SCAN", detail, at)),
    )


@dataclass(frozen=True)
class Outcome:
    """What a run changes: documents and their findings (all columns), new transformations and audit rows; errors: document_id, output_type (null: the whole document), error."""

    documents: DataFrame
    findings: DataFrame
    transformations: DataFrame
    audit: DataFrame
    errors: DataFrame


def run_pipeline(
    documents: DataFrame, findings: DataFrame, profile: str = policy.DEFAULT, output_types: list[str] | None = None, overrides: DataFrame | None = None, generated: DataFrame | None = None, policies: DataFrame | None = None,
    batch_id: str | None = None, at: datetime | None = None, stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> Outcome:
    """Stored documents through sanitizing, generation, validation and release.

    documents, findings: rows of the store's tables. Documents without stored input findings are scanned,
    and what is found is stored with them. overrides: document_id, seq, finding_id, location
    (start-end), type, action; a document with a forbidden choice is left as it is. generated:
    (document_id, output_type, output, error) from a model; without it the fixed artefacts are made. An
    output with an error, or of a type that is not known, is told and leaves the others. stage: keeps a
    frame that several results are made from, so that it is computed once.
    """
    at = F.current_timestamp() if at is None else F.lit(at)
    types = output_types or ["EXECUTIVE_SUMMARY"]
    if not 1 <= len(types) <= 8:
        raise ValueError("one to eight output types")
    policies = policies if policies is not None else policy.policies(documents.sparkSession, templates=True)
    chosen = policies.filter((F.col("name") == profile) & F.col("active")).select("block").first()
    if chosen is None:
        raise ValueError(f"unknown policy {profile}")

    closed = documents.filter("status = 'BLOCKED'").select("document_id", F.lit(None).cast("string").alias("output_type"), F.lit(BLOCKED).alias("error"))
    rows = documents.filter("status <> 'BLOCKED'")
    stored = findings.filter("stage = 'INPUT'").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", *(f for f in FIELDS if f not in ("start", "end"))))).alias("_f"))
    ordered = F.transform("_f", lambda f: F.struct(*(f[k].alias(k) for k in FIELDS))).cast(FINDING)
    joined = rows.join(stored, "document_id", "left")
    known = joined.filter("_f IS NOT NULL").withColumn("findings", ordered).withColumn("fresh", F.lit(False))
    live = scan.scan_array(joined.filter("_f IS NULL"), text_col="raw_content").withColumn("fresh", F.lit(True))
    rows = known.drop("_f").unionByName(live.drop("_f"))

    refused = None
    if overrides is not None:
        placed = findings.withColumn("location", F.concat_ws("-", "start", "end"))
        placed = placed if "finding_id" in placed.columns else placed.withColumn("finding_id", F.lit(None).cast("string"))
        picked = reports.resolve_overrides(placed, overrides).filter("override IS NOT NULL OR override_error")
        by_document = picked.groupBy("document_id").agg(F.map_from_entries(F.collect_set(F.struct("location", "override"))).alias("_chosen"), F.bool_or("override_error").alias("_forbidden"))
        rows = rows.join(by_document, "document_id", "left")
        refused = rows.filter("_forbidden").select("document_id", F.lit(None).cast("string").alias("output_type"), F.lit(FORBIDDEN).alias("error"))
        rows = rows.filter(~F.coalesce("_forbidden", F.lit(False))).drop("_forbidden")
    clean = sanitize.sanitize(sanitize.with_policy(rows, profile, policies).drop("sanitized_content", "risk_after"), "raw_content", overrides=F.col("_chosen") if overrides is not None else None)
    clean = stage(sanitize.residual_risk(clean).drop("_chosen", "policy"))

    kept = ["title", "sanitized_content", "risk_before"]
    open_ = clean.filter("NOT blocked").select("document_id", *kept, F.lit(profile).alias("profile"))
    made = outputs.offline_artefacts(open_, types, kept) if generated is None else generated.join(open_, "document_id").withColumn("model", F.lit("generated"))
    made = made.withColumn("model", F.lit("offline")) if generated is None else made
    made = stage(made)
    failed = made.filter("error IS NOT NULL").select("document_id", "output_type", "error")
    block = F.array(*map(F.lit, chosen["block"] or [])).cast("array<string>")
    valid = stage(outputs.validate_outputs(made.filter("error IS NULL"), "output", "sanitized_content", "risk_before", block).drop("sanitized_content"))
    transformations = valid.select(
        "document_id", F.lit(profile).alias("profile"), "output_type", "model", F.col("final_output").alias("output_content"), "grounding", "policy_status", "output_dlp", F.col("risk_delta").cast("int").alias("risk_delta"),
        F.col("leakage_count").cast("int").alias("leakage_count"), "citations", F.lit(batch_id).cast("string").alias("batch_id"), at.alias("created_at"),
    )

    count = transformations.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"))
    status = F.when(F.col("blocked"), "BLOCKED").when(F.col("_n") > 0, "TRANSFORMED").otherwise("SANITIZED")
    changed = clean.join(count, "document_id", "left").withColumn("status", status).withColumn("metadata", F.col("metadata").withField("sanitized_policy", F.lit(profile)))
    fresh = _findings(clean.filter("fresh")).select(*(F.col(f) for f in ["document_id", *FIELDS, "stage"]))
    all_ = findings.join(clean.select("document_id"), "document_id", "left_semi").unionByName(fresh, allowMissingColumns=True)
    acts = each(clean, F.col("actions"), "a", "document_id").select("document_id", "a.start", "a.end", F.col("a.action").alias("_action")).dropDuplicates(["document_id", "start", "end"])
    acted = all_.join(acts, ["document_id", "start", "end"], "left").withColumn("applied_action", F.when((F.col("stage") == "INPUT") & F.col("_action").isNotNull(), F.col("_action")).otherwise(F.col("applied_action"))).drop("_action")

    s = lambda c: F.col(c).cast("string")
    overridden = F.size(F.filter("actions", lambda a: a["overridden"]))
    applied = F.when(F.col("blocked"), F.lit(f"{profile}: blocked, no prose is left.")).otherwise(
        F.concat(F.lit(f"{profile}: "), F.size("actions").cast("string"), F.lit(" actions, "), overridden.cast("string"), F.lit(" by reviewers, risk after "), s("risk_after"), F.lit("."))
    )
    told = F.concat("output_type", F.lit(f" under {profile} by "), "model", F.lit(": grounding "), "grounding", F.lit(", leaks "), s("leakage_count"), F.lit(", risk change "), s("risk_delta"), F.lit("."))
    let_go = F.concat("output_type", F.when(F.col("output_dlp") == "PASS", F.lit(": released.")).otherwise(F.concat(F.lit(": "), s("leakage_count"), F.lit(" leaks repaired."))))
    audit = (
        event(clean, "policy_engine", "POLICY_APPLY", applied, at).unionByName(event(valid, "llm_adapter", "TRANSFORM", told, at))
        .unionByName(event(valid, "output_validator", F.when(F.col("output_dlp") == "PASS", "RELEASE").otherwise("DLP_BLOCK"), let_go, at))
        .unionByName(event(failed, "llm_adapter", "TRANSFORM", F.concat("output_type", F.lit(f" under {profile} failed: "), "error"), at))
    )
    errors = closed.unionByName(failed) if refused is None else closed.unionByName(failed).unionByName(refused)
    return Outcome(changed.select(*(c for c in documents.columns if c in changed.columns)), acted.select(*findings.columns), transformations, audit, errors)


def run_pipeline_into(store: Store, ids: DataFrame, profile: str = policy.DEFAULT, output_types: list[str] | None = None, overrides: DataFrame | None = None, generated: DataFrame | None = None, batch_id: str | None = None, at: datetime | None = None) -> tuple[int, DataFrame]:
    """(version, errors): stored documents through ``run_pipeline``, with all that it changes in one commit. Unknown ids are told as errors."""
    documents, findings = store.of("documents", ids), store.of("findings", ids)
    done = run_pipeline(documents, findings, profile, output_types, overrides, generated, batch_id=batch_id, at=at, stage=store.stage)
    touched = store.stage(done.documents)
    known = touched.select("document_id")
    version = store.commit(Change("documents", touched, known), Change("findings", done.findings, known), Change("transformations", done.transformations), Change("audit", done.audit))
    missing = ids.select("document_id").distinct().join(documents.select("document_id"), "document_id", "left_anti").select("document_id", F.lit(None).cast("string").alias("output_type"), F.lit("Not found.").alias("error"))
    return version, done.errors.unionByName(missing)


def bulk_ingest_into(store: Store, items: DataFrame, pipeline: bool = False, profile: str = policy.DEFAULT, output_types: list[str] | None = None, stop_on_error: bool = False, at: datetime | None = None) -> DataFrame:
    """Batches of contents (batch_id, seq, filename, mime_type, text) into the store; returns their outcomes (batch_id, seq, document_id, outcome, error).

    A content that is empty, or that the quality gate turns down, fails by itself; the limits of a batch
    fail it as a whole. With ``stop_on_error`` what follows a failure is cancelled. Of equal contents the
    first that is stored stays, in order of batch and seq; content that the store has is skipped too.
    Documents that are stored get ids from their batch and place.
    """
    normal = items.withColumn("_normal", normalize_text(F.col("text")))
    text, warning = quality_gate(F.col("_normal"))
    gated = normal.withColumns({"text": text, "error": warning}).drop("_normal")
    rows = gated.withColumns({"sha256": F.sha2(F.col("text").cast("binary"), 256), "size_bytes": F.octet_length("text"), "document_id": F.concat_ws("-", F.col("batch_id").cast("string"), F.col("seq").cast("string"))})
    rows = store.stage(rows)
    plain = {c: F.lit(False) for c in ("duplicate", "blocked", "pipeline")} | {"pipeline_error": F.lit(None).cast("string")}
    judged = reports.bulk_outcomes(rows.withColumns(plain), stop_on_error).withColumnRenamed("outcome", "_first").drop(*plain)
    alive = judged.filter("_first = 'ingested'")
    order = F.struct("batch_id", "seq")
    first = alive.groupBy("sha256").agg(F.min(order).alias("_kept"))
    held = store.table("documents").select(F.col("metadata.sha256").alias("sha256")).distinct().withColumn("_held", F.lit(True))
    told = judged.join(first, "sha256", "left").join(held, "sha256", "left")
    again = (F.col("_first") == "ingested") & (F.coalesce("_held", F.lit(False)) | (order != F.col("_kept")))
    told = store.stage(told.withColumn("outcome", F.when(again, "skipped").otherwise(F.col("_first"))).drop("_first", "_kept", "_held"))
    new = told.filter("outcome = 'ingested'").select("document_id", "filename", "mime_type", "text")
    ingest_into(store, new, at=at)
    if not pipeline:
        return told.select("batch_id", "seq", "document_id", "outcome", "error")
    _, errors = run_pipeline_into(store, new.select("document_id"), profile, output_types, at=at)
    status = store.of("documents", new.select("document_id")).select("document_id", F.col("status").alias("_status"))
    lost = errors.groupBy("document_id").agg(F.min("error").alias("_lost"))
    ran = told.join(status, "document_id", "left").join(lost, "document_id", "left")
    outcome = F.when(F.col("outcome") != "ingested", F.col("outcome")).when(F.col("_status") == "BLOCKED", "blocked").when(F.col("_status") == "TRANSFORMED", "pipelined").otherwise("pipeline-failed")
    return ran.select("batch_id", "seq", "document_id", outcome.alias("outcome"), F.coalesce("error", "_lost").alias("error"))
