"""Reports, lists and joins over store tables that are derived from the driver's tables.

The expressions are written once and run by both engines, so both see the same store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import policy as P
from palisade.operators import reports as R
from palisade.streaming import stream

STORE = {
    "store_documents": ("documents", {
        "document_id": "doc_id", "filename": "concat('file-', CAST(doc_id AS STRING), '.txt')", "title": "substr(text, 1, 20)", "size_bytes": "n_chars", "sha256": "md5(text)", "seq": "doc_id",
        "status": "CASE doc_id % 5 WHEN 0 THEN 'UPLOADED' WHEN 1 THEN 'SCANNED' WHEN 2 THEN 'SANITIZED' WHEN 3 THEN 'TRANSFORMED' ELSE 'BLOCKED' END",
        "classification": "CASE doc_id * 7 % 11 % 4 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'CONFIDENTIAL' ELSE 'RESTRICTED' END",
        "risk_score": "n_chars % 101", "risk_before": "n_chars % 101", "risk_after": "n_chars % 37", "created_at": "doc_id * 7919 % 100003", "sanitized_content": "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN substr(text, 1, 600) ELSE text END",
    }),
    "store_findings": ("conversations", {
        "document_id": "conv_id", "finding_id": "conv_id * 1000 + turn", "start": "turn * 10", "end": "turn * 10 + 5", "location": "CAST(turn * 10 AS STRING)", "stage": "CASE WHEN turn % 4 = 3 THEN 'OUTPUT' ELSE 'INPUT' END",
        "category": "CASE length(text) % 5 WHEN 0 THEN 'PII' WHEN 1 THEN 'SECRET' WHEN 2 THEN 'PROMPT_INJECTION' WHEN 3 THEN 'INTERNAL_ASSET' ELSE 'UNSAFE_URL' END", "type": "concat('T', CAST(length(text) % 7 AS STRING))",
        "severity": "CASE length(text) % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END", "confidence": "CAST(length(text) % 100 AS DOUBLE) / 100", "matched_text": "text", "applied_action": "CASE WHEN turn % 3 = 0 THEN 'MASK' END",
    }),
    "store_transformations": ("documents", {
        "document_id": "CAST(floor(doc_id / 3) AS BIGINT)", "transformation_id": "doc_id", "created_at": "doc_id * 31 % 97", "output_type": "CASE doc_id % 3 WHEN 0 THEN 'FAQ' WHEN 1 THEN 'BLOG_POST' ELSE 'NEWSLETTER' END",
        "profile": "CASE doc_id % 2 WHEN 0 THEN 'HR_SAFE' ELSE 'PUBLIC_RELEASE' END", "output_dlp": "CASE WHEN n_chars % 3 = 0 THEN 'FAIL' ELSE 'PASS' END", "leakage_count": "n_chars % 3", "grounding": "CASE WHEN n_chars % 5 = 0 THEN 'FAIL' ELSE 'PASS' END", "policy_status": "CASE WHEN n_chars % 15 > 3 THEN 'PASS' ELSE 'FAIL' END",
    }),
    "store_audit": ("events", {"audit_id": "event_id", "document_id": "user_id", "actor": "concat('u', CAST(user_id % 7 AS STRING))", "action": "upper(event_type)", "detail": "props", "timestamp": "ts"}),
    "store_items": ("documents", {
        "batch_id": "CAST(floor(doc_id / 12) AS BIGINT) - CASE WHEN CAST(floor(doc_id / 12) AS BIGINT) % 7 = 1 THEN 1 ELSE 0 END", "seq": "doc_id", "size_bytes": "n_chars * 2000", "error": "CASE WHEN doc_id % 13 = 0 THEN 'unreadable' END", "duplicate": "doc_id % 9 = 1", "blocked": "doc_id % 11 = 2", "pipeline": "doc_id % 2 = 0", "pipeline_error": "CASE WHEN doc_id % 17 = 4 THEN 'x' END",
    }),
    "store_changes": ("documents", {
        "scope": "CAST(floor(doc_id / 25) AS BIGINT)", "seq": "doc_id", "op": "CASE doc_id * 5 % 13 % 6 WHEN 3 THEN 'update' WHEN 4 THEN 'delete' WHEN 5 THEN 'update' ELSE 'create' END",
        "name": "CASE doc_id * 11 % 17 WHEN 0 THEN 'HR_SAFE' WHEN 1 THEN 'lower' ELSE concat('POLICY_', CAST(n_chars % 5 AS STRING)) END",
        "mask": "CASE n_chars % 7 WHEN 0 THEN NULL WHEN 1 THEN split('EMAIL', ',') WHEN 2 THEN split('PHONE', ',') WHEN 3 THEN split('EMAIL,PAN', ',') ELSE split('IBAN', ',') END",
        "remove": "CASE n_chars % 11 WHEN 0 THEN split('PHONE', ',') WHEN 1 THEN split('EMAIL', ',') WHEN 2 THEN split(lang, ',') WHEN 3 THEN split('IBAN,SSN', ',') END",
    }),
    "store_overrides": ("conversations", {
        "document_id": "conv_id", "seq": "turn", "finding_id": "CASE WHEN turn % 2 = 0 THEN conv_id * 1000 + turn % 3 END", "location": "CAST(turn % 3 * 10 AS STRING)", "type": "concat('T', CAST(length(text) % 7 AS STRING))",
        "action": "CASE length(text) % 3 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'MASK' ELSE 'REDACT' END",
    }),
}


def store(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = STORE[f"store_{name}"]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*(F.expr(e).alias(c) for c, e in columns.items()))


def _changed(spark, sf_dir):
    """Each scope's changes to its own policies, of which it may have three."""
    current = P.policies(spark).withColumn("scope", F.lit(None).cast("long"))
    return P.fold_policy_changes(current, store(spark, sf_dir, "changes"), 3, "scope")


def _ledger(spark, sf_dir):
    buckets = F.col("reason").contains("unknown entry") | F.col("reason").contains("appears in both")
    return P.policy_verdicts(_changed(spark, sf_dir)).select("scope", "seq", "name", "op", F.when(buckets, "buckets").otherwise(F.col("reason")).alias("reason"))


def _held(spark, sf_dir):
    rows = _changed(spark, sf_dir).select("scope", F.explode(F.map_entries("held")).alias("p"))
    return rows.select("scope", F.col("p.key").alias("name"), F.array_join("p.value.mask", ",").alias("mask"), F.array_join("p.value.remove", ",").alias("remove"))


def _other_audit(spark, sf_dir):
    """What batches, deletions and comparisons leave in the audit."""
    docs = store(spark, sf_dir, "documents")
    gone = docs.join(_ids(spark, sf_dir).distinct(), "document_id", "left_semi").select("document_id", "title")
    rows = R.bulk_audit(R.bulk_summary(R.bulk_outcomes(store(spark, sf_dir, "items"))))
    rows = rows.unionByName(R.deletion_audit(gone)).unionByName(R.deletion_audit(docs.filter("status = 'BLOCKED'"), bulk=False))
    return rows.unionByName(R.comparison_audit(store(spark, sf_dir, "transformations").withColumn("document_id", F.col("document_id").cast("string"))))


def _choices(spark, sf_dir):
    """The findings that each choice of a reviewer is open to."""
    found = store(spark, sf_dir, "findings").filter("stage = 'INPUT'").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return _longs(P.allowed_override_actions(spark).join(found, "category"))


def _audit_counts(spark, sf_dir):
    """The running counts of the audit's stream, over all of it at once."""
    rows = stream.stream_audit_counts(store(spark, sf_dir, "audit"))
    return rows.select(F.date_format("since", "yyyy-MM-dd HH:mm").alias("since"), "action", "n")


#: One change a step; held: the scope's policies.
_FOLD = """, c AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY seq) AS i FROM store_changes),
st AS (SELECT scope, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS name, NULL::VARCHAR AS op, NULL::VARCHAR AS reason, []::STRUCT(n VARCHAR, m VARCHAR[], r VARCHAR[])[] AS held FROM c WHERE i = 1
  UNION ALL SELECT scope, i, seq, name, op, reason, CASE WHEN reason IS NOT NULL THEN held WHEN op = 'delete' THEN others ELSE list_append(others, {'n': name, 'm': m, 'r': r}) END
  FROM (SELECT *, CASE WHEN op = 'create' AND NOT regexp_full_match(name, '[A-Z][A-Z0-9_]+') THEN 'invalid name' WHEN name = 'HR_SAFE' THEN 'built-in policies cannot be changed'
      WHEN op <> 'create' AND old IS NULL THEN 'no such policy' WHEN op = 'update' AND mask IS NULL AND remove IS NULL THEN 'nothing to update'
      WHEN op <> 'delete' AND (len(list_intersect(m, r)) > 0 OR len(list_filter(r, lambda x: x NOT IN ('PHONE', 'EMAIL', 'IBAN', 'SSN'))) > 0) THEN 'buckets'
      WHEN op = 'create' AND len(held) >= 3 THEN 'too many custom policies' WHEN op = 'create' AND old IS NOT NULL THEN 'name is taken' END AS reason
    FROM (SELECT *, coalesce(mask, CASE WHEN op <> 'create' THEN old.m END, []) AS m, coalesce(remove, CASE WHEN op <> 'create' THEN old.r END, []) AS r
      FROM (SELECT c.scope, c.i, c.seq, c.name, c.op, c.mask, c.remove, held, list_filter(held, lambda x: x.n <> c.name) AS others, list_filter(held, lambda x: x.n = c.name)[1] AS old
        FROM st JOIN c ON st.scope = c.scope AND c.i = st.i + 1))))"""

_WITH = "WITH RECURSIVE " + ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS "{c}"' for c, e in cols.items())} FROM {t})" for n, (t, cols) in STORE.items()) + " "


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if k in ("int", "bigint") else F.col(c) for c, k in df.dtypes))


def _q(f, *tables):
    return lambda spark, sf_dir: _longs(f(*(store(spark, sf_dir, t) for t in tables)))


def _ids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").select((F.col("doc_id") * 2).alias("document_id"))


def _deleted(spark, sf_dir):
    docs = store(spark, sf_dir, "documents")
    gone, left, children, audit = R.bulk_delete(docs, _ids(spark, sf_dir), [store(spark, sf_dir, "findings"), store(spark, sf_dir, "transformations")], store(spark, sf_dir, "audit"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return (
        count(gone, "deleted").unionByName(count(left, "documents")).unionByName(count(children[0], "findings")).unionByName(count(children[1], "transformations"))
        .unionByName(count(audit.filter("document_id is null"), "audit without document"))
    )


def _duplicates(spark, sf_dir):
    """One half of the documents comes as a batch to the other."""
    docs = store(spark, sf_dir, "documents")
    return R.skip_duplicates(docs.filter("document_id % 2 = 1"), docs.filter("document_id % 2 = 0")).select("document_id", "outcome")


def _stored_or_live(spark, sf_dir):
    """Findings of credentials are stored, all others live; documents with stored ones of their input use those alone."""
    rows = store(spark, sf_dir, "findings").select("document_id", "location", "type", "category", "stage")
    docs = rows.select("document_id").distinct()
    used, fresh = R.stored_or_live(docs, rows.filter("category = 'SECRET'"), rows.filter("category <> 'SECRET' AND stage = 'INPUT'"))
    return used.withColumn("to_store", F.lit(False)).unionByName(fresh.select(*used.columns).withColumn("to_store", F.lit(True)))


def _security(spark, sf_dir):
    rows = R.security_report(*(store(spark, sf_dir, t) for t in ("documents", "findings", "transformations")))
    top = F.array_join(F.transform("top_findings", lambda f: F.concat_ws(":", f["rank"].cast("string"), f["type"], F.length(f["shown"]).cast("string"))), ",")
    return _longs(rows.withColumns({"top_findings": top, "sanitized_preview": F.sha2(F.col("sanitized_preview").cast("binary"), 256)}))


def _reports(spark, sf_dir):
    """Stored reports with as many entities, indicators and techniques as lengths say."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = lambda n: F.transform(F.sequence(F.lit(1), (F.col("n_chars") % n) + 1), lambda i: i)
    return docs.select(F.col("doc_id").alias("document_id"), some(7).alias("entities"), some(5).alias("iocs"), F.when(F.col("doc_id") % 9 > 0, some(3)).alias("ttps"))


def _upserted(spark, sf_dir):
    rows = store(spark, sf_dir, "transformations")
    last = R.latest_transformation(rows)
    changed = last.filter("leakage_count > 0").withColumn("output_dlp", F.lit("RECHECKED"))
    return _longs(R.upsert(last, changed.select(*last.columns), "document_id").select("document_id", "output_dlp", "leakage_count"))


def _updated(spark, sf_dir):
    actions = store(spark, sf_dir, "overrides").select("document_id", "location", "action")
    return R.update_actions(store(spark, sf_dir, "findings"), actions).select("finding_id", "applied_action")


def _children(spark, sf_dir):
    t = {n: store(spark, sf_dir, n) for n in ("documents", "findings", "transformations")}
    reports = t["documents"].select("document_id", F.array(F.lit("a")).alias("ttps"))
    rows = R.documents_with_children(t["documents"], t["findings"], t["transformations"], reports)
    return rows.select(
        "document_id", F.coalesce(F.size("findings"), F.lit(0)).cast("long").alias("n_findings"), F.array_join(F.transform("findings", lambda f: f["type"]), ",").alias("types"),
        F.array_join(F.transform("transformations", lambda f: f["output_type"]), ",").alias("outputs"), F.col("n_ttps").cast("long").alias("n_ttps"),
    )


def _evaluated(spark, sf_dir):
    f = store(spark, sf_dir, "findings")
    labels = store(spark, sf_dir, "overrides").select("document_id", (F.col("seq") * 7).alias("start"), (F.col("seq") * 7 + 3).alias("end"), F.expr("CASE WHEN action = 'ALLOW' THEN 'PII' WHEN action = 'MASK' THEN 'SECRET' ELSE 'UNSAFE_URL' END").alias("category"))
    rows = R.precision_recall(f.select("document_id", "category", "start", "end"), labels)
    return rows.select("category", "found", "labelled", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


QUERIES = {
    "security_report": _security,
    "intel_totals": lambda spark, sf_dir: _longs(R.intel_totals(_reports(spark, sf_dir))),
    "dashboard": lambda spark, sf_dir: _longs(R.dashboard(*(store(spark, sf_dir, t) for t in ("documents", "findings", "transformations")), _reports(spark, sf_dir))),
    "status_counts": _q(R.status_counts, "documents"),
    "findings_by_category": _q(R.findings_by_category, "findings"),
    "documents_by_classification": _q(R.documents_by_classification, "documents"),
    "avg_risk_reduction": _q(R.avg_risk_reduction, "documents"),
    "released_outputs": _q(R.released_outputs, "transformations"),
    "severity_breakdown": _q(R.severity_breakdown, "findings"),
    "category_breakdown": _q(R.category_breakdown, "findings", "transformations"),
    "bulk_summary": _q(lambda i: R.bulk_summary(R.bulk_outcomes(i)), "items"),
    "bulk_outcomes": _q(lambda i: R.bulk_outcomes(i, stop_on_error=True).select("batch_id", "seq", "outcome"), "items"),
    "precision_recall": _evaluated,
    "documents_with_children": _children,
    "audit_with_titles": _q(lambda a, d: R.audit_with_titles(a, d).select("audit_id", "action", "title", "filename"), "audit", "documents"),
    "resolve_overrides": _q(lambda f, o: R.resolve_overrides(f, o).select("finding_id", "override", "override_error"), "findings", "overrides"),
    "skip_duplicates": _duplicates,
    "stored_or_live": _stored_or_live,
    "bulk_delete": _deleted,
    "upsert": _upserted,
    "update_actions": _updated,
    "latest_transformation": _q(lambda t: R.latest_transformation(t, "profile").select("document_id", "profile", "transformation_id", "output_type"), "transformations"),
    "risk_trend": _q(R.risk_trend, "documents"),
    "top_findings": _q(R.top_findings, "findings"),
    "list_documents": _q(lambda d: R.list_documents(d, "SCANNED", 50, 10).select("document_id", "created_at"), "documents"),
    "search_documents": _q(lambda d: R.search_documents(d, "the", "INTERNAL", None, "risk").select("document_id", "title"), "documents"),
    "audit_feed": _q(lambda a: R.audit_feed(a, 100).select("audit_id", "action"), "audit"),
    "search_audit": _q(lambda a: R.search_audit(a, "PUR").select("audit_id"), "audit"),
    "policy_ledger_ops": _ledger,
    "custom_policies": _held,
    "policy_audit": lambda spark, sf_dir: P.policy_audit(P.policy_verdicts(_changed(spark, sf_dir))).groupBy("actor", "action", "detail").agg(F.count(F.lit(1)).alias("n")),
    "list_policies": lambda spark, sf_dir: R.list_policies(P.policies(spark, templates=True).join(store(spark, sf_dir, "transformations").groupBy(F.col("profile").alias("name")).agg(F.count(F.lit(1)).alias("n_outputs")), "name", "left"), active_only=True).select("name", "classification", "audience", "n_outputs"),
    "other_audit_events": _other_audit,
    "allowed_override_actions": _choices,
    "audit_counts": _audit_counts,
    "audit_events": _q(R.audit_events, "documents", "transformations"),
    "rescan": lambda spark, sf_dir: _longs(R.rescan(store(spark, sf_dir, "documents"), _ids(spark, sf_dir)).select("document_id", "status", "risk_after", "sanitized_content")),
}
_CATS = ", ".join(f"count(*) FILTER (category = '{c}' AND stage = 'INPUT') AS {c.lower()}" for c in R.CATEGORIES)
_SEV = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in R.SEVERITIES)
_SHARES = ", ".join(f"floor(100.0::DOUBLE * {s.lower()} / (low + medium + high + critical) + 0.5)::BIGINT AS {s.lower()}_share" for s in R.SEVERITIES)
_OUT = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in R.OUTCOMES if "fail" not in o)
_OUTCOME = "CASE WHEN bad THEN 'failed' WHEN duplicate THEN 'skipped' WHEN pipeline AND blocked THEN 'blocked' WHEN pipeline AND pipeline_error IS NOT NULL THEN 'pipeline-failed' WHEN pipeline THEN 'pipelined' ELSE 'ingested' END"
_BAD = "SELECT *, count(*) OVER b > 20 OR sum(size_bytes) OVER b > 104857600 OR error IS NOT NULL AS bad FROM store_items WINDOW b AS (PARTITION BY batch_id)"
_COUNTED = {o: "IN ('failed', 'pipeline-failed')" if o == "failed" else f"= '{o}'" for o in R.OUTCOMES if o != "pipeline-failed"}
_LAST = "(SELECT * FROM store_transformations QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, transformation_id DESC) = 1)"
_GONE = "(SELECT DISTINCT doc_id * 2 AS document_id FROM labels WHERE toxic = 1 AND doc_id * 2 IN (SELECT doc_id FROM documents))"
_TOTALS = "SELECT count(*) AS reports, sum(n_chars % 7 + 1)::BIGINT AS n_entities, sum(n_chars % 5 + 1)::BIGINT AS n_iocs, sum(CASE WHEN doc_id % 9 > 0 THEN n_chars % 3 + 1 ELSE 0 END)::BIGINT AS n_ttps FROM documents"
_STATUS = "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in R.STATUSES) + ", count(*) FILTER (risk_score >= 50) AS high_risk FROM store_documents"
SQL = {
    "intel_totals": _TOTALS,
    "dashboard": f"""SELECT * FROM ({_STATUS}), (SELECT coalesce(floor(avg(risk_before - risk_after) + 0.5)::BIGINT, 0) AS reduction FROM store_documents WHERE status IN ('SANITIZED', 'TRANSFORMED')),
(SELECT count(*) FILTER (stage = 'INPUT') AS findings, {_CATS} FROM store_findings), (SELECT count(*) FILTER (output_dlp = 'PASS') AS released FROM store_transformations), ({_TOTALS})""",
    "security_report": f""", c AS (SELECT document_id, {_CATS}, {_SEV.replace("severity = ", "stage = 'INPUT' AND severity = ")}, count(*) FILTER (stage = 'OUTPUT') AS n_out FROM store_findings GROUP BY document_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, start, type) AS rank FROM store_findings WHERE stage = 'INPUT'),
top AS (SELECT document_id, string_agg(rank || ':' || type || ':' || length(CASE WHEN category = 'SECRET' THEN '[withheld]' ELSE left(matched_text, 48) END), ',' ORDER BY rank) AS top_findings FROM ranked WHERE rank <= 8 GROUP BY document_id)
SELECT d.document_id, classification, risk_score, risk_before, risk_after, {", ".join(f"coalesce({x.lower()}, 0) AS {x.lower()}" for x in (*R.CATEGORIES, *R.SEVERITIES))}, coalesce(n_out, 0) + coalesce(leakage_count, 0) AS output_leakage,
  coalesce(grounding, 'SKIPPED') AS grounding, coalesce(policy_status, 'SKIPPED') AS policy_status, coalesce(output_dlp, 'SKIPPED') AS output_dlp, coalesce(top_findings, '') AS top_findings,
  sha256(CASE WHEN coalesce(sanitized_content, '') = '' THEN 'No sanitized copy yet.' WHEN length(sanitized_content) > 600 THEN left(sanitized_content, 600) || '…' ELSE sanitized_content END) AS sanitized_preview
FROM store_documents d LEFT JOIN c ON d.document_id = c.document_id LEFT JOIN {_LAST} t ON d.document_id = t.document_id LEFT JOIN top ON d.document_id = top.document_id""",
    "status_counts": "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in R.STATUSES) + ", count(*) FILTER (risk_score >= 50) AS high_risk FROM store_documents",
    "findings_by_category": "SELECT category, count(*) AS n FROM store_findings WHERE stage = 'INPUT' GROUP BY category",
    "documents_by_classification": "SELECT classification, count(*) AS n, floor(100.0::DOUBLE * count(*) / sum(count(*)) OVER () + 0.5)::BIGINT AS share, list_position(['PUBLIC', 'INTERNAL', 'CONFIDENTIAL', 'RESTRICTED', 'UNCLASSIFIED'], classification)::BIGINT AS rank FROM store_documents GROUP BY classification",
    "avg_risk_reduction": "SELECT coalesce(floor(avg(risk_before - risk_after) + 0.5)::BIGINT, 0) AS reduction FROM store_documents WHERE status IN ('SANITIZED', 'TRANSFORMED')",
    "released_outputs": "SELECT count(*) FILTER (output_dlp = 'PASS') AS released FROM store_transformations",
    "severity_breakdown": f"SELECT *, {_SHARES} FROM (SELECT document_id, {_SEV} FROM store_findings WHERE stage = 'INPUT' GROUP BY document_id)",
    "category_breakdown": f"SELECT f.document_id, {', '.join(c.lower() for c in R.CATEGORIES)}, n + coalesce(leakage_count, 0) AS output_leakage FROM (SELECT document_id, {_CATS}, count(*) FILTER (stage = 'OUTPUT') AS n FROM store_findings GROUP BY document_id) f LEFT JOIN {_LAST} t ON f.document_id = t.document_id",
    "bulk_summary": f"SELECT batch_id, count(*) AS total, {_OUT}, count(*) FILTER (outcome IN ('failed', 'pipeline-failed')) AS failed FROM (SELECT batch_id, {_OUTCOME} AS outcome FROM ({_BAD})) GROUP BY batch_id",
    "bulk_outcomes": f"SELECT batch_id, seq, CASE WHEN coalesce(max(bad::INT) OVER (PARTITION BY batch_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'cancelled' ELSE {_OUTCOME} END AS outcome FROM ({_BAD})",
    "precision_recall": """, l AS (SELECT document_id, seq * 7 AS s, seq * 7 + 3 AS e, CASE action WHEN 'ALLOW' THEN 'PII' WHEN 'MASK' THEN 'SECRET' ELSE 'UNSAFE_URL' END AS category FROM store_overrides),
f AS (SELECT document_id, category, start AS s, "end" AS e FROM store_findings),
a AS (SELECT category, count(*) AS found, count(*) FILTER (EXISTS (SELECT 1 FROM l WHERE l.document_id = f.document_id AND l.category = f.category AND f.s < l.e AND f.e > l.s)) AS hit FROM f GROUP BY category),
b AS (SELECT category, count(*) AS labelled, count(*) FILTER (EXISTS (SELECT 1 FROM f WHERE l.document_id = f.document_id AND l.category = f.category AND f.s < l.e AND f.e > l.s)) AS caught FROM l GROUP BY category)
SELECT category, coalesce(found, 0) AS found, coalesce(labelled, 0) AS labelled, round(CASE WHEN found > 0 THEN hit / found END, 6) AS precision, round(CASE WHEN labelled > 0 THEN caught / labelled END, 6) AS recall FROM a FULL JOIN b USING (category)""",
    "documents_with_children": """SELECT d.document_id, coalesce(n, 0) AS n_findings, types, outputs, 1 AS n_ttps FROM store_documents d
LEFT JOIN (SELECT document_id, count(*) AS n, string_agg(type, ',' ORDER BY start, "end", type, category, severity) AS types FROM store_findings GROUP BY document_id) f ON d.document_id = f.document_id
LEFT JOIN (SELECT document_id, string_agg(output_type, ',' ORDER BY created_at DESC, transformation_id DESC) AS outputs FROM store_transformations GROUP BY document_id) t ON d.document_id = t.document_id""",
    "audit_with_titles": "SELECT audit_id, action, title, filename FROM store_audit a LEFT JOIN store_documents d ON a.document_id = d.document_id",
    "resolve_overrides": """, i AS (SELECT * FROM store_findings WHERE stage = 'INPUT'), p AS (SELECT document_id, location, type, arg_min(category, finding_id) AS category FROM i GROUP BY ALL),
m AS (SELECT o.document_id, o.seq, o.action, coalesce(i.location, p.location) AS location, coalesce(i.type, p.type) AS type, coalesce(i.category, p.category) AS category
  FROM store_overrides o LEFT JOIN i ON o.document_id = i.document_id AND o.finding_id = i.finding_id LEFT JOIN p ON o.document_id = p.document_id AND o.location = p.location AND o.type = p.type),
c AS (SELECT document_id, location, type, arg_max(action, seq) AS override, bool_or(action = 'ALLOW' AND category IN ('PROMPT_INJECTION', 'SECRET')) AS bad FROM m WHERE location IS NOT NULL GROUP BY ALL)
SELECT f.finding_id, CASE WHEN stage = 'INPUT' THEN c.override END AS override, coalesce(stage = 'INPUT' AND c.bad, false) AS override_error FROM store_findings f LEFT JOIN c ON f.document_id = c.document_id AND f.location = c.location AND f.type = c.type""",
    "skip_duplicates": "SELECT document_id, CASE WHEN sha256 IN (SELECT sha256 FROM store_documents WHERE document_id % 2 = 0) OR row_number() OVER (PARTITION BY sha256 ORDER BY seq) > 1 THEN 'skipped' ELSE 'ingested' END AS outcome FROM store_documents WHERE document_id % 2 = 1",
    "stored_or_live": """, s AS (SELECT document_id, location, type, category, stage FROM store_findings WHERE category = 'SECRET'), i AS (SELECT * FROM s WHERE stage = 'INPUT'),
f AS (SELECT document_id, location, type, category, stage FROM store_findings WHERE category <> 'SECRET' AND stage = 'INPUT' AND document_id NOT IN (SELECT document_id FROM i))
SELECT *, false AS to_store FROM i UNION ALL SELECT *, false FROM f UNION ALL SELECT *, true FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.document_id = f.document_id AND s.location = f.location AND s.type = f.type)""",
    "bulk_delete": f"""SELECT 'deleted' AS what, count(*) AS n FROM {_GONE} UNION ALL SELECT 'documents', count(*) FROM store_documents WHERE document_id NOT IN {_GONE} UNION ALL SELECT 'findings', count(*) FROM store_findings WHERE document_id NOT IN {_GONE}
UNION ALL SELECT 'transformations', count(*) FROM store_transformations WHERE document_id NOT IN {_GONE} UNION ALL SELECT 'audit without document', count(*) FROM store_audit WHERE document_id IN {_GONE}""",
    "upsert": f"SELECT document_id, CASE WHEN leakage_count > 0 THEN 'RECHECKED' ELSE output_dlp END AS output_dlp, leakage_count FROM {_LAST}",
    "update_actions": """, a AS (SELECT document_id, location, max(action) AS a FROM store_overrides GROUP BY ALL) SELECT finding_id, CASE WHEN stage = 'INPUT' AND a IS NOT NULL THEN a ELSE applied_action END AS applied_action FROM store_findings f LEFT JOIN a ON f.document_id = a.document_id AND f.location = a.location""",
    "latest_transformation": "SELECT document_id, profile, transformation_id, output_type FROM store_transformations QUALIFY row_number() OVER (PARTITION BY document_id, profile ORDER BY created_at DESC, transformation_id DESC) = 1",
    "risk_trend": "SELECT 'D' || row_number() OVER (ORDER BY created_at, document_id) AS label, document_id, risk_before AS before, CASE WHEN status IN ('SANITIZED', 'TRANSFORMED', 'BLOCKED') THEN risk_after ELSE risk_before END AS after FROM (SELECT * FROM store_documents ORDER BY created_at DESC, document_id DESC LIMIT 14)",
    "top_findings": "SELECT document_id, rank, category, type, severity, confidence, CASE WHEN category = 'SECRET' THEN '[withheld]' ELSE left(matched_text, 48) END AS shown FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY confidence DESC, start, type) AS rank FROM store_findings WHERE stage = 'INPUT') WHERE rank <= 8",
    "list_documents": "SELECT document_id, created_at FROM store_documents WHERE status = 'SCANNED' ORDER BY created_at DESC, document_id DESC LIMIT 50 OFFSET 10",
    "search_documents": "SELECT document_id, title FROM store_documents WHERE (contains(lower(title), 'the') OR contains(lower(classification), 'the') OR contains(lower(filename), 'the')) AND classification = 'INTERNAL'",
    "audit_feed": "SELECT audit_id, action FROM store_audit ORDER BY timestamp DESC, audit_id DESC LIMIT 100",
    "search_audit": "SELECT audit_id FROM store_audit WHERE contains(lower(detail), 'pur') OR contains(lower(actor), 'pur') OR contains(lower(action), 'pur')",
    "policy_ledger_ops": _FOLD + " SELECT scope, seq, name, op, reason FROM st WHERE i > 0",
    "custom_policies": _FOLD + ", e AS (SELECT scope, unnest(held) AS p FROM st QUALIFY i = max(i) OVER (PARTITION BY scope)) SELECT scope, p.n AS name, array_to_string(p.m, ',') AS mask, array_to_string(p.r, ',') AS remove FROM e",
    "policy_audit": _FOLD + " SELECT 'analyst' AS actor, 'POLICY_' || upper(op) AS action, 'Policy ' || name || CASE op WHEN 'create' THEN ' created: INTERNAL for INTERNAL' WHEN 'update' THEN ' updated' ELSE ' deleted' END AS detail, count(*) AS n FROM st WHERE i > 0 AND reason IS NULL GROUP BY ALL",
    "list_policies": "SELECT name, classification, audience, n AS n_outputs FROM (VALUES " + ", ".join(f"('{n}', '{v[0]}', '{v[1]}')" for n, v in (P.BUILTIN | P.TEMPLATES).items()) + ") p(name, classification, audience) LEFT JOIN (SELECT profile, count(*) AS n FROM store_transformations GROUP BY profile) ON profile = name",
    "other_audit_events": f"""SELECT NULL::VARCHAR AS document_id, 'analyst' AS actor, 'BULK_INGEST' AS action, 'Batch ' || batch_id || ' of ' || count(*) || ' files: ' || {" || ', ' || ".join(f"count(*) FILTER (outcome {test}) || ' {o}'" for o, test in _COUNTED.items())} AS detail
  FROM (SELECT batch_id, {_OUTCOME} AS outcome FROM ({_BAD})) GROUP BY batch_id
UNION ALL SELECT NULL, 'analyst', 'BULK_DELETE', 'Deleted ' || n || ': ' || (SELECT string_agg('"' || title || '"', ', ' ORDER BY document_id) FROM (SELECT * FROM store_documents WHERE document_id IN {_GONE} ORDER BY document_id LIMIT 5)) || CASE WHEN n > 5 THEN ' and ' || (n - 5) || ' more' ELSE '' END FROM (SELECT count(*) AS n FROM {_GONE}) WHERE n > 0
UNION ALL SELECT NULL, 'analyst', 'DELETE', 'Deleted ' || document_id || ' "' || coalesce(title, '') || '"' FROM store_documents WHERE status = 'BLOCKED'
UNION ALL SELECT document_id::VARCHAR, 'policy_engine', 'POLICY_COMPARE', 'Compared ' || count(DISTINCT profile) || ' policies for ' || output_type || ': ' || string_agg(DISTINCT profile, ', ' ORDER BY profile) FROM store_transformations GROUP BY document_id, output_type""",
    "allowed_override_actions": "SELECT c.category, position::BIGINT AS position, action, n FROM (VALUES " + ", ".join(f"('{c}', {i}, '{a}')" for c, xs in P.CHOICES.items() for i, a in enumerate(xs)) + ") c(category, position, action) JOIN (SELECT category, count(*) AS n FROM store_findings WHERE stage = 'INPUT' GROUP BY category) f ON f.category = c.category",
    "audit_counts": "SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M') AS since, action, count(*) AS n FROM store_audit GROUP BY ALL",
    "audit_events": """SELECT document_id, 'api' AS actor, 'UPLOAD' AS action, 'Uploaded ' || filename || ' (' || size_bytes || ' bytes)' AS detail FROM store_documents
UNION ALL SELECT document_id, 'scanner', 'SCAN', 'Risk ' || risk_before || ', ' || classification FROM store_documents WHERE status <> 'UPLOADED'
UNION ALL SELECT document_id, 'policy', 'POLICY_APPLY', 'Risk ' || risk_before || ' to ' || risk_after FROM store_documents WHERE status IN ('SANITIZED', 'TRANSFORMED', 'BLOCKED')
UNION ALL SELECT document_id, 'pipeline', 'TRANSFORM', output_type FROM store_transformations UNION ALL SELECT document_id, 'dlp', CASE WHEN output_dlp = 'PASS' THEN 'RELEASE' ELSE 'DLP_BLOCK' END, leakage_count || ' leaks' FROM store_transformations""",
    "rescan": f"SELECT document_id, CASE WHEN document_id IN {_GONE} THEN 'SCANNED' ELSE status END AS status, CASE WHEN document_id IN {_GONE} THEN 0 ELSE risk_after END AS risk_after, CASE WHEN document_id NOT IN {_GONE} THEN sanitized_content END AS sanitized_content FROM store_documents",
}
SQL = {k: _WITH.rstrip() + (v if v.startswith(",") else " " + v) for k, v in SQL.items()}
