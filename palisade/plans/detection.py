"""Detectors one by one, the whole scan, risk and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.spans import each
from palisade.operators import risk, scan
from palisade.operators.detectors import ALL, INVISIBLE
from palisade.operators.detectors import SMUGGLED as SMUGGLE_MARKS
from palisade.plans.detector_sql import PLANTED, detector_sql, findings_cte


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan over as many tasks as there are cores. Reading takes milliseconds a MB and what follows seconds, so a table of fewer row groups is dealt out; a larger one is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a snippet behind each text, so that every detector has something to find."""
    return spread(documents(spark, sf_dir)).select("doc_id", F.expr(PLANTED).alias("text"), "lang", "source")


#: Texts with invisible characters, in some of which a directive hides.
SMUGGLED = "CASE doc_id % 4 WHEN 0 THEN concat(text, ' dis{{z}}regard', ' it') WHEN 1 THEN concat('jail', {zero}, 'break ', text) WHEN 2 THEN concat(text, ' sys', {zero}, 'tem over', {zero}, 'ride') ELSE concat(text, {zero}, ' nothing') END".replace("{{z}}", "', {zero}, '")


def _flat(df: DataFrame) -> DataFrame:
    return each(df, F.col("f"), "f", "doc_id").select(
        "doc_id", "f.type", F.col("f.start").alias("span_start"), F.col("f.end").alias("span_end"), "f.matched_text", "f.masked_text", F.round("f.confidence", 6).alias("confidence")
    )


def _detector(d):
    return lambda spark, sf_dir: _flat(scan.find_in(planted(spark, sf_dir), d).select("doc_id", F.col("found").alias("f")))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(planted(spark, sf_dir).select("doc_id", scan.find_assigned(F.col("text")).alias("f")))


def smuggled(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(SMUGGLED.format(zero="'\\u200B'"))
    return _flat(documents(spark, sf_dir).select("doc_id", text.alias("text")).select("doc_id", scan.find_smuggled(F.col("text")).alias("f")))


def _scan(config: scan.ScanConfig):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = each(scan.scan_array(planted(spark, sf_dir).select("doc_id", "text"), config), F.col("findings"), "f", "doc_id")
        return rows.select("doc_id", "f.category", "f.type", F.col("f.start").alias("span_start"), F.col("f.end").alias("span_end"), "f.matched_text", "f.masked_text")

    return run


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.scan_array(planted(spark, sf_dir).select("doc_id", "text")).select("doc_id", risk.risk(F.col("findings")).alias("r"))
    return rows.select("doc_id", *(F.col(f"r.{n}").cast("long").alias(n) for n in (*risk.NAMES.values(), "total")), "r.classification")


def classified_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir).select("doc_id", "lang", "text"))
    rows = scan.scan_array(docs).select("lang", risk.risk(F.col("findings")).alias("r"), F.size("findings").alias("n"))
    return rows.groupBy("lang", F.col("r.classification").alias("classification")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").cast("long").alias("n_findings"), F.sum("r.total").cast("long").alias("total_risk"))


_SEVERITY = "CASE severity WHEN 'LOW' THEN 4 WHEN 'MEDIUM' THEN 10 WHEN 'HIGH' THEN 20 ELSE 35 END"
_CATEGORY = "CASE category WHEN 'PII' THEN 1.0::DOUBLE WHEN 'SECRET' THEN 1.4::DOUBLE WHEN 'PROMPT_INJECTION' THEN 1.6::DOUBLE WHEN 'INTERNAL_ASSET' THEN 0.85::DOUBLE ELSE 0.9::DOUBLE END"
_CREDIT = "CASE action WHEN 'REDACT' THEN 0.6::DOUBLE WHEN 'QUARANTINE' THEN 0.8::DOUBLE WHEN 'BLOCK' THEN 0.9::DOUBLE WHEN 'REPLACE' THEN 0.4::DOUBLE WHEN 'MASK' THEN 0.3::DOUBLE ELSE 0::DOUBLE END"


def _ordered_sum(value: str, where: str) -> str:
    return f"list_reduce(list_concat([0::DOUBLE], coalesce(list({value} ORDER BY s, confidence) FILTER (WHERE {where}), [])), lambda a, x: a + x)"


def risk_cte(source: str) -> str:
    """..., risk AS: one row per document of the table t."""
    w = f"{_SEVERITY}::DOUBLE * confidence * {_CATEGORY}"
    parts = ", ".join(f"{_ordered_sum(w, f'category = {chr(39)}{c}{chr(39)}')} AS {n}" for c, n in risk.NAMES.items())
    return findings_cte(source=source) + f""",
sums AS (SELECT doc_id, {parts}, {_ordered_sum(f"{_SEVERITY}::DOUBLE * {_CREDIT}", "true")} AS credit,
  bool_or(category = 'PROMPT_INJECTION') AS injected, bool_or(category = 'SECRET' AND severity = 'CRITICAL') AS critical,
  bool_or(type IN ('AADHAAR', 'PAN', 'CREDIT_CARD', 'SSN', 'PASSPORT', 'DRIVERS_LICENSE', 'BANK_ACCOUNT', 'IBAN')) AS regulated, count(*) AS n FROM findings GROUP BY doc_id),
residual AS (SELECT *, greatest(0::DOUBLE, pii * 1.0::DOUBLE + secrets * 1.0::DOUBLE + prompt_injection * 1.0::DOUBLE + internal_assets * 0.75::DOUBLE + unsafe_urls * 0.75::DOUBLE - credit * 0.4::DOUBLE) AS r FROM sums),
risk AS (
  SELECT t.doc_id, coalesce(n, 0) AS n, coalesce(floor(pii + 0.5::DOUBLE)::BIGINT, 0) AS pii, coalesce(floor(secrets + 0.5::DOUBLE)::BIGINT, 0) AS secrets, coalesce(floor(prompt_injection + 0.5::DOUBLE)::BIGINT, 0) AS prompt_injection,
    coalesce(floor(internal_assets + 0.5::DOUBLE)::BIGINT, 0) AS internal_assets, coalesce(floor(unsafe_urls + 0.5::DOUBLE)::BIGINT, 0) AS unsafe_urls, least(100, coalesce(floor(r + 0.5::DOUBLE)::BIGINT, 0)) AS total, coalesce(r, 0::DOUBLE) AS residual,
    CASE WHEN injected AND (critical OR r > 60) THEN 'RESTRICTED' WHEN critical OR regulated OR r >= 55 THEN 'CONFIDENTIAL' WHEN r > 0 THEN 'INTERNAL' ELSE 'PUBLIC' END AS classification
  FROM t LEFT JOIN residual USING (doc_id))"""


_PLANTED = f"SELECT doc_id, {PLANTED} AS text FROM documents"
_SPANS = "SELECT doc_id, category, type, s AS span_start, e AS span_end, m AS matched_text, masked AS masked_text FROM findings"

QUERIES = {f"detect_{name}": _detector(d) for name, d in ALL.items()} | {
    "detect_assigned_credential": assigned,
    "detect_smuggled": smuggled,
    "scan": _scan(scan.ScanConfig()),
    "scan_confident": _scan(scan.ScanConfig(min_confidence=0.9)),
    "scan_without_pii": _scan(scan.ScanConfig(pii=False)),
    "risk_scores": risk_scores,
    "classified_by_language": classified_by_language,
}
SQL = {f"detect_{name}": detector_sql(d) for name, d in ALL.items()} | {
    "detect_assigned_credential": detector_sql(None),
    "detect_smuggled": f"""WITH t AS (SELECT doc_id, {SMUGGLED.format(zero="chr(8203)")} AS text FROM documents), f AS (SELECT *, length(regexp_extract(text, '^[^{INVISIBLE}]*'))::INT AS s, lower(regexp_replace(text, '[{INVISIBLE}]', '', 'g')) AS clean FROM t WHERE regexp_matches(text, '[{INVISIBLE}]'))
SELECT doc_id, 'HIDDEN_INSTRUCTION' AS type, s AS span_start, least(length(text), s + 8)::INT AS span_end, '[invisible-chars]' AS matched_text, '' AS masked_text, 0.7::DOUBLE AS confidence FROM f WHERE {" OR ".join(f"contains(clean, '{w}')" for w in SMUGGLE_MARKS)}""",
    "scan": f"{findings_cte()} {_SPANS}",
    "scan_confident": f"{findings_cte('confidence >= 0.9')} {_SPANS}",
    "scan_without_pii": f"""{findings_cte("category <> 'PII'")} {_SPANS}""",
    "risk_scores": f"{risk_cte(_PLANTED)} SELECT doc_id, pii, secrets, prompt_injection, internal_assets, unsafe_urls, total, classification FROM risk",
    "classified_by_language": f"{risk_cte('SELECT doc_id, text FROM documents')} SELECT lang, classification, count(*) AS n_documents, sum(n)::BIGINT AS n_findings, sum(total)::BIGINT AS total_risk FROM risk JOIN documents USING (doc_id) GROUP BY lang, classification",
}
