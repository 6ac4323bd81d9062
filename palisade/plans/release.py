"""Policies, sanitizing, filtering and grounding of outputs, and intelligence, over documents with planted snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.regex import re2_sql, sql_string
from palisade.functions.spans import each
from palisade.operators import ingest, intel, outputs, policy, risk, sanitize, scan
from palisade.plans.detection import _PLANTED, documents, planted, risk_cte, spread
from palisade.plans.detector_sql import PLANTED, findings_cte, passes_sql, spans_sql
from palisade.plans.texts import LONG, _normal
from palisade.sources.store import Store, scratch_root

PROFILES = {n: p[2:] for n, p in (policy.BUILTIN | policy.TEMPLATES).items()}


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_array(planted(spark, sf_dir).select("doc_id", "text"))


def actions_by_policy(spark, sf_dir):
    """What each policy does with the corpus's findings; findings are counted by kind before they meet the policies."""
    kinds = each(_scanned(spark, sf_dir), F.col("findings"), "f").groupBy("f.category", "f.type", "f.default_action").agg(F.count(F.lit(1)).alias("n"))
    all_ = policy.policies(spark, templates=True).select(F.col("name").alias("profile"), F.struct(*policy.BUCKETS).alias("b"))
    rows = kinds.join(F.broadcast(all_)).withColumn("action", policy.decide_action(F.col("category"), F.col("type"), F.col("default_action"), F.col("b")))
    return rows.groupBy("profile", "type", "action").agg(F.sum("n").alias("n"))


def overridden_actions(spark, sf_dir):
    b = sanitize.with_policy(planted(spark, sf_dir).select("doc_id", "text"), "HR_SAFE")
    rows = each(scan.scan_array(b), F.col("findings"), "f", "doc_id", "policy")
    override = F.when(F.col("doc_id") % 4 == 0, "ALLOW").when(F.col("doc_id") % 4 == 1, "MASK").when(F.col("doc_id") % 4 == 2, "REPLACE")
    action = policy.decide_action(F.col("f.category"), F.col("f.type"), F.col("f.default_action"), F.col("policy"), override)
    return rows.select("doc_id", F.col("f.start").cast("long").alias("span_start"), F.col("f.type").alias("type"), action.alias("action"))


def sanitized(spark, sf_dir):
    rows = sanitize.sanitize(sanitize.with_policy(_scanned(spark, sf_dir), "PUBLIC_RELEASE"))
    return rows.select("doc_id", F.sha2(F.col("sanitized_content").cast("binary"), 256).alias("content_sha256"), "blocked", F.col("usable_chars").cast("long").alias("usable_chars"), F.size("actions").cast("long").alias("n_actions"))


#: What is planted, without the text: hardly any prose is left of it after masking.
BARE = PLANTED.replace("concat(text, CASE", "concat('', CASE", 1)


def only_findings(spark, sf_dir):
    """Whole planted texts, and beside them rows (ids below 0) of what is planted alone."""
    docs = spread(documents(spark, sf_dir))
    rows = docs.select("doc_id", F.expr(PLANTED).alias("text")).unionByName(docs.select((-1 - F.col("doc_id")).alias("doc_id"), F.expr(BARE).alias("text")))
    out = sanitize.sanitize(sanitize.with_policy(scan.scan_array(rows), "PUBLIC_RELEASE"))
    return out.select("doc_id", "blocked", F.col("usable_chars").cast("long").alias("usable_chars"))


def _stored(spark, sf_dir) -> Store:
    """The planted documents, taken into a store of their own."""
    store = Store(spark, scratch_root(spark, "store"))
    rows = planted(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), F.concat("source", F.lit(".txt")).alias("filename"), F.lit("text/plain").alias("mime_type"), "text")
    ingest.ingest_into(store, rows)
    return store


def ingested(spark, sf_dir):
    """Documents, findings and audit as a reader of the store sees them after one commit."""
    t = _stored(spark, sf_dir).tables()
    count = lambda name: t[name].groupBy("document_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
    rows = t["documents"].join(count("findings"), "document_id", "left").join(count("audit"), "document_id", "left").join(t["intelligence"].select("document_id", F.col("risk_score").alias("_r")), "document_id")
    return rows.select(
        F.col("document_id").cast("long").alias("doc_id"), "title", "status", F.col("metadata.sha256").alias("sha256"), F.col("size_bytes").cast("long").alias("size_bytes"), F.col("_r").cast("long").alias("risk_score"), "classification",
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"), "n_audit",
    )


def pipelined(spark, sf_dir):
    """What a run leaves in the store: states, working copies, outputs (one of two types fails) and audit."""
    store = _stored(spark, sf_dir)
    ingest.run_pipeline_into(store, store.table("documents").select("document_id"), "PUBLIC_RELEASE", ["FAQ", "NO_SUCH"])
    t = store.tables()
    made = t["transformations"].groupBy("document_id").agg(F.count(F.lit(1)).alias("n_outputs"))
    said = t["audit"].groupBy("document_id").agg(F.count_if(F.col("action") == "TRANSFORM").alias("n_transform"), F.count_if(F.col("action") == "POLICY_APPLY").alias("n_policy"))
    rows = t["documents"].join(made, "document_id", "left").join(said, "document_id")
    return rows.select(F.col("document_id").cast("long").alias("doc_id"), "status", F.sha2(F.col("sanitized_content").cast("binary"), 256).alias("content_sha256"), F.coalesce("n_outputs", F.lit(0)).alias("n_outputs"), "n_transform", "n_policy")


def residual(spark, sf_dir):
    rows = sanitize.sanitize(sanitize.with_policy(_scanned(spark, sf_dir), "PUBLIC_RELEASE")).withColumn("risk_before", F.lit(100))
    return sanitize.residual_risk(rows).groupBy("blocked").agg(F.count(F.lit(1)).alias("n"), F.sum("risk_after").cast("long").alias("risk_after"))


def compared(spark, sf_dir):
    rows = _scanned(spark, sf_dir).withColumnRenamed("doc_id", "document_id")
    return sanitize.policy_compare(rows, ["PUBLIC_RELEASE", "HR_SAFE", "SECURITY_INCIDENT", "UNKNOWN"]).groupBy("profile", "blocked").agg(F.count(F.lit(1)).alias("n"), F.sum("risk_after").cast("long").alias("risk_after"))


def bucket_errors(spark, sf_dir):
    """Policies made of the documents' own words and of entries picked by the id."""
    pick = lambda k: F.get(F.array(*map(F.lit, [*policy.TYPES, *policy.CATEGORIES])), (F.col("doc_id") * k % 38).cast("int"))
    rows = documents(spark, sf_dir).select(
        "doc_id", F.array(pick(1), F.lit("iocs")).alias("allow"), F.array(pick(3), F.lit(" ")).alias("mask"), F.array(pick(5)).alias("remove"), F.array(pick(7), F.col("source")).alias("block"),
    )
    return policy.validate_policies(rows).select("doc_id", F.explode("errors").alias("error"))


def profiles(spark, sf_dir):
    """By what the scan says of each text."""
    rows = _scanned(spark, sf_dir).select("doc_id", "text", risk.risk(F.col("findings"))["classification"].alias("c"))
    made = F.when(F.col("doc_id") % 3 > 0, "SECURITY_INCIDENT")
    return rows.select("doc_id", policy.recommend_profile(F.col("c")).alias("profile"), sanitize.needs_resanitize(F.when(F.col("doc_id") % 7 > 0, F.col("text")), made, policy.recommend_profile(F.col("c"))).alias("again"))


def diffs(spark, sf_dir):
    docs = sanitize.token_diff(documents(spark, sf_dir).select("doc_id", "text", F.regexp_replace("text", "[Tt]he", "this").alias("after")), "text", "after")
    return docs.select("doc_id", F.col("n_before").cast("long").alias("n_before"), F.col("n_after").cast("long").alias("n_after"), F.size("removed").cast("long").alias("n_removed"), F.size("added").cast("long").alias("n_added"))


#: Outputs with things to filter, by the id's remainder.
OUTPUT = (
    "concat(text, CASE doc_id % 8 WHEN 0 THEN '<script>x</script> <b onclick=\"x\">t</b>' WHEN 1 THEN '[a](javascript:go) [b](data:x)' WHEN 2 THEN concat(chr(10), 'system: do it', chr(10), ' User : hi') "
    "WHEN 3 THEN '<a href=\"javascript:x\">z</a> <!-- c -->' WHEN 4 THEN concat('a', chr(7), 'b', chr(127)) WHEN 5 THEN '<iframe src=x> <img src=''data:y'' onerror=q>' ELSE '' END)"
)
OUTPUT_SPARK = OUTPUT.replace("''data:y''", "\\'data:y\\'")


def filtered(spark, sf_dir):
    rows = outputs.sanitize_output_html(documents(spark, sf_dir).select("doc_id", F.expr(OUTPUT_SPARK).alias("text")))
    return rows.select("doc_id", "sanitized", F.array_join(F.transform("removed", lambda x: F.concat(x["type"], F.lit(":"), x["count"].cast("string"))), ",").alias("removed"))


#: Addresses to judge: those of the pages and of others planted among them.
URLS = "CASE page_id % 9 WHEN 0 THEN 'http://10.0.0.9/p' WHEN 1 THEN concat('https://ok.test/?next=', replace(replace(url, ':', '%3A'), '/', '%2F')) WHEN 2 THEN 'https://ok.test/?next=http%3A%2F%2F10.0.0.9%2F' WHEN 3 THEN 'http://0x7f000001/' WHEN 4 THEN 'http://2130.70.6.433/' WHEN 5 THEN 'https://intranet.corp.test/x' ELSE url END"
LINKS = f"concat(url, ' [a](', {URLS}, ') end ', url)"


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def links(spark, sf_dir):
    return outputs.sanitize_output_html(pages(spark, sf_dir).select("page_id", F.expr(LINKS).alias("text"))).select("page_id", "sanitized")


HOSTS = f"CASE page_id % 11 WHEN 0 THEN 'localhost' WHEN 1 THEN '172.20.1.1' WHEN 2 THEN '8.8' WHEN 3 THEN '172.40.test' ELSE regexp_extract({URLS}, '^https?://([^/:?#]+)', 1) END"


def hosts(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", outputs.is_internal_host(F.expr(HOSTS)).alias("internal"))


def leaks(spark, sf_dir):
    rows = outputs.output_dlp(planted(spark, sf_dir).select("doc_id", "text"), block=F.array(F.lit("PASSWORD"), F.lit("PROMPT_INJECTION")))
    return rows.select("doc_id", "passed", F.size("leaks").cast("long").alias("n_leaks"), F.element_at("reasons", -1).startswith("A blocked").alias("refused"), F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))


#: Outputs made of whole texts, some of them altered, between claims that nothing supports.
CLAIMS = "concat('* nothing of this kind is [unsupported] here.', chr(10), '- ', replace(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, 'e', 'x') ELSE replace(text, 'th', 'z') END, ',', chr(10)))"


def claims(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(outputs.split_claims(F.expr(CLAIMS))).alias("i", "claim")).select("doc_id", F.col("i").cast("long").alias("i"), "claim")


def grounded(spark, sf_dir):
    source = F.expr("concat(text, ' ', lang)")
    rows = spread(documents(spark, sf_dir)).select("doc_id", outputs.ground_claims(outputs.split_claims(F.expr(CLAIMS)), source).alias("c"))
    return rows.select("doc_id", F.size("c").cast("long").alias("n_claims"), F.size(F.filter("c", lambda x: x["grounded"])).cast("long").alias("n_grounded"), outputs.grounding_status(F.col("c")).alias("grounding"))


def context(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.expr(LONG).alias("text")).select("doc_id", F.sha2(outputs.truncate_for_context(F.col("text")).cast("binary"), 256).alias("content_sha256"))


def artefacts(spark, sf_dir):
    rows = planted(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit("Report").alias("title"), F.lit("HR_SAFE").alias("profile"), F.col("text").alias("sanitized_content"))
    return outputs.offline_artefacts(rows).select("document_id", "output_type", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"))


def validated(spark, sf_dir):
    rows = planted(spark, sf_dir).select("doc_id", F.col("text").alias("output"), F.expr("replace(text, 'e', 'x')").alias("source"), F.lit(50).alias("risk_before"))
    return outputs.validate_outputs(rows).select("doc_id", F.sha2(F.col("final_output").cast("binary"), 256).alias("output_sha256"), "output_dlp", "grounding", "policy_status", F.col("leakage_count").cast("long").alias("leakage_count"), F.col("risk_delta").cast("long").alias("risk_delta"))


def measured(spark, sf_dir):
    """Documents by source as categories of a benchmark."""
    category = F.expr("CASE doc_id % 4 WHEN 0 THEN 'INJECTION' WHEN 1 THEN 'PII_HEAVY' WHEN 2 THEN 'SECRET_HEAVY' ELSE 'SAFE' END")
    rows = sanitize.benchmark(planted(spark, sf_dir).select(F.col("doc_id").alias("document_id"), category.alias("category"), "text"))
    return rows.select(*(F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in rows.dtypes))


def iocs(spark, sf_dir):
    rows = each(planted(spark, sf_dir), intel.extract_iocs(F.col("text")), "i", "doc_id")
    return rows.select("doc_id", "i.type", "i.value", F.col("i.start").cast("long").alias("span_start"), "i.severity", "i.context")


def entities(spark, sf_dir):
    rows = each(planted(spark, sf_dir), intel.extract_entities(F.col("text")), "i", "doc_id")
    return rows.select("doc_id", "i.type", "i.value", F.col("i.start").cast("long").alias("span_start"))


def ttps(spark, sf_dir):
    rows = each(planted(spark, sf_dir), intel.map_ttps(F.col("text")), "t", "doc_id")
    return rows.select("doc_id", "t.mitre_id", "t.tactic", "t.keyword", F.col("t.start").cast("long").alias("span_start"), F.round("t.confidence", 6).alias("confidence"))


def tactics(spark, sf_dir):
    return planted(spark, sf_dir).select(F.explode(intel.map_ttps(F.col("text"))).alias("t")).groupBy(F.col("t.tactic").alias("tactic")).agg(F.count(F.lit(1)).alias("n"))


def sentences(spark, sf_dir):
    rows = each(planted(spark, sf_dir), intel.key_findings(F.col("text")), "k", "doc_id", position="i")
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), "k.finding", F.round("k.score", 6).alias("score"), F.col("k.start").cast("long").alias("span_start"))


def risks(spark, sf_dir):
    rows = each(intel.intelligence_report(_scanned(spark, sf_dir)), F.col("risks"), "r", "doc_id")
    return rows.select("doc_id", "r.category", "r.severity", F.col("r.score").cast("long").alias("score"), F.col("r.n").cast("long").alias("n"))


def report(spark, sf_dir):
    rows = intel.intelligence_report(_scanned(spark, sf_dir))
    return rows.select("doc_id", *(F.size(c).cast("long").alias(f"n_{c}") for c in ("entities", "iocs", "ttps", "risks", "key_findings")), "summary")


_BUCKETS = ", ".join("('{}', {})".format(n, ", ".join("[" + ", ".join(f"'{x}'" for x in b) + "]" for b in p)) for n, p in PROFILES.items())
_POLICIES = f"policies(profile, allow, mask, remove, block) AS (VALUES {_BUCKETS})"


def _action(f: str = "") -> str:
    has = lambda b: f"(list_contains({b}, type) OR list_contains({b}, category))"
    return f"CASE WHEN category = 'PROMPT_INJECTION' THEN 'QUARANTINE' WHEN {has('allow')} THEN 'ALLOW' WHEN {has('block')} OR {has('remove')} THEN 'REDACT' WHEN {has('mask')} THEN 'MASK' ELSE {f}action END"


def _sanitize_cte(source: str, profile: str = "PUBLIC_RELEASE") -> str:
    fold = "list_reduce(list_concat([{'s': -1, 'e': -1, 'r': t.text}], coalesce(l, [])), lambda a, x: {'s': -1, 'e': -1, 'r': a.r[1:x.s] || x.r || a.r[x.e + 1:]}).r"
    return findings_cte(source=source) + f""", {_POLICIES},
acted AS (SELECT doc_id, s, e, category, masked, {_action('f.')} AS act FROM findings f, policies WHERE profile = '{profile}'),
listed AS (SELECT doc_id, list({{'s': s, 'e': e, 'r': CASE WHEN masked <> '' THEN masked ELSE '[' || CASE act WHEN 'REDACT' THEN 'REDACTED' WHEN 'REPLACE' THEN 'REPLACED' WHEN 'MASK' THEN 'MASKED' ELSE 'QUARANTINED' END || ']' END}} ORDER BY s DESC) FILTER (act <> 'ALLOW') AS l,
  count(*) AS n, bool_and(category = 'PROMPT_INJECTION') AS injected FROM acted GROUP BY doc_id),
masked_text AS (SELECT t.doc_id, t.text, coalesce(n, 0) AS n, coalesce(injected, true) AS injected, {fold} AS masked FROM t LEFT JOIN listed l ON t.doc_id = l.doc_id),
usable AS (SELECT *, length(trim(regexp_replace(regexp_replace(masked, '\\[([A-Z_ ]+)\\]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS usable_chars FROM masked_text),
done AS (SELECT *, n > 0 AND NOT injected AND usable_chars < 15 AS blocked FROM usable)"""


def _rescanned(profile: str) -> str:
    """..., risk AS: the risk of every document's sanitized text; a blocked document's text is the original."""
    return risk_cte(f"SELECT doc_id, CASE WHEN blocked THEN text ELSE masked END AS text, blocked FROM ({_sanitize_cte(_PLANTED, profile)} SELECT * FROM done)")


def _leaks_sql(source: str = _PLANTED) -> str:
    passes = passes_sql()
    merged = " UNION ALL ".join(f"SELECT doc_id, s, e, masked, type, category, {i} AS o FROM {n}" for i, n in enumerate(("pii", "secrets", "injections")))
    fold = "list_reduce(list_concat([{'s': -1, 'e': -1, 'r': t.text}], coalesce(l, [])), lambda a, x: {'s': -1, 'e': -1, 'r': a.r[1:x.s] || x.r || a.r[x.e + 1:]}).r"
    return f"""WITH t AS MATERIALIZED ({source}), {", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in passes.items())}, merged AS ({merged}),
g AS (SELECT doc_id, list({{'s': s, 'e': e, 'r': CASE WHEN masked <> '' THEN masked ELSE '[REDACTED]' END}} ORDER BY s DESC, o) AS l, count(*) AS n, bool_or(type = 'PASSWORD' OR category = 'PROMPT_INJECTION') AS refused FROM merged GROUP BY doc_id)
SELECT t.doc_id, n IS NULL AS passed, coalesce(n, 0) AS n_leaks, coalesce(refused, false) AS refused, sha256({fold}) AS repaired_sha256 FROM t LEFT JOIN g ON t.doc_id = g.doc_id"""


_TYPES = ", ".join(f"'{x}'" for x in [*policy.TYPES, *policy.CATEGORIES])
_KNOWN = ", ".join(f"'{x}'" for x in [*policy.TYPES, *policy.CATEGORIES, *policy.CONTENT])
_NEVER = ", ".join(f"'{x}'" for x in policy.NEVER_ALLOWED)


def _bucket_sql() -> str:
    parts = []
    for i, b in enumerate(policy.BUCKETS):
        twice = " ".join(f"""WHEN list_contains(list_transform({e}, lambda z: trim(z)), x) THEN '"' || x || '" appears in both {e} and {b}.'""" for e in policy.BUCKETS[:i])
        parts.append(f"SELECT doc_id, CASE WHEN x = '' THEN '{b}: empty entry.' WHEN x NOT IN ({_KNOWN}) THEN '{b}: unknown entry \"' || left(x, 60) || '\".' {twice} END AS error FROM (SELECT *, trim(unnest({b})) AS x FROM p)")
    parts.append(f"""SELECT doc_id, 'allow: "' || x || '" must never be allowed.' FROM (SELECT *, unnest(allow) AS x FROM p) WHERE x IN ({_NEVER})""")
    return f"""WITH k AS (SELECT [{_TYPES}] AS k), p AS (SELECT doc_id, [k[doc_id % 38 + 1], 'iocs'] AS allow, [k[doc_id * 3 % 38 + 1], ' '] AS mask, [k[doc_id * 5 % 38 + 1]] AS remove, [k[doc_id * 7 % 38 + 1], source] AS block FROM documents, k)
SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE error IS NOT NULL"""


def _filter_sql() -> str:
    x, counts = "x", []
    steps = [
        ("unsafe_html_tag", outputs.UNSAFE_TAG, r"&lt;\1&gt;"), ("javascript_url", outputs.SCRIPT_LINK, r"[\1](#blocked)"), ("event_handler_attr", outputs.EVENT, ""), ("dangerous_url_attr", outputs.DANGEROUS, ""),
        ("data_url", outputs.DATA_LINK, r"[\1](#blocked)"), (None, r"(?im)^\s*system\s*:", "System (as data):"), (None, r"(?im)^\s*assistant\s*:", "Assistant (as data):"), (None, r"(?im)^\s*user\s*:", "User (as data):"),
        ("html_comment", outputs.COMMENT, ""), ("control_chars", outputs.HIDDEN, ""),
    ]
    ctes, before = [f"c0 AS (SELECT doc_id, {OUTPUT} AS x FROM documents)"], "c0"
    for i, (name, pattern, by) in enumerate(steps, 1):
        p = sql_string(pattern) if name in ("html_comment", "control_chars") else re2_sql(pattern)
        put = f"regexp_replace(x, {p}, {sql_string(by)}, 'g')"
        if name == "unsafe_html_tag":
            put = f"CASE WHEN len(regexp_extract_all(x, {p})) > 0 THEN regexp_replace({put}, {re2_sql(outputs.UNSAFE_CLOSE)}, '&lt;/\\1&gt;', 'g') ELSE x END"
        n = f", len(regexp_extract_all(x, {p})) AS n_{name}" if name else ""
        ctes.append(f"c{i} AS (SELECT * EXCLUDE (x){n}, {put} AS x FROM {before})")
        before = f"c{i}"
        if name:
            counts.append(f"CASE WHEN n_{name} > 0 THEN '{name}:' || n_{name} END")
    return f"WITH {', '.join(ctes)} SELECT doc_id, x AS sanitized, array_to_string(list_filter([{', '.join(counts)}], lambda z: z IS NOT NULL), ',') AS removed FROM {before}"


def _extract_sql(rows: list[str], most: int, columns: str) -> str:
    """Of rows (doc_id, o, k, type, value, ...), the first of each type and value, then the first ``most`` of a document."""
    return f"""WITH t AS (SELECT doc_id, text FROM ({_PLANTED})), f AS ({' UNION ALL '.join(rows)}), u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, type, value ORDER BY o, k) = 1)
SELECT {columns} FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o, k) <= {most}"""


def _iocs_sql() -> str:
    rows = []
    for o, (type_, pattern, severity, _) in enumerate(intel.IOCS):
        gate = "WHERE NOT contains(substring(text, greatest(0, s - 30) + 1, s - greatest(0, s - 30)), '@')" if type_ == "DOMAIN" else ""
        context = "trim(regexp_replace(substring(text, greatest(0, s - 15) + 1, e + 15 - greatest(0, s - 15)), '[ \\t\\n\\r]+', ' ', 'g'))"
        rows.append(f"SELECT doc_id, {o} AS o, k, '{type_}' AS type, m AS value, s AS span_start, '{severity}' AS severity, {context} AS context FROM ({spans_sql((pattern,))}) {gate}")
    return _extract_sql(rows, 20, "doc_id, type, value, span_start::BIGINT AS span_start, severity, context")


def _entities_sql() -> str:
    rows = []
    for o, (type_, pattern, _) in enumerate(intel.ENTITIES):
        gate = ""
        if "(?!" in pattern:
            pattern, gate = r"\b\d{3}-\d{2}-\d{4}\b", "WHERE m[1:3] NOT IN ('000', '666') AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:11] <> '0000'"
        rows.append(f"SELECT doc_id, {o} AS o, k, '{type_}' AS type, trim(m) AS value, s FROM ({spans_sql((pattern,))}) {gate}")
    n = len(rows)
    rows.append(f"SELECT doc_id, {n} AS o, k, 'PERSON' AS type, regexp_extract(m, {re2_sql(intel.PERSON)}, 1) AS value, s FROM ({spans_sql((intel.PERSON,))})")
    rows += [f"SELECT doc_id, {n + i} AS o, k, '{t}' AS type, m AS value, s FROM ({spans_sql((p,))})" for i, (t, p) in enumerate((("ORG", intel.ORG), ("LOCATION", intel.LOCATION)), 1)]
    return _extract_sql(rows, 25, "doc_id, type, value, s::BIGINT AS span_start")


def _ttp_cte() -> str:
    values = ", ".join(f"({o}, '{m}', '{tactic}', '{sev}', {i}, '{w}')" for o, (m, _, tactic, sev, ws) in enumerate(intel.TTPS) for i, w in enumerate(ws))
    return f"""WITH d(o, mitre_id, tactic, severity, i, keyword) AS (VALUES {values}), t AS ({_PLANTED}),
h AS (SELECT doc_id, d.*, instr(lower(text), keyword) - 1 AS span_start FROM t, d WHERE contains(lower(text), keyword) QUALIFY row_number() OVER (PARTITION BY doc_id, mitre_id ORDER BY i) = 1),
ttps AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o) <= 12)"""


_SENTENCES = f"""WITH t AS ({_PLANTED}), s AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM t),
p AS (SELECT doc_id, text, list_filter(list_transform(l, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) > 20) AS l FROM s),
r AS (SELECT doc_id, text, i - 1 AS i, l[i] AS f FROM p, unnest(range(1, len(l) + 1)) AS r(i)),
c AS (SELECT *, CASE WHEN regexp_matches(lower(f), '{intel.FACTS}') THEN 3.0 ELSE 0 END + CASE WHEN regexp_matches(lower(f), '{intel.URGENT}') THEN 2.0 ELSE 0 END + CASE WHEN length(f) > 60 AND length(f) < 220 THEN 1.0 ELSE 0 END + CASE WHEN i = 0 THEN 0.5 ELSE 0 END AS score FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) - 1 AS k FROM c)
SELECT doc_id, k AS i, left(f, 240) AS finding, score::DOUBLE AS score, instr(text, f) - 1 AS span_start FROM o WHERE (score >= 2 AND k < 5) OR k = 0"""

def _reports_sql() -> str:
    """..., found AS: what was extracted of each document, r AS: its risks in order (o)."""
    of = lambda q, columns: f"(SELECT doc_id, {columns} FROM ({q}) GROUP BY doc_id)"
    in_category = ", ".join(f"count(*) FILTER (category = '{c}') AS {n}" for c, n in (("PII", "pii"), ("SECRET", "secrets"), ("PROMPT_INJECTION", "injections")))
    names = "string_agg(mitre_id || ' (' || technique || ')', ', ' ORDER BY o) AS techniques"
    techniques = ", ".join(f"('{m}', '{t}')" for m, t, *_ in intel.TTPS)
    ttps = f"{_ttp_cte()} SELECT doc_id, o, mitre_id, severity, technique FROM ttps JOIN (VALUES {techniques}) AS v(mitre_id, technique) USING (mitre_id)"
    rules = [
        ("pii > 0", "CASE WHEN pii > 5 THEN 'Data Exposure' ELSE 'PII Handling' END", "CASE WHEN pii > 5 THEN 'HIGH' ELSE 'MEDIUM' END", "CASE WHEN pii > 5 THEN 35 ELSE 15 END", "pii"),
        ("secrets > 0", "'Credential Exposure'", "'CRITICAL'", "45", "secrets"),
        ("injections > 0", "'Prompt Injection'", "'CRITICAL'", "40", "injections"),
        ("n_iocs > 0", "'Infrastructure Exposure'", "CASE WHEN high > 0 THEN 'HIGH' ELSE 'MEDIUM' END", "20 + high * 5", "n_iocs"),
        ("n_ttps > 0", "'Adversarial Behavior'", "CASE WHEN critical > 0 THEN 'CRITICAL' ELSE 'HIGH' END", "25 + n_ttps * 3", "n_ttps"),
        ("contains(lower(text), 'root cause') OR contains(lower(text), 'postmortem')", "'Operational Learning'", "'LOW'", "5", "1"),
    ]
    risks = " UNION ALL ".join(f"SELECT doc_id, {o} AS o, {c} AS category, {s} AS severity, ({p})::BIGINT AS score, ({n})::BIGINT AS n FROM found WHERE {when}" for o, (when, c, s, p, n) in enumerate(rules))
    counts = ["pii", "secrets", "injections", "n_iocs", "high", "n_ttps", "critical", "n_entities", "n_key_findings"]
    return f"""{findings_cte()}, found AS (SELECT t.doc_id, text, techniques, {", ".join(f"coalesce({c}, 0) AS {c}" for c in counts)} FROM t
  LEFT JOIN {of("SELECT * FROM findings", in_category)} USING (doc_id) LEFT JOIN {of(_iocs_sql(), "count(*) AS n_iocs, count(*) FILTER (severity = 'HIGH') AS high")} USING (doc_id)
  LEFT JOIN {of(ttps, f"count(*) AS n_ttps, count(*) FILTER (severity = 'CRITICAL') AS critical, {names}")} USING (doc_id)
  LEFT JOIN {of(_entities_sql(), "count(*) AS n_entities")} USING (doc_id) LEFT JOIN {of(_SENTENCES, "count(*) AS n_key_findings")} USING (doc_id)),
r AS ({risks})"""


def _benchmark_sql() -> str:
    """Each category's documents under its policy, then the results scanned again."""
    categories = [(0, "INJECTION", "SECURITY_INCIDENT"), (1, "PII_HEAVY", "PUBLIC_RELEASE"), (2, "SECRET_HEAVY", "SECURITY_INCIDENT"), (3, "SAFE", "INTERNAL_SUMMARY")]
    done = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, '{p}' AS profile, blocked, CASE WHEN blocked THEN text ELSE masked END AS text FROM ({_sanitize_cte(f'{_PLANTED} WHERE doc_id % 4 = {k}', p)} SELECT * FROM done)" for k, c, p in categories)
    text = "SELECT doc_id, text FROM sanitized"
    return f"""WITH sanitized AS MATERIALIZED ({done}), b AS ({risk_cte(_PLANTED)} SELECT doc_id, n, total FROM risk), a AS ({risk_cte(text)} SELECT doc_id, total FROM risk), k AS (SELECT doc_id, n_leaks FROM ({_leaks_sql(text)}))
SELECT doc_id AS document_id, category, profile, b.n AS n_findings, b.total AS risk_before, x.after AS risk_after, b.total - x.after AS delta, n_leaks AS leakage, blocked
FROM sanitized JOIN b USING (doc_id) JOIN (SELECT doc_id, CASE WHEN blocked THEN b.total ELSE a.total END AS after FROM sanitized JOIN a USING (doc_id) JOIN b USING (doc_id)) x USING (doc_id) JOIN k USING (doc_id)"""


_CLAIMS = f"""l AS (SELECT doc_id, text, lang, i, trim(regexp_replace(x[i], '^[-*•0-9.) \\t]+', '')) AS line FROM (SELECT doc_id, text, lang, string_split_regex({CLAIMS}, '\\n+') AS x FROM documents), unnest(range(1, len(x) + 1)) AS r(i)),
s AS (SELECT *, CASE WHEN line = '' THEN [] WHEN len(regexp_extract_all(line, '[^.!?]{{10,}}[.!?]|[^.!?]{{10,}}$')) > 0 THEN regexp_extract_all(line, '[^.!?]{{10,}}[.!?]|[^.!?]{{10,}}$') ELSE [line] END AS u FROM l),
c AS (SELECT doc_id, text, lang, trim(u[j], ' ' || chr(9)) AS claim, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS i FROM s, unnest(range(1, len(u) + 1)) AS r(j) WHERE length(trim(u[j], ' ' || chr(9))) >= 10)"""

QUERIES = {
    "actions_by_policy": actions_by_policy, "decide_action": overridden_actions, "sanitize": sanitized, "usable_prose_block": only_findings, "residual_risk": residual, "policy_compare": compared, "validate_policies": bucket_errors, "recommend_profile": profiles,
    "token_diff": diffs, "sanitize_output_html": filtered, "internal_links": links, "is_internal_host": hosts, "output_dlp": leaks, "split_claims": claims, "ground_claims": grounded, "truncate_for_context": context, "offline_artefacts": artefacts,
    "validate_outputs": validated, "benchmark_report": measured, "extract_iocs": iocs, "extract_entities": entities, "map_ttps": ttps, "tactic_counts": tactics, "key_findings": sentences, "synthesize_risks": risks, "intelligence_report": report, "ingest": ingested, "run_pipeline": pipelined,
}
_NORMAL = f"SELECT doc_id, {_normal(PLANTED)} AS text FROM documents"
_INTERNAL = sql_string(outputs.INTERNAL)
_INSIDE = f"(regexp_matches(h, {_INTERNAL}) OR regexp_matches(h, '(?i)^0x[0-9a-f]+$') OR (regexp_matches(replace(h, '.', ''), '^[0-9]+$') AND contains(h, '.')) OR starts_with(h, '::ffff:'))"
SQL = {
    "actions_by_policy": f"{findings_cte()}, {_POLICIES} SELECT profile, type, {_action('f.')} AS action, count(*) AS n FROM findings f, policies GROUP BY ALL",
    "decide_action": f"""{findings_cte()}, {_POLICIES}, o AS (SELECT doc_id, s, category, type, {_action('f.')} AS plain, CASE doc_id % 4 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'MASK' WHEN 2 THEN 'REPLACE' END AS override FROM findings f, policies WHERE profile = 'HR_SAFE')
SELECT doc_id, s::BIGINT AS span_start, type, CASE WHEN override IS NULL THEN plain WHEN category = 'PROMPT_INJECTION' THEN 'QUARANTINE' WHEN override = 'ALLOW' AND category = 'SECRET' THEN 'REDACT' ELSE override END AS action FROM o""",
    "sanitize": f"{_sanitize_cte(_PLANTED)} SELECT doc_id, sha256(CASE WHEN blocked THEN text ELSE masked END) AS content_sha256, blocked, usable_chars, n AS n_actions FROM done",
    "usable_prose_block": f"{_sanitize_cte(f'SELECT doc_id, {PLANTED} AS text FROM documents UNION ALL SELECT -1 - doc_id, {BARE} FROM documents')} SELECT doc_id, blocked, usable_chars FROM done",
    "ingest": f"""{risk_cte(_NORMAL)} SELECT doc_id, source AS title, 'SCANNED' AS status, sha256(t.text) AS sha256, strlen(t.text) AS size_bytes, total AS risk_score, classification, n AS n_findings, 2 AS n_audit
FROM risk JOIN t USING (doc_id) JOIN (SELECT doc_id, source FROM documents) d USING (doc_id)""",
    "run_pipeline": f"""{_sanitize_cte(_NORMAL)} SELECT doc_id, CASE WHEN blocked THEN 'BLOCKED' ELSE 'TRANSFORMED' END AS status, sha256(CASE WHEN blocked THEN text ELSE masked END) AS content_sha256,
  CASE WHEN blocked THEN 0 ELSE 1 END AS n_outputs, CASE WHEN blocked THEN 0 ELSE 2 END AS n_transform, 1 AS n_policy FROM done""",
    "residual_risk": f"{_rescanned('PUBLIC_RELEASE')} SELECT blocked, count(*) AS n, sum(CASE WHEN blocked THEN 100 ELSE total END)::BIGINT AS risk_after FROM risk JOIN t USING (doc_id) GROUP BY blocked",
    "policy_compare": " UNION ALL ".join(f"SELECT '{p}' AS profile, * FROM ({_rescanned(p)} SELECT blocked, count(*) AS n, sum(total)::BIGINT AS risk_after FROM risk JOIN t USING (doc_id) GROUP BY blocked)" for p in ("PUBLIC_RELEASE", "HR_SAFE", "SECURITY_INCIDENT")),
    "output_dlp": _leaks_sql(),
    "validate_policies": _bucket_sql(),
    "recommend_profile": f"""{risk_cte(_PLANTED)}, p AS (SELECT doc_id, CASE classification WHEN 'INTERNAL' THEN 'INTERNAL_SUMMARY' WHEN 'CONFIDENTIAL' THEN 'EXECUTIVE_BRIEF' WHEN 'RESTRICTED' THEN 'SECURITY_INCIDENT' ELSE 'PUBLIC_RELEASE' END AS profile FROM risk)
SELECT doc_id, profile, doc_id % 7 = 0 OR (CASE WHEN doc_id % 3 > 0 THEN 'SECURITY_INCIDENT' END) IS DISTINCT FROM profile AS again FROM p""",
    "token_diff": """WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS a, list_filter(string_split_regex(regexp_replace(text, '[Tt]he', 'this', 'g'), '[ \\t\\n\\r]+'), lambda x: x <> '') AS b FROM documents)
SELECT doc_id, len(a) AS n_before, len(b) AS n_after, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS n_removed, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS n_added FROM d""",
    "sanitize_output_html": _filter_sql(),
    "internal_links": f"""WITH l AS (SELECT page_id, url, {URLS} AS link FROM pages), v AS (SELECT *, url_decode(regexp_extract(link, '[?&](?:next)=([^&#]*)', 1)) AS inner_link FROM l),
g AS (SELECT *, CASE WHEN regexp_matches(inner_link, '(?i)^https?://') THEN inner_link ELSE url_decode(link) END AS target FROM v), h AS (SELECT *, regexp_extract(target, '(?i)^(?:https?://)?([^/:?\\s#]+)', 1) AS h FROM g)
SELECT page_id, url || ' [a](' || CASE WHEN {_INSIDE} THEN '#internal-url-redacted' ELSE link END || ') end ' || url AS sanitized FROM h""",
    "is_internal_host": f"SELECT page_id, {_INSIDE} AS internal FROM (SELECT page_id, {HOSTS} AS h FROM pages)",
    "split_claims": f"WITH {_CLAIMS} SELECT doc_id, i, claim FROM c WHERE i < 40",
    "ground_claims": f"""WITH {_CLAIMS}, w AS (SELECT doc_id, lower(text || ' ' || lang) AS src, claim, list_filter(string_split_regex(claim, '[ \\t\\n\\r]+'), lambda x: length(x) > 3) AS ws FROM c WHERE i < 40),
x AS (SELECT *, list_transform(range(1, len(ws) - 3), lambda j: lower(array_to_string(ws[j:j + 4], ' '))) AS five, list_transform(range(1, len(ws) - 1), lambda j: lower(array_to_string(ws[j:j + 2], ' '))) AS three,
  list_filter(list_transform(ws, lambda z: regexp_replace(lower(z), '[^a-z0-9]', '', 'g')), lambda z: length(z) > 4) AS sig FROM w),
g AS (SELECT doc_id, NOT contains(lower(claim), '[unsupported]') AND (len(list_filter(five, lambda r: contains(src, r))) > 0 OR len(list_filter(three, lambda r: length(r) >= 12 AND contains(src, r))) > 0
  OR (len(sig) >= 3 AND len(list_filter(sig, lambda z: contains(src, z))) >= greatest(3, ceil(len(sig) * 0.5)))) AS ok FROM x)
SELECT doc_id, count(*) AS n_claims, count(*) FILTER (ok) AS n_grounded, CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'FAIL' END AS grounding FROM g GROUP BY doc_id""",
    "truncate_for_context": f"SELECT doc_id, sha256(CASE WHEN length(text) <= 120000 THEN text ELSE left(text, 120000) || chr(10) || chr(10) || '[NOTICE: the content has ' || length(text) || ' characters; the first 120000 follow the context limit.]' END) AS content_sha256 FROM (SELECT doc_id, {LONG} AS text FROM documents)",
    "extract_iocs": _iocs_sql(), "extract_entities": _entities_sql(),
    "map_ttps": f"{_ttp_cte()} SELECT doc_id, mitre_id, tactic, keyword, span_start, CASE WHEN length(keyword) > 10 THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM ttps",
    "tactic_counts": f"{_ttp_cte()} SELECT tactic, count(*) AS n FROM ttps GROUP BY tactic",
    "key_findings": _SENTENCES,
    "benchmark_report": _benchmark_sql(),
    "synthesize_risks": f"{_reports_sql()} SELECT doc_id, category, severity, score, n FROM r",
    "intelligence_report": f"""{_reports_sql()}, top AS (SELECT doc_id, count(*) AS n_risks, arg_min(category, o) AS category, arg_min(severity, o) AS severity FROM r GROUP BY doc_id)
SELECT doc_id, n_entities, n_iocs, n_ttps, coalesce(n_risks, 0) AS n_risks, n_key_findings, 'Analyzed ' || len(string_split_regex(text, '[ \\t\\n\\r]+')) || ' words across ' || greatest(1, ceil(len(string_split(text, chr(10))) / 40.0))::BIGINT || ' pages. Detected '
  || n_entities || ' entities, ' || n_iocs || ' IOCs, ' || n_ttps || ' TTP(s). ' || CASE WHEN n_ttps > 0 THEN 'ATT&CK: ' || techniques || '. ' ELSE '' END
  || CASE WHEN category IS NULL THEN 'No risk stands out.' ELSE 'Top risk: ' || category || ' (' || severity || ').' END AS summary FROM found LEFT JOIN top USING (doc_id)""",
}
