"""Sanitizing documents under a policy: narrow expressions over the document's own findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.regex import java
from palisade.functions.spans import each, let, replace_spans
from palisade.functions.text import strip
from palisade.operators import policy, risk, scan

#: What replaces a span whose finding has no mask.
FALLBACK = {"REDACT": "[REDACTED]", "REPLACE": "[REPLACED]", "MASK": "[MASKED]", "QUARANTINE": "[QUARANTINED]"}
LEAST_PROSE = 15


def with_actions(findings: Column, buckets: Column, overrides: Column | None = None) -> Column:
    """The findings with ``action`` and ``overridden``. overrides: map<location, action>, location as start-end."""
    def one(f: Column) -> Column:
        chosen = F.element_at(overrides, F.concat_ws("-", f["start"].cast("string"), f["end"].cast("string"))) if overrides is not None else None
        plain = policy.decide_action(f["category"], f["type"], f["default_action"], buckets)
        action = policy.decide_action(f["category"], f["type"], f["default_action"], buckets, chosen) if chosen is not None else plain
        changed = chosen.isNotNull() & (action != plain) if chosen is not None else F.lit(False)
        return f.withField("action", action).withField("overridden", changed)

    return F.transform(findings, one)


def replacement(f: Column) -> Column:
    fallback = F.lit("[REDACTED]")
    for action, by in FALLBACK.items():
        fallback = F.when(f["action"] == action, by).otherwise(fallback)
    return F.when(f["masked_text"] != "", f["masked_text"]).otherwise(fallback)


def sanitized_text(text: Column, findings: Column) -> Column:
    """``text`` with every finding that is not allowed replaced, from the last to the first; spans beyond the text are left out."""
    def pieces(n: Column) -> Column:
        live = F.filter(findings, lambda f: (f["action"] != "ALLOW") & (f["start"] >= 0) & (f["end"] > f["start"]) & (f["start"] < n) & (f["end"] <= n + 4096))
        back = F.array_sort(live, lambda a, b: b["start"] - a["start"])
        return F.transform(back, lambda f: F.struct(f["start"].alias("start"), F.least(f["end"], n).alias("end"), replacement(f).alias("by")))

    return replace_spans(text, let(F.length(text), pieces))


def usable_prose(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"\[([A-Z_ ]+)\]", ""), java(r"\s+"), " "))


def sanitize(df: DataFrame, text_col: str = "text", findings_col: str = "findings", buckets_col: str = "policy", overrides: Column | None = None) -> DataFrame:
    """``df`` with actions (array), sanitized_content, blocked and usable_chars.

    A document of which hardly any prose is left is blocked and keeps its content, unless all its
    findings are injections.
    """
    out = df.withColumn("actions", with_actions(F.col(findings_col), F.col(buckets_col), overrides))
    out = out.withColumn("_masked", sanitized_text(F.col(text_col), F.col("actions")))
    out = out.withColumn("usable_chars", F.length(usable_prose(F.col("_masked"))))
    injected = F.forall(findings_col, lambda f: f["category"] == "PROMPT_INJECTION")
    blocked = (F.size(findings_col) > 0) & ~injected & (F.col("usable_chars") < LEAST_PROSE)
    out = out.withColumn("blocked", blocked)
    return out.withColumn("sanitized_content", F.when(F.col("blocked"), F.col(text_col)).otherwise(F.col("_masked"))).drop("_masked")


def with_policy(df: DataFrame, name: Column | str = policy.DEFAULT, policies: DataFrame | None = None) -> DataFrame:
    """``df`` with the named policy as struct ``policy``; null where no active policy has the name. The policies are configuration, a few rows."""
    policies = policies if policies is not None else policy.policies(df.sparkSession)
    small = policies.filter("active").select(F.col("name").alias("_policy"), F.struct("name", *policy.BUCKETS).alias("policy"))
    named = df.withColumn("_policy", F.lit(name) if isinstance(name, str) else name)
    return named.join(F.broadcast(small), "_policy", "left").drop("_policy")


def residual_risk(df: DataFrame, text_col: str = "sanitized_content", before_col: str = "risk_before") -> DataFrame:
    """``df`` with risk_after: of the sanitized text scanned again; of a blocked document what it was."""
    again = scan.scan_array(df.withColumn("_open", F.when(F.col("blocked"), None).otherwise(F.col(text_col))), text_col="_open", out="_again")
    return again.withColumn("risk_after", F.when(F.col("blocked"), F.col(before_col)).otherwise(risk.risk(F.col("_again"))["total"])).drop("_again", "_open")


def policy_compare(df: DataFrame, names: list[str], policies: DataFrame | None = None) -> DataFrame:
    """Every document under each of up to ten policies: id, profile, preview, n_actions, risk_before, risk_after, blocked.

    ``df``: document_id, text, findings. Names without an active policy are left out.
    """
    if not 1 <= len(names) <= 10:
        raise ValueError("one to ten policies")
    rows, said = df.select("document_id", "text", "findings").withColumn("risk_before", risk.risk(F.col("findings"))["total"]), []
    for i, name in enumerate(dict.fromkeys(names)):
        one = sanitize(with_policy(rows, name, policies))
        under = F.struct(F.lit(name).alias("profile"), F.size("actions").alias("n_actions"), "sanitized_content", "blocked")
        rows = one.withColumn(f"_under_{i}", F.when(F.col("policy").isNotNull(), under)).drop("policy", "actions", "usable_chars", "blocked", "sanitized_content")
        said.append(F.col(f"_under_{i}"))
    rows = rows.select("document_id", "risk_before", F.filter(F.array(*said), lambda u: u.isNotNull()).alias("_under"))
    # policies mostly leave the same text, which is scanned once; a blocked document's is not scanned
    scanned = lambda u: F.when(u["blocked"] | u["sanitized_content"].isNull(), "").otherwise(u["sanitized_content"])
    rows = each(rows, F.array_distinct(F.transform("_under", scanned)), "_text", "document_id", "risk_before", "_under")
    rows = scan.scan_array(rows, text_col="_text", out="_again").withColumn("_after", risk.risk(F.col("_again"))["total"])
    rows = each(rows, F.filter("_under", lambda u: scanned(u) == F.col("_text")), "u", "document_id", "risk_before", "_after")
    preview = F.when(F.col("u.blocked"), "— BLOCKED —").otherwise(F.left("u.sanitized_content", F.lit(400)))
    after = F.when(F.col("u.blocked"), F.col("risk_before")).otherwise(F.col("_after"))
    return rows.select("document_id", "u.profile", preview.alias("preview"), "u.n_actions", "risk_before", after.alias("risk_after"), "u.blocked")


def token_diff(df: DataFrame, before_col: str, after_col: str) -> DataFrame:
    """``df`` with n_before, n_after, removed, added: tokens of one text that the other lacks altogether, with repeats.

    The distinct tokens that differ come from hash sets; only they are looked up token by token.
    """
    words = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), java(r"\s+")), lambda w: w != "")
    df = df.withColumns({"_a": words(before_col), "_b": words(after_col)})
    only = lambda x, y: let(F.array_except(x, y), lambda few: F.filter(x, lambda w: F.array_contains(few, w)))
    return df.withColumns({"n_before": F.size("_a"), "n_after": F.size("_b"), "removed": only(F.col("_a"), F.col("_b")), "added": only(F.col("_b"), F.col("_a"))}).drop("_a", "_b")


def needs_resanitize(content: Column, made_under: Column, policy_name: Column) -> Column:
    return content.isNull() | ~made_under.eqNullSafe(policy_name)


#: The policy that a benchmark's category of documents is held to.
BENCHMARK_PROFILES = {"INJECTION": "SECURITY_INCIDENT", "MIXED": "SECURITY_INCIDENT", "SECRET_HEAVY": "SECURITY_INCIDENT", "PII_HEAVY": "PUBLIC_RELEASE"}


def benchmark(df: DataFrame, profile_of: dict[str, str] = BENCHMARK_PROFILES, other: str = "INTERNAL_SUMMARY") -> DataFrame:
    """What sanitizing does to each document (id, category, text): document_id, category, profile, n_findings, risk_before, risk_after, delta, leakage, blocked."""
    profile = F.lit(other)
    for category, name in profile_of.items():
        profile = F.when(F.col("category") == category, name).otherwise(profile)
    rows = with_policy(scan.scan_array(df), profile)
    rows = residual_risk(sanitize(rows.withColumn("risk_before", risk.risk(F.col("findings"))["total"])))
    rows = scan.leaks_array(rows, "sanitized_content", "leaks")
    return rows.select(
        "document_id", "category", F.col("policy.name").alias("profile"), F.size("findings").alias("n_findings"), "risk_before", "risk_after", (F.col("risk_before") - F.col("risk_after")).alias("delta"), F.size("leaks").alias("leakage"), "blocked"
    )


def benchmark_summary(rows: DataFrame) -> DataFrame:
    """One row over all documents of ``benchmark``: totals, averages, and leaks in percent of the findings."""
    average = lambda c: F.round(F.avg(c), 1)
    return rows.agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_findings").alias("n_findings"), average("risk_before").alias("risk_before"), average("risk_after").alias("risk_after"), average("delta").alias("delta"), F.sum("leakage").alias("leakage"),
        F.round(F.sum("leakage") / F.greatest(F.lit(1), F.sum("n_findings")) * 100, 2).alias("leakage_rate"), F.count_if("blocked").alias("blocked"),
    )
