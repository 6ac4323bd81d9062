"""Risk scores and classification, as folds over a document's findings in order of start.

Sums are folded one finding after another, in double precision and in that order, as rounding at the
end can depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of severities, categories and actions, and the classes' types.
SEVERITY = {"LOW": 4, "MEDIUM": 10, "HIGH": 20, "CRITICAL": 35}
CATEGORY = {"PII": 1.0, "SECRET": 1.4, "PROMPT_INJECTION": 1.6, "INTERNAL_ASSET": 0.85, "UNSAFE_URL": 0.9}
SHARE = {"PII": 1.0, "SECRET": 1.0, "PROMPT_INJECTION": 1.0, "INTERNAL_ASSET": 0.75, "UNSAFE_URL": 0.75}
CREDIT = {"REDACT": 0.6, "QUARANTINE": 0.8, "BLOCK": 0.9, "REPLACE": 0.4, "MASK": 0.3}
CONFIDENTIAL = ["AADHAAR", "PAN", "CREDIT_CARD", "SSN", "PASSPORT", "DRIVERS_LICENSE", "BANK_ACCOUNT", "IBAN"]
NAMES = {"PII": "pii", "SECRET": "secrets", "PROMPT_INJECTION": "prompt_injection", "INTERNAL_ASSET": "internal_assets", "UNSAFE_URL": "unsafe_urls"}


def pick(c: Column, table: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, v in table.items():
        out = F.when(c == k, float(v)).otherwise(out)
    return out


def half_up(c: Column) -> Column:
    """To the nearest integer, halves upwards."""
    return F.floor(c + 0.5).cast("int")


def _sum(findings: Column, value) -> Column:
    return F.aggregate(findings, F.lit(0.0), lambda a, f: a + value(f))


def risk(findings: Column, action: str = "default_action") -> Column:
    """struct<pii, secrets, prompt_injection, internal_assets, unsafe_urls, total, residual double, classification>.

    ``findings`` are structs in order of start; ``action`` names the field with the action taken.
    """
    weighted = lambda f: pick(f["severity"], SEVERITY) * f["confidence"] * pick(f["category"], CATEGORY)
    of = lambda c: F.filter(findings, lambda f: f["category"] == c)
    parts = {c: _sum(of(c), weighted) for c in CATEGORY}
    raw = parts["PII"] * 1.0 + parts["SECRET"] * 1.0 + parts["PROMPT_INJECTION"] * 1.0 + parts["INTERNAL_ASSET"] * 0.75 + parts["UNSAFE_URL"] * 0.75
    credit = _sum(findings, lambda f: pick(f["severity"], SEVERITY) * pick(f[action], CREDIT))
    residual = F.greatest(F.lit(0.0), raw - credit * 0.4)
    return F.struct(
        *(half_up(parts[c]).alias(n) for c, n in NAMES.items()), F.least(F.lit(100), half_up(residual)).alias("total"),
        residual.alias("residual"), classify(findings, residual).alias("classification"),
    )


def classify(findings: Column, residual: Column) -> Column:
    injected = F.exists(findings, lambda f: f["category"] == "PROMPT_INJECTION")
    critical = F.exists(findings, lambda f: (f["category"] == "SECRET") & (f["severity"] == "CRITICAL"))
    regulated = F.exists(findings, lambda f: f["type"].isin(CONFIDENTIAL))
    return (
        F.when(injected & (critical | (residual > 60)), "RESTRICTED").when(critical | regulated | (residual >= 55), "CONFIDENTIAL")
        .when(residual > 0, "INTERNAL").otherwise("PUBLIC")
    )


def risk_of_table(findings: DataFrame, id_col: str = "document_id", action: str = "default_action") -> DataFrame:
    """(id, risk) for a table of findings. The array is sorted first, so the sums do not depend on partitions."""
    fields = ["start", "confidence", "category", "type", "severity", action]
    return findings.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_f")).select(id_col, risk(F.col("_f"), action).alias("risk"))
