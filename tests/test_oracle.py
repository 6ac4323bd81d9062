"""A choice of registered queries held against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from palisade.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOICE = ["detect_email", "detect_phone", "detect_assigned_credential", "scan", "risk_scores", "normalize_text", "text_quality", "sanitize", "sanitize_output_html", "extract_iocs", "key_findings", "resolve_overrides", "top_findings", "bulk_outcomes", "policy_ledger_ops", "custom_policies", "policy_audit", "list_policies", "validate_policies", "audit_events", "other_audit_events", "allowed_override_actions", "audit_counts", "synthesize_risks", "intelligence_report", "benchmark_report"]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


@pytest.mark.parametrize("name", CHOICE)
def test_same_rows(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    rel = con.sql(registry.oracle_sql()[name])
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=key)


def test_every_query_with_sql_is_registered():
    assert set(registry.oracle_sql()) <= set(registry.queries())
