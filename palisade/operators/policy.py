"""Release policies: built-in ones and templates, validation, changes, and the action they choose for a finding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import spans

# Groups of finding types, which bucket each policy puts them in, and what buckets may hold.
IDS = ["AADHAAR", "PAN", "SSN", "PASSPORT", "DRIVERS_LICENSE"]
BANKING = ["BANK_ACCOUNT", "IBAN", "IFSC", "UPI"]
CREDENTIALS = ["API_KEY", "JWT", "PRIVATE_KEY", "DB_CONN_STRING", "CLOUD_CRED", "AUTH_TOKEN", "PASSWORD"]
INJECTED = ["INJECTION_PHRASE", "ROLE_MANIPULATION", "HIDDEN_INSTRUCTION", "TOOL_INVOCATION"]
URLS = ["INTERNAL_URL", "UNSAFE_URL"]
NAMED = ["PERSON_NAME", "ORG_ID", "IP_ADDRESS", "IPV6_ADDRESS"]
CONTACT = ["EMAIL", "PHONE"]
BUCKETS = ["allow", "mask", "remove", "block"]
#: name: classification, audience, allow, mask, remove, block.
BUILTIN = {
    "PUBLIC_RELEASE": ("PUBLIC", "PUBLIC", ["high_level_facts", "aggregate_statistics", "public_contact_information"], [*NAMED, *CONTACT, "DATE_OF_BIRTH", "POSTAL_CODE"], [*IDS, "ADDRESS", "CREDIT_CARD", *BANKING, *URLS, "INTERNAL_PROJECT"], [*CREDENTIALS, *INJECTED]),
    "INTERNAL_SUMMARY": ("INTERNAL", "INTERNAL", ["high_level_facts", "aggregate_statistics", "internal_project_names"], [*NAMED, *CONTACT, "DATE_OF_BIRTH", "POSTAL_CODE"], [*IDS, "ADDRESS", "CREDIT_CARD", *BANKING, *URLS], [*CREDENTIALS, *INJECTED, "INTERNAL_PROJECT"]),
    "EXECUTIVE_BRIEF": ("CONFIDENTIAL", "EXECUTIVE", ["high_level_facts", "aggregate_statistics", "strategic_context"], [*NAMED, *CONTACT, "POSTAL_CODE"], [*IDS, "ADDRESS", "CREDIT_CARD", *BANKING, *CREDENTIALS, *URLS], [*INJECTED, "INTERNAL_PROJECT"]),
    "HR_SAFE": ("CONFIDENTIAL", "HR", ["aggregate_statistics", "role_descriptions"], [*NAMED, *CONTACT], [*IDS, "ADDRESS", "CREDIT_CARD", *BANKING, "DATE_OF_BIRTH", "POSTAL_CODE", *URLS, *CREDENTIALS], [*INJECTED, "INTERNAL_PROJECT"]),
    "SECURITY_INCIDENT": ("RESTRICTED", "SECURITY", ["timeline_facts", "root_cause_summary", "follow_up_actions", "iocs", "ttps", "evidence"], [*NAMED, *CONTACT, "POSTAL_CODE"], [*CREDENTIALS, *URLS, "INTERNAL_PROJECT", "ADDRESS", *BANKING], [*INJECTED, *IDS, "CREDIT_CARD"]),
}
TEMPLATES = {
    "OWASP_GENAI_STRICT": ("RESTRICTED", "SECURITY", ["high_level_facts", "aggregate_statistics"], [*NAMED, *CONTACT, "POSTAL_CODE"], [*IDS, "ADDRESS", "CREDIT_CARD", *BANKING, "DATE_OF_BIRTH", *URLS, "INTERNAL_PROJECT"], [*CREDENTIALS, *INJECTED]),
    "GDPR_MINIMIZED": ("CONFIDENTIAL", "CUSTOM", ["aggregate_statistics", "role_descriptions"], [*NAMED, *CONTACT, "POSTAL_CODE"], [*IDS, "ADDRESS", "CREDIT_CARD", *BANKING, "DATE_OF_BIRTH", *URLS], [*CREDENTIALS, *INJECTED, "INTERNAL_PROJECT"]),
    "HIPAA_SAFE_HARBOR": ("RESTRICTED", "CUSTOM", ["aggregate_statistics"], [*NAMED], [*CONTACT, "ADDRESS", "POSTAL_CODE", "DATE_OF_BIRTH", *IDS, "CREDIT_CARD", *BANKING, *URLS, "INTERNAL_PROJECT"], [*CREDENTIALS, *INJECTED]),
    "PCI_DSS_SAFE": ("CONFIDENTIAL", "CUSTOM", ["high_level_facts", "aggregate_statistics"], [*NAMED, *CONTACT, "POSTAL_CODE", "DATE_OF_BIRTH"], [*IDS, "ADDRESS", *URLS, "INTERNAL_PROJECT"], ["CREDIT_CARD", *BANKING, *CREDENTIALS, *INJECTED]),
}
TYPES = [*CONTACT, *IDS, "CREDIT_CARD", "POSTAL_CODE", *BANKING, *NAMED, "DATE_OF_BIRTH", "ADDRESS", *CREDENTIALS, *INJECTED, *URLS, "INTERNAL_PROJECT"]
CATEGORIES = ["PII", "SECRET", "PROMPT_INJECTION", "INTERNAL_ASSET", "UNSAFE_URL"]
CONTENT = ["high_level_facts", "aggregate_statistics", "public_contact_information", "internal_project_names", "strategic_context", "role_descriptions", "timeline_facts", "root_cause_summary", "follow_up_actions", "iocs", "ttps", "evidence"]
NEVER_ALLOWED = ["SECRET", *CREDENTIALS, "PROMPT_INJECTION", *INJECTED]
DEFAULT = "PUBLIC_RELEASE"
PROFILE_OF = {"PUBLIC": "PUBLIC_RELEASE", "INTERNAL": "INTERNAL_SUMMARY", "CONFIDENTIAL": "EXECUTIVE_BRIEF", "RESTRICTED": "SECURITY_INCIDENT"}
CHOICES = {"SECRET": ["REDACT", "REPLACE", "MASK"], "PROMPT_INJECTION": ["QUARANTINE", "REDACT"], "PII": ["ALLOW", "MASK", "REDACT", "REPLACE"], "INTERNAL_ASSET": ["ALLOW", "MASK", "REDACT", "REPLACE"], "UNSAFE_URL": ["ALLOW", "MASK", "REDACT", "REPLACE"]}
SCHEMA = "name string, classification string, audience string, allow array<string>, mask array<string>, remove array<string>, block array<string>, builtin boolean, active boolean"


def policies(spark: SparkSession, templates: bool = False) -> DataFrame:
    """The built-in policies, with the templates on request: configuration of a few rows, fit to broadcast."""
    rows = [(n, *p, True, True) for n, p in BUILTIN.items()] + [(n, *p, False, True) for n, p in TEMPLATES.items() if templates]
    return spark.createDataFrame(rows, SCHEMA)


def bucket_errors(of: Callable[[str], Column] = F.col) -> Column:
    """array<string>: what is wrong with a policy's buckets, in order of bucket and entry. of: the column of a bucket."""
    trimmed = lambda b: F.transform(F.coalesce(of(b), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    known = [*TYPES, *CATEGORIES, *CONTENT]
    errors = []
    for i, bucket in enumerate(BUCKETS):
        entries = trimmed(bucket)
        errors.append(F.when(F.size(entries) > 100, F.array(F.lit(f"{bucket}: too many entries (max 100).")) ).otherwise(F.array().cast("array<string>")))

        def judge(x: Column) -> Column:  # noqa: B023
            out = F.when(x == "", F.lit(f"{bucket}: empty entry.")).when(~x.isin(known), F.concat(F.lit(f'{bucket}: unknown entry "'), F.left(x, F.lit(60)), F.lit('".')))
            for earlier in BUCKETS[:i]:
                out = out.when(F.array_contains(trimmed(earlier), x), F.concat(F.lit('"'), x, F.lit(f'" appears in both {earlier} and {bucket}.')))
            return out

        errors.append(F.filter(F.transform(entries, judge), lambda e: e.isNotNull()))
    forbidden = F.filter(F.coalesce(of("allow"), F.array().cast("array<string>")), lambda x: x.isin(NEVER_ALLOWED))
    errors.append(F.transform(forbidden, lambda x: F.concat(F.lit('allow: "'), x, F.lit('" must never be allowed.'))))
    return F.concat(*errors)


def validate_policies(df: DataFrame) -> DataFrame:
    return df.withColumn("errors", bucket_errors())


def fold_policy_changes(current: DataFrame, changes: DataFrame, most_custom: int = 50, scope: str | None = None) -> DataFrame:
    """(scope, held, verdicts): custom policies by name, and what became of each change, after the changes in order of seq.

    changes: op, seq, name and a policy's columns, as many a name as there are; each meets what the ones
    before it left, so a name can be deleted and created again, and a deletion makes room under the limit.
    create: a new name of 2-60 capitals, digits and underscores that no built-in policy has, within
    ``most_custom`` custom ones; null columns get defaults. update: null columns keep what they were, one at
    least is given, and the merged buckets are validated. delete: the name must exist. Built-in policies do
    not change. scope: a column of both tables that says whose policies they are, each with a limit of its
    own (None: all are one's). What people change in one scope is folded in one task.
    """
    fields = [f for f in current.columns if f not in ("name", "builtin", scope)]
    kinds = {f: current.schema[f].dataType for f in fields}
    whose = F.col(scope) if scope else F.lit("")
    given = F.struct(*((F.col(f) if f in changes.columns else F.lit(None)).cast(kinds[f]).alias(f) for f in fields))
    log = changes.groupBy(whose.alias("scope")).agg(F.array_sort(F.collect_list(F.struct("seq", "name", "op", given.alias("given")))).alias("log"))
    custom = current.filter(~F.col("builtin")).groupBy(whose.alias("scope")).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct(*fields)))).alias("held"))
    rows = log.join(custom, "scope", "full")
    held = rows.schema["held"].dataType.simpleString()
    verdict = f"struct<seq:{changes.schema['seq'].dataType.simpleString()},name:string,op:string,reason:string,classification:string,audience:string>"

    def merged(c: Column, old: Column) -> Column:
        usual = {"classification": F.lit("INTERNAL"), "audience": F.coalesce(c["given"]["classification"], F.lit("INTERNAL")), "active": F.lit(True)}
        value = lambda f: F.coalesce(c["given"][f], F.when(c["op"] == "create", usual.get(f, F.array().cast(kinds[f]) if f in BUCKETS else F.lit(None))).otherwise(old[f]))
        return F.struct(*(value(f).cast(kinds[f]).alias(f) for f in fields))

    def judged(c: Column, old: Column, new: Column, n: Column) -> Column:
        create, update = c["op"] == "create", c["op"] == "update"
        empty = F.lit(True)
        for f in fields:
            empty = empty & c["given"][f].isNull()
        return F.struct(new.alias("new"), (
            F.when(~c["op"].isin("create", "update", "delete") | c["op"].isNull(), "no such operation")
            .when(create & ~F.coalesce(c["name"].rlike("^[A-Z][A-Z0-9_]+\\z") & F.length(c["name"]).between(2, 60), F.lit(False)), "invalid name")
            .when(c["name"].isin(list(BUILTIN)), "built-in policies cannot be changed")
            .when(~create & old.isNull(), "no such policy")
            .when(update & empty, "nothing to update")
            .when(create | update, spans.let(bucket_errors(lambda b: new[b]), lambda e: F.when(F.size(e) > 0, F.array_join(e, " ")).when(create & (n >= most_custom), "too many custom policies").when(create & old.isNotNull(), "name is taken")))
        ).alias("reason"))

    def step(state: Column, c: Column) -> Column:
        def after(j: Column) -> Column:
            others = F.map_filter(state["held"], lambda k, _: k != c["name"])
            now = F.when(j["reason"].isNotNull(), state["held"]).when(c["op"] == "delete", others).otherwise(F.map_concat(others, F.create_map(c["name"], j["new"])))
            said = F.struct(c["seq"], c["name"], c["op"], j["reason"].alias("reason"), j["new"]["classification"], j["new"]["audience"]).cast(verdict)
            return F.struct(now.cast(held).alias("held"), F.concat(state["verdicts"], F.array(said)).alias("verdicts"))

        old = lambda use: spans.let(F.struct(F.when(c["name"].isNotNull(), F.try_element_at(state["held"], c["name"])).alias("old")), lambda o: use(o["old"]))
        return old(lambda o: spans.let(merged(c, o), lambda new: spans.let(judged(c, o, new, F.size(F.map_keys(state["held"]))), after)))

    start = F.struct(F.coalesce("held", F.create_map().cast(held)).alias("held"), F.array().cast(f"array<{verdict}>").alias("verdicts"))
    end = F.aggregate(F.coalesce("log", F.array().cast(rows.schema["log"].dataType)), start, step)
    return rows.select("scope", end.alias("end")).select("scope", "end.held", "end.verdicts")


def apply_policy_changes(current: DataFrame, changes: DataFrame, most_custom: int = 50, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(policies, rejected) after a table of changes, as ``fold_policy_changes`` does them; rejected: name, op, seq, reason."""
    folded = fold_policy_changes(current, changes, most_custom, scope)
    one = folded.select("scope", F.explode(F.map_entries("held")).alias("p"))
    whose = {scope: F.col("scope")} if scope else {}
    columns = {"name": F.col("p.key"), "builtin": F.lit(False), **whose}
    custom = one.select(*(columns.get(c, F.col(f"p.value.{c}")).cast(current.schema[c].dataType).alias(c) for c in current.columns))
    verdicts = policy_verdicts(folded)
    rejected = verdicts.filter("reason IS NOT NULL").select(*([F.col("scope").alias(scope)] if scope else []), "name", "op", "seq", "reason")
    return current.filter("builtin").unionByName(custom), rejected


def policy_verdicts(folded: DataFrame) -> DataFrame:
    """(scope, seq, name, op, reason, classification, audience): a row per change; reason is null for what was done."""
    return folded.select("scope", F.inline("verdicts"))


def policy_audit(verdicts: DataFrame) -> DataFrame:
    """(document_id, actor, action, detail) of the changes that were done."""
    done = verdicts.filter("reason IS NULL")
    how = F.when(F.col("op") == "create", F.concat(F.lit(": "), "classification", F.lit(" for "), "audience")).otherwise("")
    return done.select(
        F.lit(None).cast("string").alias("document_id"), F.lit("analyst").alias("actor"), F.concat(F.lit("POLICY_"), F.upper("op")).alias("action"),
        F.concat(F.lit("Policy "), "name", F.lit(" "), F.rtrim("op", F.lit("e")), F.lit("ed"), how).alias("detail"),
    )


def decide_action(category: Column, type_: Column, default: Column, buckets: Column, override: Column | None = None) -> Column:
    """The action for a finding under a policy's buckets (a struct); a reviewer's choice comes first, but never frees a secret or an injection."""
    has = lambda b: F.array_contains(buckets[b], type_) | F.array_contains(buckets[b], category)
    injected = category == "PROMPT_INJECTION"
    by_policy = (
        F.when(injected, "QUARANTINE").when(has("allow"), "ALLOW").when(has("block"), "REDACT").when(has("remove"), "REDACT").when(has("mask"), "MASK").otherwise(default)
    )
    if override is None:
        return by_policy
    return (
        F.when(override.isNull(), by_policy).when(injected & ~override.isin("QUARANTINE", "REDACT"), "QUARANTINE")
        .when((override == "ALLOW") & (category == "SECRET"), "REDACT").otherwise(override)
    )


def recommend_profile(classification: Column) -> Column:
    out = F.lit(DEFAULT)
    for k, v in PROFILE_OF.items():
        out = F.when(classification == k, v).otherwise(out)
    return out


def allowed_override_actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i, a) for c, xs in CHOICES.items() for i, a in enumerate(xs)], "category string, position int, action string")
