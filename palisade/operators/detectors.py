"""Detectors of sensitive spans, as records that ``scan`` turns into one column expression.

A record has the pattern, what a finding says, and gates: conditions on a match beyond the pattern.
The records are in order of evaluation; within a pass an earlier finding shadows later ones that
overlap it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import checks
from palisade.functions.regex import java
from palisade.functions.spans import near, part

# Word lists, patterns, weights and labels that results depend on.
UPI_HANDLES = ["upi", "ybl", "okhdfc", "okhdfcbank", "okicici", "oksbi", "okaxis", "paytm", "ibl", "axl", "apl", "abfspay", "eze", "idbi", "hsbc", "kotak", "pnb", "sbi"]
BIRTH = ["dob", "d.o.b", "birth", "born", "date of birth", "birthday"]
PLACE = ["address", "street", "road", "avenue", "city", "state", "zip", "pin", "postal", "residing", "lives at", "located at"]
CARD = ["card", "credit", "debit", "cvv", "expir", "payment", "visa", "mastercard", "amex", "rupay"]
BANK = ["bank", "account", "acct", "a/c", "ifsc", "iban", "upi", "vpa", "branch", "transfer", "remit"]
STOPWORDS = ["distribution", "description", "document", "information", "production", "management", "authentication", "authorization", "configuration", "following", "however", "therefore"]
NOT_NAMES = ["Team", "Project", "Department", "Internal", "External", "Security"]
NAME = r"[A-Z][a-z]+(?:['-][A-Za-z]+)?(?:\s+[A-Z][a-z]+(?:['-][A-Za-z]+)?){1,2}"
ROLES = ["Project Lead", "Engineer", "Lead", "Manager", "Analyst", "Officer", "Member", "Director", "Architect", "Contact", "Author", "Owner", "Reporter", "Supervisor", "Coordinator", "Administrator", "Customer", "Client", "Candidate", "Recruiter", "Colleague", "Prepared by", "Reported by", "Full Name", "Name", "POC"]
SECRET_CONTEXT = r"(?i)\b(token|secret|password|passwd|credential|api[_-]?key|access[_-]?key|private[_-]?key|authorization|bearer|client[_-]?secret)\b"
INVISIBLE = "​‌‍﻿⁠‮‭‪⁦⁧⁨⁩­"
SMUGGLED = ["ignore previous instructions", "disregard", "reveal the system prompt", "jailbreak", "system override"]

#: Fields of a finding, before its document's id.
FINDING = "array<struct<category:string,type:string,severity:string,confidence:double,default_action:string,start:int,end:int,matched_text:string,masked_text:string,reason:string>>"


@dataclass(frozen=True)
class Detector:
    name: str
    category: str
    type: str
    severity: str
    confidence: float
    action: str
    mask: str
    reason: str
    patterns: tuple[str, ...]
    #: (text, span) -> whether the match counts; the SQL twin takes text, s, e, m.
    gate: Callable[[Column, Column], Column] | None = None
    gate_sql: str = ""
    #: Expressions in place of the constants.
    confidence_of: Callable[[Column, Column], Column] | None = None
    confidence_sql: str = ""
    mask_of: Callable[[Column], Column] | None = None
    mask_sql: str = ""
    reason_of: Callable[[Column, Column], Column] | None = None
    #: RE2's form where a pattern needs a lookaround. Of the pattern numbered extra["lead"] it takes one character too many in front.
    sql_patterns: tuple[str, ...] = ()
    #: The span is the part of the match that this pattern's group captures, at the match's end.
    inner: str = ""
    switch: str = ""
    cut: int = 0
    extra: dict = field(default_factory=dict)
    #: Cheap conditions without which there can be no match: see NEEDS and DIGITS.
    needs: tuple[tuple[str, ...], ...] = ()
    digits: int = 0
    digit_run: int = 0
    #: A Java pattern that the text's numbers must show, each with the characters beside it, for all patterns or for each; see SHAPES.
    shape: str | tuple[str, ...] = ""
    #: One that the text itself must show.
    frame: str = ""


def _near_sql(words: list[str], window: int) -> str:
    around = f"lower(substring(text, greatest(0, s - {window}) + 1, e + {window} - greatest(0, s - {window})))"
    return "(" + " OR ".join(f"contains({around}, '{w}')" for w in words) + ")"


def _near(words: list[str], window: int):
    return lambda text, x: near(text, x["start"], x["end"], words, window)


def _domain(x: Column) -> Column:
    return F.lower(F.split_part(x["matched"], F.lit("@"), F.lit(2)))


def _pii(name, type, severity, confidence, action, mask, reason, *patterns, **more) -> Detector:
    return Detector(name, "PII", type, severity, confidence, action, mask, reason, patterns, **more)


def _digits(x: Column) -> Column:
    return checks.digits_of(x["matched"])


DIGITS_SQL = "regexp_replace(m, '[^0-9]', '', 'g')"
HANDLES_SQL = "(" + ", ".join(f"'{h}'" for h in UPI_HANDLES) + ")"
SAME_SQL = "len(list_distinct(string_split({}, ''))) = 1"
LUHN_SQL = f"(list_sum(list_transform(range(1, length({DIGITS_SQL}) + 1), lambda i: CASE WHEN (length({DIGITS_SQL}) - i) % 2 = 0 THEN {DIGITS_SQL}[i]::INT ELSE {DIGITS_SQL}[i]::INT * 2 - CASE WHEN {DIGITS_SQL}[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"
_IBAN = "upper(regexp_replace(m, '[ -]', '', 'g'))"
IBAN_SQL = (
    f"(length({_IBAN}) BETWEEN 15 AND 34 AND list_reduce(list_concat([0], list_transform(string_split({_IBAN}[5:] || {_IBAN}[1:4], ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 55 + 1000 ELSE ascii(c) - 48 END)),"
    " lambda a, c: CASE WHEN c >= 1000 THEN (a * 100 + c - 1000) % 97 ELSE (a * 10 + c) % 97 END) = 1)"
)

_email = lambda text, x: ~_domain(x).isin(UPI_HANDLES)
_upi = lambda text, x: _domain(x).isin(UPI_HANDLES) | near(text, x["start"], x["end"], ["upi", "vpa", "pay"], 40)
_card = lambda text, x: F.length(_digits(x)).between(13, 19) & ~checks.same_digit(_digits(x), 12, 18) & (checks.luhn(_digits(x)) | near(text, x["start"], x["end"], CARD, 60))
_bank_iban = lambda text, x: F.length(F.regexp_replace(x["matched"], java(r"\s"), "")).between(15, 34) & (checks.iban(x["matched"]) | near(text, x["start"], x["end"], BANK, 60))
_phone = lambda text, x: (
    (x["start"] == 0) | ~part(text, F.greatest(x["start"] - 1, F.lit(0)), F.lit(1)).rlike("[0-9]")
) & ~part(text, x["end"], F.lit(1)).rlike("[0-9]") & F.length(_digits(x)).between(8, 15) & ~checks.same_digit(_digits(x), 7)
_long = lambda n: lambda text, x: x["end"] - x["start"] >= n

#: The personal-data pass, in order.
PII = [
    _pii("email", "EMAIL", "MEDIUM", 0.97, "MASK", "", "Personal email address.", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
         gate=_email, gate_sql=f"lower(split_part(m, '@', 2)) NOT IN {HANDLES_SQL}", mask_of=checks.mask_email,
         mask_sql="CASE WHEN instr(m, '@') <= 2 THEN '[EMAIL_REDACTED]' ELSE m[1] || '***@***' || substring(split_part(m, '@', 2), instr(split_part(m, '@', 2), '.')) END"),
    _pii("upi", "UPI", "HIGH", 0.86, "REDACT", "[UPI_REDACTED]", "Payment identifier.", r"[\w.\-]{2,}@[a-zA-Z]{2,}",
         gate=_upi, gate_sql=f"(lower(split_part(m, '@', 2)) IN {HANDLES_SQL} OR {_near_sql(['upi', 'vpa', 'pay'], 40)})"),
    _pii("card", "CREDIT_CARD", "CRITICAL", 0.97, "REDACT", "[CARD_REDACTED]", "Payment card number.", r"\b(?:\d[ -]*?){13,19}\b",
         gate=_card, gate_sql=f"length({DIGITS_SQL}) BETWEEN 13 AND 19 AND NOT {SAME_SQL.format(DIGITS_SQL)} AND ({LUHN_SQL} OR {_near_sql(CARD, 60)})",
         confidence_of=lambda text, x: F.when(checks.luhn(_digits(x)), 0.97).otherwise(0.72), confidence_sql=f"CASE WHEN {LUHN_SQL} THEN 0.97 ELSE 0.72 END"),
    _pii("aadhaar", "AADHAAR", "CRITICAL", 0.92, "REDACT", "[AADHAAR_REDACTED]", "National identity number.", r"\b\d{4}\s?\d{4}\s?\d{4}\b",
         gate=lambda text, x: ~checks.same_digit(_digits(x), 11, 11), gate_sql=f"NOT {SAME_SQL.format(DIGITS_SQL)}"),
    _pii("pan", "PAN", "HIGH", 0.9, "REDACT", "[PAN_REDACTED]", "Tax account number.", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    _pii("ssn", "SSN", "CRITICAL", 0.94, "REDACT", "[SSN_REDACTED]", "Social security number.", r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b",
         sql_patterns=(r"\b\d{3}-\d{2}-\d{4}\b",), gate_sql="m[1:3] NOT IN ('000', '666') AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:11] <> '0000'"),
    _pii("passport_us", "PASSPORT", "CRITICAL", 0.85, "REDACT", "[PASSPORT_REDACTED]", "Passport number.", r"\b[CEHX][0-9]{8}\b"),
    _pii("passport_in", "PASSPORT", "CRITICAL", 0.82, "REDACT", "[PASSPORT_REDACTED]", "Passport number.", r"\b[A-Z][0-9]{7}\b", gate=_near(["passport"], 50), gate_sql=_near_sql(["passport"], 50)),
    _pii("drivers_license", "DRIVERS_LICENSE", "HIGH", 0.84, "REDACT", "[DL_REDACTED]", "Driving licence number.", r"\b[A-Z]{2}\d{2}\s?\d{4}\s?\d{7}\b"),
    _pii("zip", "POSTAL_CODE", "MEDIUM", 0.72, "MASK", "[ZIP_MASKED]", "Postal code near address words.", r"\b\d{5}(?:-\d{4})?\b", gate=_near(PLACE, 60), gate_sql=_near_sql(PLACE, 60)),
    _pii("pin", "POSTAL_CODE", "MEDIUM", 0.74, "MASK", "[PIN_MASKED]", "Postal code near address words.", r"\b[1-9]\d{5}\b", gate=_near([*PLACE, "pin code"], 60), gate_sql=_near_sql([*PLACE, "pin code"], 60)),
    _pii("address", "ADDRESS", "HIGH", 0.78, "REDACT", "[ADDRESS_REDACTED]", "Street or postal address.",
         r"\b\d{1,5}\s+[A-Z][a-z0-9.'-]*(?:\s+[A-Z][a-z0-9.'-]+){0,3}\s+(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Circle|Cir|Parkway|Pkwy|Terrace|Place|Plaza)\b", r"(?i)\bP\.?\s?O\.?\s?Box\s+\d{1,6}\b"),
    _pii("iban", "IBAN", "CRITICAL", 0.95, "REDACT", "[IBAN_REDACTED]", "Bank account number.", r"\b[A-Z]{2}\d{2} ?(?:[A-Z0-9]{4} ?){2,7}[A-Z0-9]{0,4}\b",
         gate=_bank_iban, gate_sql=f"length(regexp_replace(m, '[ ]', '', 'g')) BETWEEN 15 AND 34 AND ({IBAN_SQL} OR {_near_sql(BANK, 60)})",
         confidence_of=lambda text, x: F.when(checks.iban(x["matched"]), 0.95).otherwise(0.7), confidence_sql=f"CASE WHEN {IBAN_SQL} THEN 0.95 ELSE 0.7 END"),
    _pii("ifsc", "IFSC", "HIGH", 0.9, "REDACT", "[IFSC_REDACTED]", "Bank branch code.", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    _pii("cvv", "CREDIT_CARD", "CRITICAL", 0.9, "REDACT", "[CVV_REDACTED]", "Card verification value.", r"(?i)\bCVV\s*[:=\-]?\s*(\d{3,4})\b"),
    _pii("expiry", "CREDIT_CARD", "HIGH", 0.8, "REDACT", "[EXPIRY_REDACTED]", "Card expiry date.",
         r"(?i)\b(?:expir(?:y|ation|es)|exp\.?|valid\s+(?:thru|through|till))\s*[:=\-]?\s*((?:0[1-9]|1[0-2])[/\-.](?:\d{2}|\d{4}))\b", gate=_near([*CARD, "valid"], 30), gate_sql=_near_sql([*CARD, "valid"], 30)),
    _pii("bank_account", "BANK_ACCOUNT", "CRITICAL", 0.72, "REDACT", "[ACCOUNT_REDACTED]", "Account number near bank words.", r"\b\d{9,18}\b",
         gate=lambda text, x: ~checks.same_digit(x["matched"], 8) & near(text, x["start"], x["end"], BANK, 60), gate_sql=f"NOT {SAME_SQL.format('m')} AND {_near_sql(BANK, 60)}"),
    _pii("phone", "PHONE", "MEDIUM", 0.85, "MASK", "", "Phone number.",
         r"(?:\+91[-.\s]?)?[6-9]\d{4}[-.\s]?\d{5}", r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", r"\+44[-.\s]?\d{4}[-.\s]?\d{3}[-.\s]?\d{3}",
         r"\B\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}(?:\s?(?:x|ext\.?)\s?\d{2,6})?\b",
         gate=_phone, gate_sql=f"NOT regexp_matches(CASE WHEN s = 0 THEN '' ELSE text[s] END, '[0-9]') AND NOT regexp_matches(text[e + 1], '[0-9]') AND length({DIGITS_SQL}) BETWEEN 8 AND 15 AND NOT {SAME_SQL.format(DIGITS_SQL)}",
         mask_of=checks.mask_phone, mask_sql=f"CASE WHEN length({DIGITS_SQL}) < 4 THEN '[PHONE_REDACTED]' ELSE '***-***-' || right({DIGITS_SQL}, 2) END", extra={"apart": True}),
    _pii("birth_month", "DATE_OF_BIRTH", "HIGH", 0.82, "REDACT", "[DOB_REDACTED]", "Date with a month's name.", r"(?i)\b(?:\d{1,2}[-/\s](?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[-/\s]\d{4})\b"),
    _pii("birth_date", "DATE_OF_BIRTH", "HIGH", 0.78, "REDACT", "[DOB_REDACTED]", "Date near birth words.",
         r"\b(?:0?[1-9]|[12]\d|3[01])[/\-.](?:0?[1-9]|1[0-2])[/\-.](?:19|20)\d{2}\b", r"\b(?:19|20)\d{2}[/\-.](?:0?[1-9]|1[0-2])[/\-.](?:0?[1-9]|[12]\d|3[01])\b", r"\b(?:0?[1-9]|1[0-2])\/(?:0?[1-9]|[12]\d|3[01])\/(?:19|20)\d{2}\b",
         gate=_near(BIRTH, 50), gate_sql=_near_sql(BIRTH, 50)),
    Detector("ip", "INTERNAL_ASSET", "IP_ADDRESS", "MEDIUM", 0.8, "REPLACE", "[INTERNAL_HOST]", "Network address.", (r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",), switch="internal_assets"),
    Detector("ipv6", "INTERNAL_ASSET", "IPV6_ADDRESS", "MEDIUM", 0.78, "REPLACE", "[INTERNAL_HOST_V6]", "Network address.",
             (r"""(?:\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b|\b::1\b|\b::\b|\bfe80::[^\s"']*)""",), gate=_long(3), gate_sql="e - s >= 3", switch="internal_assets"),
    _pii("org_id", "ORG_ID", "MEDIUM", 0.75, "REDACT", "[EMPLOYEE_ID]", "Employee identifier.", r"(?i)\b(?:EMP|EMP-|ID-|EID-|STAFF-)\d{0,4}-?\d{3,6}\b"),
    Detector("internal_url", "INTERNAL_ASSET", "INTERNAL_URL", "HIGH", 0.9, "REDACT", "[INTERNAL_URL_REDACTED]", "Internal host or URL.",
             (r"""(?i)\bhttps?:\/\/(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|internal\.|intranet\.)[^\s"']+""",
              r"""(?i)(?:https?:\/\/)?(?:localhost|127\.\d+\.\d+\.\d+|0\.0\.0\.0|\[?::1\]?)(?::\d{1,5})?(?:\/[^\s"']*)?""",
              r"""(?i)(?<![\w@/:/])(?:[a-z0-9-]+\.)+(?:internal|intranet|local|corp)(?::\d{1,5})?(?:\/[^\s"']*)?"""),
             gate=_long(4), gate_sql="e - s >= 4", switch="internal_assets", extra={"lead": 2},
             sql_patterns=(r"""(?i)\bhttps?:\/\/(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|internal\.|intranet\.)[^\s"']+""",
                           r"""(?i)(?:https?:\/\/)?(?:localhost|127\.\d+\.\d+\.\d+|0\.0\.0\.0|\[?::1\]?)(?::\d{1,5})?(?:\/[^\s"']*)?""",
                           r"""(?i)(?:^|[^\w@/:/])(?:[a-z0-9-]+\.)+(?:internal|intranet|local|corp)(?::\d{1,5})?(?:\/[^\s"']*)?""")),
    Detector("unsafe_url", "UNSAFE_URL", "UNSAFE_URL", "HIGH", 0.9, "REDACT", "[URL_REMOVED]", "URL scheme that can run or read things.",
             (r"""(?i)(?:javascript\s*:|vbscript\s*:|data\s*:\s*text\/html|file\s*:\/\/[^\s"']+)""",), switch="unsafe_urls"),
    Detector("project", "INTERNAL_ASSET", "INTERNAL_PROJECT", "MEDIUM", 0.68, "REPLACE", "[INTERNAL_PROJECT]", "Internal project or code name.",
             (r"""\b(?:Project|Operation|Codename|Code-name|Internal project)\s+["“']?([A-Z][A-Za-z0-9-]{2,30})["”']?""",), switch="internal_assets"),
    _pii("person", "PERSON_NAME", "MEDIUM", 0.62, "REPLACE", "[PERSON]", "Name behind a role label.", rf"(?:{'|'.join(ROLES)})\s*[:\-]\s*({NAME})",
         inner=rf"[:\-]\s*({NAME})", gate=lambda text, x: ~x["matched"].rlike(java(rf"^(?i:{'|'.join(NOT_NAMES)})\s")), gate_sql=f"NOT regexp_matches(m, '^(?i:{'|'.join(NOT_NAMES)})[ \\t\\n]')"),
]


def _secret(name, type, label, confidence, reason, pattern, **more) -> Detector:
    severe = type in ("PRIVATE_KEY", "DB_CONN_STRING", "CLOUD_CRED")
    return Detector(name, "SECRET", type, "CRITICAL" if severe else "HIGH", confidence, "REDACT", f"[{label}_REDACTED]", reason, (pattern,), **more)


# Assignments, and what they need.
ASSIGNED = r"""(?i)\b(?:api[_-]?key|secret|token|password|passwd|pwd|access[_-]?token|client[_-]?secret)["'\s:=]+([A-Za-z0-9_\-./+]{12,})"""
ASSIGNED_NEEDS = ("key", "secret", "token", "passw", "pwd")
#: Characters a context word may be away from an assignment.
CONTEXT_WINDOW = 80


def assigned_value(matched: Column) -> Column:
    return F.regexp_extract(matched, java(ASSIGNED), 1)


#: The credentials pass, in order; assignments follow it.
SECRETS = [
    _secret("aws_key_id", "API_KEY", "AKIA", 0.96, "Access key id.", r"\b(?:AKIA|ASIA)[0-9A-Z]{12,20}\b"),
    _secret("aws_secret", "CLOUD_CRED", "AWS_SECRET", 0.97, "Secret access key.", r"""(?i)(?:aws[_-]?secret[_-]?access[_-]?key)["'\s:=]+([A-Za-z0-9/+=]{30,})"""),
    _secret("github", "API_KEY", "GitHub PAT", 0.95, "Repository token.", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{10,}\b"),
    _secret("github_fine", "API_KEY", "GitHub PAT", 0.95, "Fine-grained repository token.", r"\bgithub_pat_[A-Za-z0-9_]{10,}\b"),
    _secret("gitlab", "API_KEY", "GitLab PAT", 0.94, "Repository token.", r"\bglpat-[A-Za-z0-9_-]{10,}\b"),
    _secret("npm", "API_KEY", "npm token", 0.93, "Package registry token.", r"\bnpm_[A-Za-z0-9]{10,}\b"),
    _secret("slack", "API_KEY", "Slack token", 0.93, "Messaging token.", r"(?i)\bxox[abcdeoprs]-[A-Za-z0-9-]{10,}\b"),
    _secret("stripe", "API_KEY", "Stripe key", 0.96, "Payment key.", r"\b(?:sk_live|rk_live|sk_test|rk_test|whsec)_[A-Za-z0-9]{10,}\b"),
    _secret("gcp_api", "CLOUD_CRED", "GCP_API_KEY", 0.94, "Cloud API key.", r"\bAIza[0-9A-Za-z_-]{35}\b"),
    _secret("jwt", "JWT", "JWT", 0.92, "Signed web token.", r"\beyJ[A-Za-z0-9_-]{6,}\.eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\b"),
    _secret("pem", "PRIVATE_KEY", "PEM", 0.99, "Private key block.", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    _secret("pgp", "PRIVATE_KEY", "PGP", 0.99, "Private key block.", r"-----BEGIN PGP PRIVATE KEY BLOCK-----[\s\S]*?-----END PGP PRIVATE KEY BLOCK-----"),
    _secret("ssh", "PRIVATE_KEY", "SSH", 0.93, "Key material.", r"\bssh-(?:rsa|ed25519|ecdsa)\s+[A-Za-z0-9+/=]{20,}(?:\s+\S+)?"),
    _secret("db_uri", "DB_CONN_STRING", "URI", 0.98, "Connection string.", r"""(?i)\b(?:postgres|postgresql|mongodb(\+srv)?|mysql|redis|amqp):\/\/[^\s"']+"""),
    _secret("azure_connection", "CLOUD_CRED", "AZURE_CONN", 0.97, "Storage connection string.", r"(?i)DefaultEndpointsProtocol=https?;AccountName=[^;]+;AccountKey=[^;]+"),
    _secret("azure_key", "CLOUD_CRED", "AZURE_KEY", 0.95, "Account key.", r"(?i)AccountKey\s*=\s*([A-Za-z0-9+/=]{20,})"),
    _secret("gcp_service_account", "CLOUD_CRED", "GCP_SA", 0.9, "Service account marker.", r'(?i)"type"\s*:\s*"service_account"'),
    _secret("bearer", "AUTH_TOKEN", "BEARER", 0.9, "Bearer credential.", r"\bBearer\s+[A-Za-z0-9\-._~+/]+=*"),
    _secret("basic", "AUTH_TOKEN", "BASIC", 0.88, "Basic credential.", r"\bBasic\s+[A-Za-z0-9+/=]{12,}"),
    _secret("sk_key", "API_KEY", "sk-", 0.9, "API key.", r"\bsk-[A-Za-z0-9]{14,}\b"),
]


def _injection(name, type, severity, confidence, mask, reason, *patterns, **more) -> Detector:
    return Detector(name, "PROMPT_INJECTION", type, severity, confidence, "QUARANTINE", mask, reason, patterns, **more)


_QUARANTINED, _REMOVED = "[INJECTION_QUARANTINED]", "[HIDDEN_INSTRUCTION_REMOVED]"
_phrase = lambda name, severity, pattern: _injection(name, "INJECTION_PHRASE", severity, 0.9, _QUARANTINED, "Instruction override.", f"(?i){pattern}")

#: The injection pass, in order; smuggling by invisible characters follows it.
INJECTIONS = [
    _phrase("ignore_instructions", "CRITICAL", r"ignore (?:all )?(?:previous|prior) instructions"),
    _phrase("disregard_instructions", "CRITICAL", r"disregard (?:all )?(?:previous |prior )?instructions"),
    _phrase("forget_instructions", "CRITICAL", r"forget (?:all )?(?:your |previous |prior )?instructions"),
    _phrase("reveal_prompt", "CRITICAL", r"reveal (?:the )?system prompt"),
    _phrase("privileged_mode", "HIGH", r"you are now (?:in |operating in )?(?:privileged|operator|admin|root) mode"),
    _phrase("no_longer_bound", "HIGH", r"you are no longer bound by"),
    _phrase("stop_summarizing", "HIGH", r"stop summarizing"),
    _phrase("override_complete", "HIGH", r"system override complete"),
    _phrase("release_data", "CRITICAL", r"release all data"),
    _phrase("do_anything", "CRITICAL", r"do anything now"),
    _phrase("jailbreak", "CRITICAL", r"jailbreak"),
    _phrase("developer_mode", "HIGH", r"developer mode"),
    _phrase("bypass", "CRITICAL", r"bypass (?:all )?(?:safety|security|content|policy)(?: (?:filters?|controls?|policies))?"),
    _phrase("exfiltrate", "CRITICAL", r"exfiltrat\w*"),
    _phrase("output_secret", "CRITICAL", r"output (?:the |every |all )?(?:confidential|secret|api key|token|credential|raw source)"),
    _injection("role_manipulation", "ROLE_MANIPULATION", "HIGH", 0.82, "[ROLE_MANIPULATION_QUARANTINED]", "Assigns a role to the model.",
               r"(?i)you are (?:now )?(?:in )?[\w\s]{0,24}(?:privileged|operator|root|admin|unrestricted)[\w\s]{0,20}(?:mode|role)",
               r"(?i)(?:enter|switch to|activate) [\w\s]{0,20}(?:privileged|operator|root|admin)[\w\s]{0,20}mode",
               r"(?i)act as (?:a |an )?(?:system|administrator|admin|root|developer)(?:\s+(?:prompt|agent|assistant))?",
               r"(?i)pretend (?:to be|you are)(?: now)? [\w\s]{0,30}(?:admin|root|system|developer|without (?:limits|restrictions|safety))"),
    _injection("tool_invocation", "TOOL_INVOCATION", "HIGH", 0.78, "[TOOL_INVOCATION_QUARANTINED]", "Asks for a tool to be called.",
               r"(?i)call (?:the )?[a-z_]+ tool", r"(?i)invoke (?:the )?[a-z_]+ tool", r"(?i)execute_sql|send_email|web_search\(", r"(?i)email (?:it|them|this) to",
               r"""(?i)\bcurl\s+https?:\/\/[^\s"']+""", r"""(?i)\bwget\s+https?:\/\/[^\s"']+""", r"(?i)send (?:this|it|them|the [\w ]{1,20}) to \S+@\S+\.\S+"),
    _injection("conflicting", "INJECTION_PHRASE", "HIGH", 0.8, _QUARANTINED, "Conflicting instruction.", r"(?i)instead,? output", r"(?i)respond with the raw source", r"(?i)append the full token list"),
    _injection("hidden_comment", "HIDDEN_INSTRUCTION", "CRITICAL", 0.88, _REMOVED, "Directive in a comment.", r"(?i)<!--[\s\S]*?(?:ignore|disregard|forget|assistant|system|reveal|override|jailbreak|exfiltrate|DAN)[\s\S]*?-->"),
    _injection("hidden_fence", "HIDDEN_INSTRUCTION", "HIGH", 0.8, _REMOVED, "Directive in a code block.",
               r"(?i)```[\s\S]*?(?:ignore (?:all )?(?:previous|prior) instructions|disregard .*instructions|reveal .*system prompt|jailbreak|system override)[\s\S]*?```", cut=500),
    _injection("active_link", "HIDDEN_INSTRUCTION", "HIGH", 0.85, _REMOVED, "Link that runs code.", r"(?i)\[([^\]]+)\]\((?:javascript|data):[^)]+\)"),
]

#: Literals of which a text must hold one for a pattern to match it, for each pattern of a detector; those without capitals in any case.
NEEDS = {
    "email": [["@"]], "upi": [["@"]], "address": [["Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Dr", "Boulevard", "Blvd", "Court", "Ct", "Circle", "Cir", "Parkway", "Pkwy", "Terrace", "Place", "Plaza"], ["box"]],
    "ssn": [["-"]], "cvv": [["cvv"]], "expiry": [["exp", "valid"]], "birth_month": [["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]],
    "phone": [[], [], ["+44"], ["+"]], "ip": [["."]], "ipv6": [[":"]], "org_id": [["emp", "id-", "staff-"]], "passport_in": [["passport"]],
    "internal_url": [["http://", "https://"], ["localhost", "127.", "0.0.0.0", "::1"], [".internal", ".intranet", ".local", ".corp"]],
    "unsafe_url": [["javascript", "vbscript", "data", "file"]], "project": [["Project", "Operation", "Codename", "Code-name", "Internal project"]], "person": [ROLES],
    "aws_key_id": [["AKIA", "ASIA"]], "aws_secret": [["secret"]], "github": [["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]], "github_fine": [["github_pat_"]], "gitlab": [["glpat-"]], "npm": [["npm_"]], "slack": [["xox"]],
    "stripe": [["_live_", "_test_", "whsec_"]], "gcp_api": [["AIza"]], "jwt": [["eyJ"]], "pem": [["PRIVATE KEY"]], "pgp": [["PGP PRIVATE KEY"]], "ssh": [["ssh-"]], "db_uri": [["://"]], "azure_connection": [["accountkey"]],
    "azure_key": [["accountkey"]], "gcp_service_account": [["service_account"]], "bearer": [["Bearer"]], "basic": [["Basic"]], "sk_key": [["sk-"]],
    "ignore_instructions": [["ignore "]], "disregard_instructions": [["disregard "]], "forget_instructions": [["forget "]], "reveal_prompt": [["reveal "]], "privileged_mode": [["you are now"]], "no_longer_bound": [["no longer bound"]],
    "stop_summarizing": [["stop summarizing"]], "override_complete": [["override complete"]], "release_data": [["release all data"]], "do_anything": [["do anything now"]], "jailbreak": [["jailbreak"]], "developer_mode": [["developer mode"]],
    "bypass": [["bypass "]], "exfiltrate": [["exfiltrat"]], "output_secret": [["output "]],
    "role_manipulation": [["you are "], ["mode"], ["act as "], ["pretend "]],
    "tool_invocation": [[" tool"], [" tool"], ["execute_sql", "send_email", "web_search("], ["email "], ["curl"], ["wget"], ["send "]],
    "conflicting": [["instead"], ["raw source"], ["full token list"]], "hidden_comment": [["<!--"]], "hidden_fence": [["```"]], "active_link": [["](javascript:", "](data:"]],
}
#: Digits that a text must have, in all and in one run.
DIGITS = {
    "card": (13, 1), "aadhaar": (12, 4), "pan": (4, 4), "ssn": (9, 4), "passport_us": (8, 8), "passport_in": (7, 7), "drivers_license": (13, 7), "zip": (5, 5), "pin": (6, 6), "address": (1, 1), "iban": (2, 2), "ifsc": (1, 1), "cvv": (3, 3),
    "expiry": (4, 2), "bank_account": (9, 9), "phone": (8, 1), "birth_month": (5, 4), "birth_date": (6, 4), "ip": (4, 1), "org_id": (3, 3),
}
#: What the numbers of a text must look like; and what is looked for in the text itself.
SHAPES = {
    "aadhaar": "[0-9]{4}[^0-9]?[0-9]{4}[^0-9]?[0-9]{4}", "pan": "[A-Z][0-9]{4}[A-Z]", "ssn": "[0-9]-[0-9]{2}-[0-9]", "passport_us": "[CEHX][0-9]{8}", "passport_in": "[A-Z][0-9]{7}", "drivers_license": "[A-Z][0-9]{2}", "iban": "[A-Z][0-9]{2}",
    "ifsc": "[A-Z]0", "birth_date": "[0-9][-/.][0-9]", "ip": "[0-9][.][0-9]{1,3}[.][0-9]",
    "phone": ("[6-9][0-9]{4}[^0-9]?[0-9]{5}", "[0-9]{3}[^0-9]?[0-9]{4}", "", ""),
}
FRAMES = {"ipv6": ":[0-9A-Fa-f]{0,4}:"}


def _gated(d: Detector) -> Detector:
    total, run = DIGITS.get(d.name, (0, 0))
    return replace(d, needs=tuple(map(tuple, NEEDS.get(d.name, [[]] * len(d.patterns)))), digits=total, digit_run=run, shape=SHAPES.get(d.name, ""), frame=FRAMES.get(d.name, ""))


PII, SECRETS, INJECTIONS = (list(map(_gated, ds)) for ds in (PII, SECRETS, INJECTIONS))
ALL = {d.name: d for d in (*PII, *SECRETS, *INJECTIONS)}
