"""Intelligence extraction: entities, indicators of compromise, techniques, risks and key findings of a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.regex import core, java, marks
from palisade.functions.spans import let, spans_of_each
from palisade.functions.text import pieces_count, strip
from palisade.operators import risk
from palisade.operators.detectors import FRAMES, NAME
from palisade.operators.scan import Seen

# Patterns, keyword table and word lists.
IP = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
ENTITIES = [
    ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0.97),
    ("PHONE", r"(?:\+91[-.\s]?)?[6-9]\d{4}[-.\s]?\d{5}", 0.85),
    ("PHONE", r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", 0.82),
    ("PHONE", r"\+44[-.\s]?\d{4}[-.\s]?\d{3}[-.\s]?\d{3}", 0.82),
    ("IP", IP, 0.9),
    ("IP", r"(?:\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b|\b::1\b)", 0.85),
    ("URL", r"""(?i)\bhttps?:\/\/[^\s"']+""", 0.92),
    ("DATE", r"(?i)\b(?:\d{1,2}[-/\s](?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[-/\s]\d{4}|\d{4}-\d{2}-\d{2}|\d{2}\/\d{2}\/\d{4}|\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)\d{2})\b", 0.82),
    ("ID", r"(?i)\b(?:EMP|EMP-|ID-|EID-|STAFF-|CVE-\d{4}-\d{4,7})\S*", 0.78),
    ("ID", r"\b[A-Z]{5}\d{4}[A-Z]\b", 0.85),
    ("ID", r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", 0.88),
    ("ID", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.85),
]
PERSON_LABELS = ["Project Lead", "Engineer", "Lead", "Manager", "Analyst", "Officer", "Member", "Director", "Architect", "Team", "Contact", "Author", "Owner", "Reporter", "Supervisor", "Coordinator", "Administrator", "Customer", "Client", "Candidate", "Recruiter", "Prepared by", "Reported by", "Full Name", "Name", "POC"]
PERSON = rf"(?:{'|'.join(PERSON_LABELS)})\s*[:\-]?\s*({NAME})"
ORG = r"\b(?:Team|Project|Department|Division)\s+[A-Z][a-zA-Z0-9]+\b"
LOCATION = r"(?i)\b(?:Mumbai|Delhi|Bengaluru|Chennai|Kolkata|Hyderabad|Pune|internal|intranet|dashboard|datacenter)\b"
IOCS = [
    ("IP", IP, "MEDIUM", 0.88), ("DOMAIN", r"(?i)\b(?:[a-z0-9-]+\.)+(?:com|org|net|io|gov|edu|internal|intranet|local)\b", "MEDIUM", 0.75), ("URL", r"""(?i)\bhttps?:\/\/[^\s"'<>]+""", "MEDIUM", 0.9),
    ("HASH_MD5", r"\b[a-fA-F0-9]{32}\b", "HIGH", 0.8), ("HASH_SHA1", r"\b[a-fA-F0-9]{40}\b", "HIGH", 0.85), ("HASH_SHA256", r"\b[a-fA-F0-9]{64}\b", "HIGH", 0.88), ("CVE", r"(?i)\bCVE-\d{4}-\d{4,7}\b", "HIGH", 0.95),
]
#: MITRE id, technique, tactic, severity, keywords in order.
TTPS = [
    ("T1566", "Phishing", "Initial Access", "HIGH", ["phishing", "spear phishing", "spearphishing"]),
    ("T1003", "OS Credential Dumping", "Credential Access", "CRITICAL", ["credential dumping", "mimikatz", "lsass dumping"]),
    ("T1110", "Brute Force", "Credential Access", "HIGH", ["brute force", "password spraying", "credential stuffing"]),
    ("T1021", "Lateral Tool Transfer", "Lateral Movement", "HIGH", ["lateral movement", "psexec", "wmi execution"]),
    ("T1071", "Application Layer Protocol", "Command and Control", "HIGH", ["command and control", " c2 ", "beacon", "c2 channel"]),
    ("T1567", "Exfiltration Over Web Service", "Exfiltration", "HIGH", ["exfiltration", "data exfiltration", "exfiltrate"]),
    ("T1547", "Boot or Logon Autostart Execution", "Persistence", "MEDIUM", ["persistence", "scheduled task", "registry run key", "startup folder"]),
    ("T1078", "Valid Accounts", "Privilege Escalation", "HIGH", ["privilege escalation", "privileged mode", "operator mode", "privileged operator"]),
    ("T1027", "Obfuscated Files or Information", "Defense Evasion", "MEDIUM", ["defense evasion", "obfuscation", "hidden instruction", "bypass"]),
    ("T1046", "Network Service Discovery", "Discovery", "MEDIUM", ["discovery", "reconnaissance", "port scan", "network scan", "vulnerability scanning"]),
    ("T1059", "Command and Scripting Interpreter", "Execution", "MEDIUM", ["execution", "powershell", "cmd execution", "shell"]),
    ("T1005", "Data from Local System", "Collection", "MEDIUM", ["collection", "data collection", "keylogging"]),
    ("T1485", "Data Destruction", "Impact", "CRITICAL", ["impact", "ransomware", "data destruction", "denial of service"]),
    ("T1202", "Indirect Command Execution", "Defense Evasion", "HIGH", ["injection", "prompt injection", "ignore previous instructions", "system override"]),
]
#: Without what there can be no match, for each pattern in order: words, digits in all and in one run, the shape of numbers, a pattern of the text.
WEB = ("http://", "https://")
ENTITY_NEEDS: list[dict] = [
    {"words": ("@",)}, {"digits": 10, "run": 5}, {"digits": 10, "run": 4}, {"words": ("+44",)}, {"digits": 4, "shape": "[0-9][.][0-9]{1,3}[.][0-9]"}, {"words": (":",), "frame": FRAMES["ipv6"]}, {"words": WEB},
    {"digits": 5, "run": 4}, {"words": ("emp", "id-", "staff-", "cve-")}, {"shape": "[A-Z][0-9]{4}[A-Z]"}, {"digits": 9, "run": 4, "shape": "[0-9]-[0-9]{2}-[0-9]"}, {"shape": "[A-Z]0"},
    {"words": tuple(PERSON_LABELS)}, {"words": ("Team", "Project", "Department", "Division")}, {"words": ("mumbai", "delhi", "bengaluru", "chennai", "kolkata", "hyderabad", "pune", "internal", "intranet", "dashboard", "datacenter")},
]
_HEX = {"frame": "[abcdefABCDEF0123456789]{32}"}
IOC_NEEDS: list[dict] = [{"digits": 4, "shape": "[0-9][.][0-9]{1,3}[.][0-9]"}, {"words": (".com", ".org", ".net", ".io", ".gov", ".edu", ".internal", ".intranet", ".local")}, {"words": WEB}, _HEX, _HEX, _HEX, {"words": ("cve-",)}]
NEEDS = ENTITY_NEEDS + IOC_NEEDS
FACTS = "(root cause|timeline|impact|risk|finding|recommendation|follow-up|exposure|credential|incident|vulnerability)"
URGENT = "(critical|high|urgent|immediate|rotate|quarantine|blocked)"


def seen(text: Column, needs: list[dict]) -> Column:
    """What the patterns' tests look at, as a struct: ``Seen`` of their words, and which of their patterns of the text it shows, each looked for once."""
    words = tuple(dict.fromkeys(w for n in needs for w in n.get("words", ())))
    fields = {k: c for k, c in vars(Seen.of(text, words)).items() if k != "blocks"}
    return F.struct(*(c.alias(k) for k, c in fields.items()), *(text.rlike(f).alias(f"frame_{i}") for i, f in enumerate(_frames(needs))))


def _frames(needs: list[dict]) -> list[str]:
    return list(dict.fromkeys(n["frame"] for n in needs if "frame" in n))


def _all_spans(text: Column, patterns: list[str], needs: list[dict], use: Callable[[Column], Column], shown: Column | None = None, of: list[dict] | None = None) -> Column:
    """``use`` of the spans of each pattern; a pattern without what it needs in the text is not tried. shown: ``seen`` as a column, for the needs ``of``, where it is at hand."""
    frames = _frames(of or needs)

    def test(x: Column, n: dict) -> Column:
        out = Seen(x["low"], x["caps"], x["counted"]).test(text, **{k: v for k, v in n.items() if k != "frame"})
        shows = x[f"frame_{frames.index(n['frame'])}"] if "frame" in n else None
        return shows if out is None else out if shows is None else out & shows

    tested = lambda x: spans_of_each(text, [(p, test(x, n)) for p, n in zip(patterns, needs, strict=True)])
    return let(let(seen(text, needs), tested) if shown is None else tested(shown), use)


def _first_of_each(rows: Column, kind: str) -> Column:
    """In order, the first row for each type and value."""
    return F.aggregate(rows, F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda a: (a["type"] == x["type"]) & (a["value"] == x["value"])), acc).otherwise(F.concat(acc, F.array(x))))


def _around(text: Column, start: Column, size: Column, margin: int) -> Column:
    low = F.greatest(F.lit(0), start - margin)
    return strip(F.regexp_replace(F.substring(text, low + 1, start + size + margin - low), java(r"\s+"), " "))


ENTITY = "array<struct<type:string,value:string,start:int,end:int,confidence:double,context:string>>"


def extract_entities(text: Column, most: int = 25, shown: Column | None = None) -> Column:
    """shown: ``seen`` of the text for ``NEEDS``, where it is at hand."""
    def rows(found: Column, type_: str, confidence: float) -> Column:
        def one(x: Column) -> Column:
            value = strip(x["matched"])
            return F.struct(F.lit(type_).alias("type"), value.alias("value"), x["start"].alias("start"), (x["start"] + F.length(value)).alias("end"), F.lit(confidence).alias("confidence"), _around(text, x["start"], F.length(value), 20).alias("context"))

        return F.transform(found, one).cast(ENTITY)

    def plain(found: Column, type_: str, confidence: float, pattern: str = "") -> Column:
        def one(x: Column) -> Column:
            value = F.regexp_extract(x["matched"], java(pattern), 1) if pattern else x["matched"]
            context = F.left(x["matched"], F.lit(80)) if pattern else F.lit(None).cast("string")
            return F.struct(F.lit(type_).alias("type"), value.alias("value"), x["start"].alias("start"), (x["start"] + F.length(value)).alias("end"), F.lit(confidence).alias("confidence"), context.alias("context"))

        return F.transform(found, one).cast(ENTITY)

    n = len(ENTITIES)
    patterns = [p for _, p, _ in ENTITIES] + [PERSON, ORG, LOCATION]

    def of(all_: Column) -> Column:
        at = lambda i: F.get(all_, F.lit(i))
        found = [rows(at(i), type_, confidence) for i, (type_, _, confidence) in enumerate(ENTITIES)]
        found += [plain(at(n), "PERSON", 0.65, PERSON), plain(at(n + 1), "ORG", 0.6), plain(at(n + 2), "LOCATION", 0.55)]
        return F.slice(_first_of_each(F.concat(*found), ENTITY), 1, most)

    return _all_spans(text, patterns, ENTITY_NEEDS, of, shown, NEEDS if shown is not None else None)


IOC = "array<struct<type:string,value:string,start:int,end:int,severity:string,confidence:double,context:string>>"


def extract_iocs(text: Column, most: int = 20, shown: Column | None = None) -> Column:
    """shown: as for ``extract_entities``."""
    def rows(found: Column, type_: str, severity: str, confidence: float) -> Column:
        if type_ == "DOMAIN":  # an address's domain is personal data, not an indicator
            low = lambda x: F.greatest(F.lit(0), x["start"] - 30)
            found = F.filter(found, lambda x: ~F.contains(F.substring(text, low(x) + 1, x["start"] - low(x)), F.lit("@")))
        return F.transform(found, lambda x: F.struct(
            F.lit(type_).alias("type"), x["matched"].alias("value"), x["start"].alias("start"), x["end"].alias("end"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"),
            _around(text, x["start"], x["end"] - x["start"], 15).alias("context"),
        )).cast(IOC)

    def of(all_: Column) -> Column:
        found = [rows(F.get(all_, F.lit(i)), type_, severity, confidence) for i, (type_, _, severity, confidence) in enumerate(IOCS)]
        return F.slice(_first_of_each(F.concat(*found), IOC), 1, most)

    return _all_spans(text, [p for _, p, _, _ in IOCS], IOC_NEEDS, of, shown, NEEDS if shown is not None else None)


def map_ttps(text: Column, most: int = 12) -> Column:
    """array<struct<mitre_id, technique, tactic, severity, keyword, start, end, confidence, evidence>>: the first keyword of each technique that occurs."""
    words = [w for *_, ws in TTPS for w in ws]

    def one(low: Column, held: Column, mitre: str, technique: str, tactic: str, severity: str, words: list[str]) -> Column:
        word = F.lit(None).cast("string")
        for w in reversed(words):
            word = F.when(F.contains(held, F.lit(core(w))) & F.contains(low, F.lit(w)), w).otherwise(word)

        def told(word: Column) -> Column:
            at = F.instr(low, word) - 1
            evidence = F.concat(F.lit('"'), word, F.lit('" → '), _around(text, at, F.length(word), 30))
            return F.when(word.isNotNull(), F.struct(
                F.lit(mitre).alias("mitre_id"), F.lit(technique).alias("technique"), F.lit(tactic).alias("tactic"), F.lit(severity).alias("severity"), word.alias("keyword"), at.alias("start"), (at + F.length(word)).alias("end"),
                F.when(F.length(word) > 10, 0.85).otherwise(0.7).alias("confidence"), evidence.alias("evidence"),
            ))

        return let(word, told)

    def found(low: Column) -> Column:
        # one pass finds the cores of all keywords; most texts have few
        held = F.array_join(F.array_distinct(F.regexp_extract_all(low, F.lit(marks([core(w) for w in words])), F.lit(1))), "\n")
        return let(held, lambda h: F.array(*(one(low, h, *t) for t in TTPS)))

    return F.slice(F.array_compact(let(F.lower(text), found)), 1, most)


def synthesize_risks(text: Column, categories: Column, iocs: Column, ttps: Column) -> Column:
    """array<struct<category, severity, score, n>> by fixed rules. categories: those of the findings, with repeats."""
    count = lambda c: F.size(F.filter(categories, lambda x: x == c))
    row = lambda category, severity, score, n: F.struct(F.lit(category).alias("category"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), (score if isinstance(score, Column) else F.lit(score)).alias("score"), n.alias("n"))
    high = F.size(F.filter(iocs, lambda x: x["severity"] == "HIGH"))
    critical = F.exists(ttps, lambda t: t["severity"] == "CRITICAL")
    low = F.lower(text)
    rows = [
        F.when(count("PII") > 5, row("Data Exposure", "HIGH", 35, count("PII"))).when(count("PII") > 0, row("PII Handling", "MEDIUM", 15, count("PII"))),
        F.when(count("SECRET") > 0, row("Credential Exposure", "CRITICAL", 45, count("SECRET"))),
        F.when(count("PROMPT_INJECTION") > 0, row("Prompt Injection", "CRITICAL", 40, count("PROMPT_INJECTION"))),
        F.when(F.size(iocs) > 0, row("Infrastructure Exposure", F.when(high > 0, "HIGH").otherwise("MEDIUM"), F.lit(20) + high * 5, F.size(iocs))),
        F.when(F.size(ttps) > 0, row("Adversarial Behavior", F.when(critical, "CRITICAL").otherwise("HIGH"), F.lit(25) + F.size(ttps) * 3, F.size(ttps))),
        F.when(F.contains(low, F.lit("root cause")) | F.contains(low, F.lit("postmortem")), row("Operational Learning", "LOW", 5, F.lit(1))),
    ]
    return F.slice(F.array_compact(F.array(*rows)), 1, 6)


def key_findings(text: Column) -> Column:
    """array<struct<finding, score, start, confidence>>: up to five sentences that score 2 or more, else the best one."""
    parts = F.filter(F.transform(F.split(text, java(r"\s(?<=[.!?]\s)\s*")), strip), lambda s: F.length(s) > 20)
    # words that no sentence can have are told by the whole text
    some = lambda low, words: F.filter(F.array(*map(F.lit, words.strip("()").split("|"))), lambda w: F.contains(low, w))
    held = let(F.lower(text), lambda low: F.struct(some(low, FACTS).alias("facts"), some(low, URGENT).alias("urgent")))
    points_of = lambda low, words, n: F.when(F.exists(words, lambda w: F.contains(low, w)), n).otherwise(0.0)

    def scored(h: Column) -> Callable[[Column, Column], Column]:
        def one(s: Column, i: Column) -> Column:
            says = let(F.lower(s), lambda low: points_of(low, h["facts"], 3.0) + points_of(low, h["urgent"], 2.0))
            points = F.when(F.size(h["facts"]) + F.size(h["urgent"]) > 0, says).otherwise(0.0) + F.when((F.length(s) > 60) & (F.length(s) < 220), 1.0).otherwise(0.0) + F.when(i == 0, 0.5).otherwise(0.0)
            return F.struct((-points).alias("order"), i.alias("i"), s.alias("s"))

        return one

    def chosen(ranked: Column) -> Column:
        good = F.slice(F.filter(ranked, lambda x: x["order"] <= -2.0), 1, 5)
        return let(good, lambda g: F.when(F.size(g) > 0, g).otherwise(F.slice(ranked, 1, 1)))

    return F.transform(let(let(held, lambda h: F.array_sort(F.transform(parts, scored(h)))), chosen), lambda x: F.struct(
        F.left(x["s"], F.lit(240)).alias("finding"), (-x["order"]).alias("score"), (F.instr(text, x["s"]) - 1).alias("start"), F.least(F.lit(0.95), F.lit(0.6) - x["order"] * 0.08).alias("confidence"),
    ))


#: Fixed value: what reports are made by.
MODEL = "heuristic-v1"
REPORT = ["entities", "iocs", "ttps", "risks", "key_findings", "evidence", "counts", "summary", "risk_score", "classification", "model"]


def intelligence_report(df: DataFrame, text_col: str = "text", findings_col: str = "findings") -> DataFrame:
    """``df`` with the report's columns (``REPORT``); risk_score and classification are the document's, from its findings where it has none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = risk.risk(F.col(findings_col))
    shown = F.col("_shown")
    df = df.withColumn("_shown", seen(text, NEEDS))
    df = df.withColumns({"entities": extract_entities(text, shown=shown), "iocs": extract_iocs(text, shown=shown), "ttps": map_ttps(text), "key_findings": key_findings(text)}).drop("_shown")
    df = df.withColumn("risks", synthesize_risks(text, F.transform(findings_col, lambda f: f["category"]), F.col("iocs"), F.col("ttps")))
    if "risk_score" not in df.columns or "classification" not in df.columns:
        df = df.withColumn("_own", own).withColumns({"risk_score": F.col("_own.total"), "classification": F.col("_own.classification")}).drop("_own")
    pages = F.greatest(F.lit(1), F.ceil(F.size(F.split(text, "\n", -1)) / 40)).cast("string")
    techniques = F.array_join(F.transform("ttps", lambda t: F.concat(t["mitre_id"], F.lit(" ("), t["technique"], F.lit(")"))), ", ")
    named = F.when(F.size("ttps") > 0, F.concat(F.lit("ATT&CK: "), techniques, F.lit(". "))).otherwise("")
    top = F.when(F.size("risks") > 0, F.concat(F.lit("Top risk: "), F.get("risks", F.lit(0))["category"], F.lit(" ("), F.get("risks", F.lit(0))["severity"], F.lit(")."))).otherwise("No risk stands out.")
    summary = F.concat(
        F.lit("Analyzed "), pieces_count(text).cast("string"), F.lit(" words across "), pages, F.lit(" pages. Detected "), F.size("entities").cast("string"), F.lit(" entities, "),
        F.size("iocs").cast("string"), F.lit(" IOCs, "), F.size("ttps").cast("string"), F.lit(" TTP(s). "), named, top,
    )
    return df.withColumns({
        "summary": summary, "model": F.lit(MODEL), "evidence": F.transform("key_findings", lambda k: F.struct(k["finding"].alias("claim"), k["start"].alias("start"))),
        "counts": F.struct(*(F.size(c).alias(c) for c in ("entities", "iocs", "ttps", "risks", "key_findings"))),
    })


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def ensure_intelligence(documents: DataFrame, reports: DataFrame, force: bool = False) -> DataFrame:
    """The reports (document_id, content_hash, the report's columns) with those of documents that lack one or whose text has changed since; with ``force`` all anew.

    documents: document_id, text, findings. Only what is missing or out of date is computed. Reports of
    documents that are gone stay.
    """
    hashed = documents.withColumn("content_hash", content_hash(F.col("text")))
    todo = hashed if force else hashed.join(reports.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_anti")
    new = intelligence_report(todo).select("document_id", "content_hash", *REPORT)
    kept = reports.join(todo.select("document_id"), "document_id", "left_anti")
    return kept.select(*new.columns).unionByName(new)
