"""Generated text is untrusted: filtering markup, rescanning for leaks, repair, grounding of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.regex import java
from palisade.functions.spans import FEW, let, replace_spans, spans
from palisade.functions.text import strip
from palisade.operators import risk, scan

# What is filtered.
UNSAFE_TAG = r"(?i)<(script|iframe|object|embed|form|meta|link|style|svg|math)[\s>]"
UNSAFE_CLOSE = r"(?i)</(script|iframe|object|embed|form|svg|math|style)>"
SCRIPT_LINK = r"(?i)\[([^\]]+)\]\(javascript:[^)]+\)"
DATA_LINK = r"(?i)\[([^\]]+)\]\(data:[^)]+\)"
WEB_LINK = r"(?i)\[([^\]]+)\]\((https?:\/\/[^\s)]+)\)"
EVENT = r"""(?i)\son\w+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
DANGEROUS = r"""(?i)\s(?:href|src|xlink:href|srcdoc|action|formaction)\s*=\s*(?:"\s*(?:javascript|data|vbscript|file|blob):[^"]*"|'\s*(?:javascript|data|vbscript|file|blob):[^']*'|(?:javascript|data|vbscript|file|blob):[^\s>]*)"""
COMMENT = r"(?s)<!--.*?-->"
HIDDEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200D}\x{FEFF}\x{FFFD}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{AD}]"
INTERNAL = r"(?i)^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|127\.|0\.0\.0\.0|localhost$|::1$|internal\.|intranet\.)"
REDIRECTS = ["url", "next", "redirect", "target", "dest", "destination", "u"]
ROLES = ["system", "assistant", "user"]


def is_internal_host(host: Column) -> Column:
    """Private and loopback addresses, internal names, hexadecimal and all-number hosts."""
    host = F.lower(host)
    numbers = F.replace(host, F.lit("."), F.lit("")).rlike("^[0-9]+$") & F.contains(host, F.lit("."))
    return host.rlike(INTERNAL) | host.rlike("^0x[0-9a-f]+$") | numbers | host.startswith("::ffff:")


def _leads_inside(url: Column) -> Column:
    """Whether a link, or the one that it redirects to, goes to an internal host."""
    inner = F.lit(None).cast("string")
    for key in reversed(REDIRECTS):
        value = F.try_url_decode(F.regexp_extract(url, f"[?&]{key}=([^&#]*)", 1))
        inner = F.when(value.rlike("(?i)^https?://"), value).otherwise(inner)
    target = F.coalesce(inner, url)
    target = F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), target)
    host = F.regexp_replace(F.regexp_extract(target, r"(?i)^(?:https?://)?([^/:?\s#]+)", 1), r"^\[|\]$", "")
    return is_internal_host(host) | target.rlike(INTERNAL)


def sanitize_output_html(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with sanitized (string) and removed (array<struct<type, count>>, in order of the steps)."""
    counts: list[tuple[str, str]] = []
    df = df.withColumn("_o", F.coalesce(F.col(text_col), F.lit("")))

    def has(*marks: str) -> Column:
        """What a pattern cannot do without: a look at one word is cheaper than a pattern."""
        out = F.lit(True)
        for m in marks:
            out = out & F.contains("_o", F.lit(m))
        return out

    def count(name: str, pattern: str, *marks: str) -> None:
        nonlocal df
        df = df.withColumn(f"_n_{name}", F.when(has(*marks), F.regexp_count("_o", F.lit(pattern))).otherwise(0))
        counts.append((name, f"_n_{name}"))

    def put(test: Column, *steps: tuple[str, str]) -> None:
        nonlocal df
        c = F.col("_o")
        for pattern, by in steps:
            c = F.regexp_replace(c, pattern, by)
        df = df.withColumn("_o", F.when(test, c).otherwise(F.col("_o")))

    def replace(name: str, pattern: str, by: str, *marks: str) -> None:
        count(name, pattern, *marks)
        put(F.col(f"_n_{name}") > 0, (pattern, by))

    count("unsafe_html_tag", java(UNSAFE_TAG), "<")
    # closing tags are escaped only where an opening one was found
    escaped = F.regexp_replace(F.regexp_replace(F.col("_o"), java(UNSAFE_TAG), "&lt;$1&gt;"), UNSAFE_CLOSE, "&lt;/$1&gt;")
    df = df.withColumn("_o", F.when(F.col("_n_unsafe_html_tag") > 0, escaped).otherwise(F.col("_o")))
    replace("javascript_url", SCRIPT_LINK, "[$1](#blocked)", "](")
    link = lambda i: lambda x: F.regexp_extract(x["matched"], java(WEB_LINK), i)
    df = df.withColumn("_links", F.filter(spans(F.col("_o"), WEB_LINK, has("](", "://")), lambda x: _leads_inside(strip(link(2)(x)))))
    pieces = F.transform(F.reverse("_links"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit("["), link(1)(x), F.lit("](#internal-url-redacted)")).alias("by")))
    df = df.withColumn("_o", F.when(F.size("_links") > 0, replace_spans(F.col("_o"), pieces)).otherwise(F.col("_o"))).withColumn("_n_links", F.size("_links"))
    replace("event_handler_attr", java(EVENT), "", "=")
    replace("dangerous_url_attr", java(DANGEROUS), "", "=", ":")
    replace("data_url", DATA_LINK, "[$1](#blocked)", "](")
    counts.append(("internal_url_in_output", "_n_links"))
    put(has(":"), *((java(rf"(?im)^\s*{r}\s*:"), f"{r.capitalize()} (as data):") for r in ROLES))
    replace("html_comment", COMMENT, "", "<!--")
    # each of them is one character, so how many went is told by the lengths
    df = df.withColumn("_shown", F.regexp_replace("_o", rf"[[\x00-\x1F\x7F-\x{{10FFFF}}]&&{HIDDEN}]+", ""))
    df = df.withColumn("_n_control_chars", F.length("_o") - F.length("_shown")).withColumn("_o", F.col("_shown"))
    counts.append(("control_chars", "_n_control_chars"))
    removed = F.filter(F.array(*(F.struct(F.lit(n).alias("type"), F.col(c).alias("count")) for n, c in counts)), lambda x: x["count"] > 0)
    return df.withColumn("sanitized", F.col("_o")).withColumn("removed", removed).drop("_o", "_shown", "_links", *(c for _, c in counts))


def output_dlp(df: DataFrame, text_col: str = "text", block: Column | None = None) -> DataFrame:
    """``df`` with leaks, passed, reasons and repaired. block: array of types and categories whose leak refuses release.

    Spans that overlap are all put in, from the last start to the first, on the text as it then is.
    """
    df = scan.leaks_array(df, text_col, "leaks")
    n = F.size("leaks")
    first = F.transform(F.slice("leaks", 1, 5), lambda f: F.concat(f["type"], F.lit(" @ offset "), f["start"].cast("string"), F.lit(": "), f["reason"]))
    refused = F.exists("leaks", lambda f: F.array_contains(block, f["type"]) | F.array_contains(block, f["category"])) if block is not None else F.lit(False)
    head = F.array(F.concat(F.lit("Detected "), n.cast("string"), F.when(n == 1, F.lit(" leakage candidate.")).otherwise(" leakage candidates.")))
    tail = F.when(refused, F.array(F.lit("A blocked entity leaked: release refused."))).otherwise(F.array().cast("array<string>"))
    numbered = F.transform("leaks", lambda f, i: F.struct(f["start"].alias("start"), f["end"].alias("end"), F.when(f["masked_text"] != "", f["masked_text"]).otherwise("[REDACTED]").alias("by"), i.alias("i")))
    back = F.array_sort(numbered, lambda a, b: F.when(a["start"] != b["start"], b["start"] - a["start"]).otherwise(a["i"] - b["i"]))
    return df.withColumns({
        "passed": n == 0,
        "reasons": F.when(n == 0, F.array(F.lit("No sensitive material found."))).otherwise(F.concat(head, first, tail)),
        "repaired": replace_spans(F.col(text_col), back),
    })


def split_claims(c: Column, most: int = 40) -> Column:
    """Sentences of at least ten characters, line by line, without list marks; the first ``most``."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n+"), lambda x: strip(F.regexp_replace(x, java(r"^[-*•\d.)\s]+"), "")))
    found = lambda x: F.regexp_extract_all(x, F.lit(r"[^.!?]{10,}[.!?]|[^.!?]{10,}\z"), F.lit(0))
    sentences = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(let(found(x), lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(x))))
    claims = F.filter(F.transform(F.flatten(F.transform(lines, sentences)), strip), lambda x: F.length(x) >= 10)
    return F.slice(claims, 1, most)


def ground_claims(claims: Column, source: Column) -> Column:
    """array<struct<claim, evidence, grounded>>: a run of words of the claim, or half its long words, must be in the source.

    What the source's words can answer is looked up for all claims at once; the source itself is searched only for runs that this leaves.
    """
    def keys(words: Column) -> Column:
        """For each three words on end the second, the last four letters of the first and the first four of the third: a source that has a run of words, all of four letters or more, has the keys of its words too."""
        return let(words, lambda ws: F.transform(ws, lambda a, i: F.concat(F.substring(a, -4, 4), F.lit(" "), F.get(ws, i + 1), F.lit(" "), F.substring(F.get(ws, i + 2), 1, 4))))

    def prepared(claim: Column) -> Column:
        plain = lambda lows: F.filter(F.split(F.regexp_replace(F.array_join(lows, " "), r"[\x00-\x1F!-/:-`\x{7B}-\x{10FFFF}]+", ""), " "), lambda w: F.length(w) > 4)
        return let(F.transform(words_of(claim), F.lower), lambda lows: F.struct(claim.alias("claim"), keys(lows).alias("keys"), plain(lows).alias("long")))

    def one(c: Column, of: Column) -> Column:
        def first(k: int, can: Column, words: Column) -> Column:
            """The first run of k words that the source has; three words have more characters than a run must."""
            run = lambda i: F.slice(words, i + 1, F.lit(k))
            begins = F.filter(can, lambda i: F.forall(F.sequence(i, i + (k - 3)), lambda j: F.array_contains(can, j))) if k > 3 else can
            found = lambda i: F.contains(of["low"], F.array_join(F.transform(run(i), F.lower), " "))
            at = F.aggregate(begins, F.lit(-1), lambda at, i: F.when(at >= 0, at).when(found(i), i).otherwise(-1))
            return let(at, lambda i: F.when(i >= 0, F.concat(F.lit('source contains: "'), F.array_join(run(i), " "), F.lit('"'))))

        def by_words() -> Column:
            hits = F.struct(F.size(F.filter(c["long"], lambda w: F.array_contains(of["held"], w))).alias("hit"), F.size(c["long"]).alias("all"))
            enough = lambda x: (x["all"] >= 3) & (x["hit"] >= F.greatest(F.lit(3), F.ceil(x["all"] / 2).cast("int")))
            return let(hits, lambda x: F.when(enough(x), F.concat(F.lit("keyword overlap: "), x["hit"].cast("string"), F.lit("/"), x["all"].cast("string"))))

        # the keys of the last two words are null
        begins = F.when((F.size(of["keys"]) > 0) & (F.size(c["keys"]) > 2), F.filter(F.sequence(F.lit(0), F.size(c["keys"]) - 3), lambda i: F.array_contains(of["keys"], F.get(c["keys"], i))))
        runs = let(begins, lambda can: F.when(F.size(can) > 0, let(words_of(c["claim"]), lambda words: F.coalesce(first(5, can, words), first(3, can, words)))))
        evidence = F.when(F.lower(c["claim"]).contains("[unsupported]"), "none").otherwise(F.coalesce(runs, by_words(), F.lit("none")))
        return let(evidence, lambda e: F.struct(F.left(c["claim"], F.lit(280)).alias("claim"), e.alias("evidence"), (e != "none").alias("grounded")))

    words_of = lambda claim: F.coalesce(F.filter(F.split(claim, java(r"\s+")), lambda w: F.length(w) > 3), F.array().cast("array<string>"))
    long_of = lambda cs: F.array_distinct(F.flatten(F.transform(cs, lambda c: c["long"])))
    stems = lambda low: F.array_distinct(F.split(low, r"[\x00-/:-`\x{7B}-\x{10FFFF}]+", -1))

    def held(words: Column, of: Column) -> Column:
        """The words that the source has, as words or within longer ones."""
        longer = F.array_join(F.filter(of, lambda s: F.length(s) > 5), " ")
        within = lambda text: F.filter(F.array_except(words, of), lambda w: F.contains(text, w))
        return F.concat(F.array_intersect(words, of), let(longer, within))

    def answered(cs: Column, low: Column) -> Column:
        # the source is taken apart only for many words; a few are looked for in it one by one
        few = lambda of: F.size(of) <= FEW
        known = let(F.array_compact(F.flatten(F.transform(cs, lambda c: c["keys"]))), lambda ks: F.when(few(ks), ks).otherwise(F.array_intersect(ks, F.array_compact(keys(F.split(low, " ", -1))))))
        words = let(long_of(cs), lambda ws: F.when(few(ws), F.filter(ws, lambda w: F.contains(low, w))).otherwise(let(stems(low), lambda of: held(ws, of))))
        return let(F.struct(low.alias("low"), known.alias("keys"), words.alias("held")), lambda of: F.transform(cs, lambda c: one(c, of)))

    return let(F.struct(F.transform(claims, prepared).alias("claims"), F.lower(F.coalesce(source, F.lit(""))).alias("low")), lambda x: answered(x["claims"], x["low"]))


def grounding_status(citations: Column) -> Column:
    return F.when(F.size(citations) == 0, "SKIPPED").when(F.forall(citations, lambda c: c["grounded"]), "PASS").otherwise("FAIL")


def policy_status(passed: Column, grounding: Column) -> Column:
    return F.when(passed & (grounding != "FAIL"), "PASS").otherwise("FAIL")


def validate_outputs(df: DataFrame, output_col: str = "output", source_col: str = "source", before_col: str = "risk_before", block: Column | None = None) -> DataFrame:
    """``df`` with final_output, citations, output_dlp, grounding, policy_status, leakage_count, risk_delta: filter, rescan, repair, filter again."""
    df = df.withColumn("citations", ground_claims(split_claims(F.col(output_col)), F.col(source_col)))
    df = sanitize_output_html(df, output_col).withColumnRenamed("sanitized", "_first").drop("removed")
    df = output_dlp(df, "_first", block)
    df = sanitize_output_html(df, "repaired").withColumnRenamed("sanitized", "final_output").drop("removed")
    # an output without a leak that the second filter leaves as it is has been scanned
    df = df.withColumn("_again", F.when(~(F.col("passed") & (F.col("final_output") == F.col("_first"))), F.col("final_output")))
    df = scan.scan_array(df, text_col="_again", out="_final").drop("_again")
    df = df.withColumn("grounding", grounding_status(F.col("citations")))
    return df.withColumns({
        "output_dlp": F.when(F.col("passed"), "PASS").otherwise("FAIL"), "policy_status": policy_status(F.col("passed"), F.col("grounding")),
        "leakage_count": F.size("leaks"), "risk_delta": F.col(before_col) - risk.risk(F.col("_final"))["total"],
    }).drop("_first", "_final", "passed", "reasons", "repaired", "leaks")


def truncate_for_context(c: Column, most: int = 120_000) -> Column:
    notice = F.concat(F.lit("\n\n[NOTICE: the content has "), F.length(c).cast("string"), F.lit(f" characters; the first {most} follow the context limit.]"))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(most)), notice))


def build_prompts(df: DataFrame, requests: DataFrame, instructions: DataFrame, rules: str, most: int = 120_000) -> DataFrame:
    """A prompt per document and request. requests: document_id, output_type, profile, tone, language, detail, objective, style.

    instructions: (kind, name, text) for each output_type, profile and parameter; a small table of configuration.
    """
    rows = df.select("document_id", "title", truncate_for_context(F.col("sanitized_content"), most).alias("_content")).join(requests, "document_id")
    parts = ["profile", "output_type", "tone", "language", "detail", "objective", "style"]
    for kind in parts:
        said = instructions.filter(F.col("kind") == kind).select(F.col("name").alias(kind), F.col("text").alias(f"_{kind}"))
        rows = rows.join(F.broadcast(said), kind, "left")
    lines = [F.concat(F.lit("- "), F.coalesce(F.col(f"_{k}"), F.lit(""))) for k in parts[2:]]
    prompt = F.concat_ws(
        "\n", F.lit(rules), F.concat(F.lit("Profile: "), "profile"), F.coalesce("_profile", F.lit("")), F.concat(F.lit("Format: "), "output_type"), F.coalesce("_output_type", F.lit("")),
        F.lit("Parameters:"), *lines, F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))), F.lit("<UNTRUSTED_DOCUMENT>"), F.col("_content"), F.lit("</UNTRUSTED_DOCUMENT>"),
    )
    return rows.select("document_id", "output_type", "profile", prompt.alias("prompt"))


OUTPUT_TYPES = ["EXECUTIVE_SUMMARY", "FAQ", "TECHNICAL_REPORT", "SLIDE_OUTLINE", "EMAIL_DRAFT", "PRESS_RELEASE", "SOCIAL_POST", "NEWSLETTER", "POLICY_BRIEF", "TRAINING_GUIDE", "INCIDENT_SUMMARY", "RESEARCH_DIGEST", "ANNOUNCEMENT", "BLOG_POST", "MEETING_MINUTES"]
#: Characters of the excerpt that each format shows.
SHOWN = {"EXECUTIVE_SUMMARY": 280, "FAQ": 160, "TECHNICAL_REPORT": 180, "SLIDE_OUTLINE": 100, "EMAIL_DRAFT": 240, "PRESS_RELEASE": 320, "SOCIAL_POST": 180}


def offline_artefacts(df: DataFrame, output_types: list[str] = OUTPUT_TYPES, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """document_id, kept columns, output_type, output, error: a fixed text around an excerpt that is scanned again and masked. A type that is not known has an error instead.

    ``df``: document_id, title, profile, sanitized_content.
    """
    raw = strip(F.regexp_replace(F.left("sanitized_content", F.lit(600)), java(r"\s+"), " "))
    rows = scan.scan_array(df.withColumn("_raw", raw), text_col="_raw", out="_found")
    back = F.transform(F.reverse("_found"), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), F.when(f["masked_text"] != "", f["masked_text"]).otherwise("[REDACTED]").alias("by")))
    rows = rows.withColumn("_excerpt", replace_spans(F.col("_raw"), back))
    noted = F.lit(False)
    for mark in ("[INJECTION", "[ROLE", "[HIDDEN", "[TOOL"):
        noted = noted | F.contains("sanitized_content", F.lit(mark))
    note = F.when(noted, "Note: instruction-like content was quarantined and treated as data.")
    rows = rows.withColumn("_note", note).withColumn("output_type", F.explode(F.array(*map(F.lit, output_types))))
    size = F.lit(420)
    for k, n in SHOWN.items():
        size = F.when(F.col("output_type") == k, n).otherwise(size)
    head = F.concat(F.initcap(F.replace(F.lower("output_type"), F.lit("_"), F.lit(" "))), F.lit(" — "), F.coalesce("title", F.lit("")), F.lit(" ["), "profile", F.lit("]"))
    known = F.col("output_type").isin(OUTPUT_TYPES)
    output = F.when(known, F.concat_ws("\n\n", head, F.concat(F.left("_excerpt", size), F.lit("...")), "_note"))
    return rows.select("document_id", *keep, "output_type", output.alias("output"), F.when(~known, F.concat(F.lit("unknown output type "), "output_type")).alias("error"))
