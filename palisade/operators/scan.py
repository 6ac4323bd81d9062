"""Scanning text for sensitive spans: one narrow projection, no shuffle.

``find`` gives the findings of one detector, ``findings_of`` those of a whole scan with the overlap
rules, ``leaks_of`` those of generated text. All work on array columns inside the document's row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import checks
from palisade.functions.regex import core, java, marks
from palisade.functions.spans import SPAN, Blocks, each, greedy, let, nothing_of, overlap, spans, spans_of_each, sweep
from palisade.operators.detectors import ASSIGNED, ASSIGNED_NEEDS, CONTEXT_WINDOW, FINDING, INJECTIONS, INVISIBLE, PII, SECRET_CONTEXT, SECRETS, SMUGGLED, STOPWORDS, Detector, assigned_value

NO_DIGIT = r"[\x00-/:-\x{10FFFF}]"
#: Which category wins where findings overlap.
PRIORITY = {"SECRET": 5, "PROMPT_INJECTION": 4, "UNSAFE_URL": 3, "INTERNAL_ASSET": 2, "PII": 1}


@dataclass(frozen=True)
class ScanConfig:
    """Families to report and the least confidence. Without ``pii`` its pass still runs and still shadows."""

    pii: bool = True
    secrets: bool = True
    injections: bool = True
    internal_assets: bool = True
    unsafe_urls: bool = True
    min_confidence: float = 0.0

    def wants(self, category: Column) -> Column:
        off = [c for c, on in (("PII", self.pii), ("SECRET", self.secrets), ("PROMPT_INJECTION", self.injections), ("INTERNAL_ASSET", self.internal_assets), ("UNSAFE_URL", self.unsafe_urls)) if not on]
        return ~category.isin(off) if off else F.lit(True)


def _struct(d: Detector, text: Column, x: Column) -> Column:
    matched = F.left(x["matched"], F.lit(d.cut)) if d.cut else x["matched"]
    return F.struct(
        F.lit(d.category).alias("category"), F.lit(d.type).alias("type"), F.lit(d.severity).alias("severity"),
        (d.confidence_of(text, x) if d.confidence_of else F.lit(d.confidence)).cast("double").alias("confidence"), F.lit(d.action).alias("default_action"),
        x["start"].alias("start"), x["end"].alias("end"), matched.alias("matched_text"), (d.mask_of(x["matched"]) if d.mask_of else F.lit(d.mask)).alias("masked_text"), F.lit(d.reason).alias("reason"),
    )


@dataclass(frozen=True)
class Seen:
    """What the cheap tests look at: the cores of words that patterns need, found in one pass over the text, in lower case and with capitals as they are; its numbers with the characters beside them, their digits in all and in the longest run; and the blocks in which contexts are looked up."""

    low: Column
    caps: Column
    counted: Column
    blocks: Column | None = None

    @classmethod
    def of(cls, text: Column, words: tuple[str, ...]) -> Seen:
        """words: those that ``holds`` is asked for later."""
        # a number goes on over one character; of more characters between two only the outer ones are kept, so what goes is taken in one sweep
        numbers = F.regexp_replace(text, f"({NO_DIGIT}){NO_DIGIT}*({NO_DIGIT})", "$1\n$2")
        runs = lambda of: F.regexp_extract_all(of, F.lit("[0-9]+"), F.lit(0))
        counted = let(let(numbers, lambda x: F.struct(x.alias("numbers"), runs(x).alias("runs"))), lambda x: F.struct(
            x["numbers"].alias("numbers"), F.length(F.array_join(x["runs"], "")).alias("digits"), F.coalesce(F.array_max(F.transform(x["runs"], F.length)), F.lit(0)).alias("digit_run")))
        kept = lambda of, any_case: F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(marks(of, any_case)), F.lit(1))), "\n") if of else F.lit("")
        long = [w for w in words if len(w) > 1]
        low, caps = F.lower(kept([core(w) for w in long if w == w.lower()], True)), kept([w for w in long if w != w.lower()], False)
        return cls(low, caps, counted, Blocks.of(text))

    def columns(self, prefix: str) -> dict[str, Column]:
        return {f"{prefix}{k}": c for k, c in vars(self).items()}

    @classmethod
    def named(cls, prefix: str) -> Seen:
        return cls(*(F.col(f"{prefix}{k}") for k in ("low", "caps", "counted", "blocks")))

    def holds(self, text: Column, words: tuple[str, ...]) -> Column | None:
        """False if the text has none of the words; those with capitals as they are. What begins somewhere is part of the longest that was found there."""
        out = None
        for w in words:
            one = F.contains(text, F.lit(w)) if len(w) == 1 else F.contains(self.low, F.lit(core(w))) if w == w.lower() else F.contains(self.caps, F.lit(w))
            out = one if out is None else out | one
        return out

    def test(self, text: Column, words: tuple[str, ...] = (), digits: int = 0, run: int = 0, shape: str = "", frame: str = "") -> Column | None:
        parts = [
            self.counted["digits"] >= digits if digits else None, self.counted["digit_run"] >= run if run > 1 else None, self.holds(text, words),
            self.counted["numbers"].rlike(shape) if shape else None, text.rlike(frame) if frame else None,
        ]
        out = None
        for p in parts:
            if p is not None:
                out = p if out is None else out & p
        return out

    def test_of(self, text: Column, d: Detector, pattern: int) -> Column | None:
        return self.test(text, d.needs[pattern] if d.needs else (), d.digits, d.digit_run, d.shape if isinstance(d.shape, str) else d.shape[pattern], d.frame)


def _needs(detectors: list[Detector]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(w for d in detectors for words in d.needs for w in words))


def find(text: Column, d: Detector, seen: Seen | None = None, found: list[Column] | None = None) -> Column:
    """The detector's findings before overlaps with others are looked at. seen: the cheap tests' columns, where they are at hand; found: the matches of its patterns, likewise."""
    where = Blocks(text, seen.blocks) if seen and seen.blocks is not None else text
    seen = seen or Seen.of(text, _needs([d]))
    found = found or [spans(text, p, seen.test_of(text, d, i)) for i, p in enumerate(d.patterns)]
    out = F.concat(*found) if len(found) > 1 else found[0]
    if d.extra.get("apart"):  # its own patterns shadow each other before any other condition
        out = greedy(out, SPAN)
    if d.inner:
        name = lambda x: F.regexp_extract(x["matched"], java(d.inner), 1)
        out = F.transform(out, lambda x: F.struct((x["end"] - F.length(name(x))).alias("start"), x["end"].alias("end"), name(x).alias("matched")))
    if d.gate:
        out = F.filter(out, lambda x: d.gate(where, x))
    return F.transform(out, lambda x: _struct(d, where, x)).cast(FINDING)


def find_in(df: DataFrame, d: Detector, text_col: str = "text", out: str = "found") -> DataFrame:
    """``df`` with one detector's findings; what the cheap tests look at is computed once a row."""
    seen = Seen.of(F.col(text_col), _needs([d]))
    columns = seen.columns("_seen_")
    return df.withColumns(columns).withColumn(out, find(F.col(text_col), d, Seen.named("_seen_"))).drop(*columns)


def find_assigned(text: Column, seen: Seen | None = None, found: Column | None = None) -> Column:
    """Credentials assigned to a name that says so, by length, entropy and the words around them."""
    near = lambda x, context: F.exists(context, lambda p: F.least(F.abs(p["start"] - x["start"]), F.abs(p["start"] - x["end"])) < CONTEXT_WINDOW)

    def judged(x: Column, context: Column) -> Column:
        value = assigned_value(x["matched"])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["matched"].alias("matched"), value.alias("value"), checks.entropy(value).alias("entropy"), near(x, context).alias("near"))

    seen = seen or Seen.of(text, ASSIGNED_NEEDS)
    with_context = lambda matches: F.when(F.size(matches) > 0, let(spans(text, SECRET_CONTEXT), lambda context: F.transform(matches, lambda x: judged(x, context))))
    rows = F.coalesce(let(spans(text, ASSIGNED, seen.holds(text, ASSIGNED_NEEDS)) if found is None else found, with_context), F.array())
    rows = F.filter(rows, lambda x: ~F.lower(x["value"]).isin(STOPWORDS) & (x["entropy"] >= 2.0) & ((x["entropy"] >= 2.5) | x["near"]))

    def said(x: Column) -> Column:
        confidence = F.least(F.lit(0.97), F.lit(0.5) + F.least(F.lit(0.25), x["entropy"] / 5.0 * 0.25) + F.when(x["near"], 0.25).otherwise(0.1))
        return F.struct(
            F.lit("SECRET").alias("category"), F.lit("PASSWORD").alias("type"), F.lit("HIGH").alias("severity"), confidence.alias("confidence"), F.lit("REDACT").alias("default_action"),
            x["start"].alias("start"), x["end"].alias("end"), x["matched"].alias("matched_text"), F.lit("[SECRET_REDACTED]").alias("masked_text"), F.lit("Credential-like assignment.").alias("reason"),
        )

    return F.transform(rows, said).cast(FINDING)


def find_smuggled(text: Column) -> Column:
    """One finding at the first invisible character of a text that, without such characters, holds a directive."""
    # one range that holds them all is looked at first: a class of several is tried member by member
    chars = f"(?=[\\x{{{ord(min(INVISIBLE)):X}}}-\\x{{{ord(max(INVISIBLE)):X}}}])[{INVISIBLE}]"

    def directive(clean: Column) -> Column:
        says = F.lit(False)
        for words in SMUGGLED:
            says = says | F.contains(clean, F.lit(words))
        return says

    # most texts have no invisible character, many none beyond ASCII
    hidden = (F.octet_length(text) > F.length(text)) & text.rlike(chars)
    says = let(F.lower(F.regexp_replace(text, chars, "")), directive)
    first = F.length(F.split(text, chars, 2)[0])
    one = F.struct(
        F.lit("PROMPT_INJECTION").alias("category"), F.lit("HIDDEN_INSTRUCTION").alias("type"), F.lit("HIGH").alias("severity"), F.lit(0.7).alias("confidence"), F.lit("QUARANTINE").alias("default_action"),
        first.alias("start"), F.least(F.length(text), first + 8).alias("end"), F.lit("[invisible-chars]").alias("matched_text"), F.lit("").alias("masked_text"), F.lit("Invisible characters near a directive.").alias("reason"),
    )
    return F.when(hidden & says, F.array(one)).otherwise(nothing_of(FINDING)).cast(FINDING)


def _smuggled_last(accepted: Column, text: Column) -> Column:
    """Only the first invisible character itself must be free, not the whole span."""
    clear = lambda s: ~F.exists(accepted, lambda a: (s["start"] < a["end"]) & (s["start"] + 1 > a["start"]))
    return F.concat(accepted, F.filter(find_smuggled(text), clear))


@lru_cache(maxsize=32)
def _candidates(application: str, config: ScanConfig, text_col: str) -> tuple[Column, Column, Column, Column, dict[str, Column]]:
    """All matches, of these the passes' candidates (secrets, personal data, injections), what is kept of them, injections with smuggled ones, and what tests look at. Building the expressions takes longer than planning them, so they are kept for the session."""
    text, seen, all_ = F.col(text_col), Seen.named("_seen_"), F.col("_seen_spans")
    pii = [d for d in PII if not (d.switch and not getattr(config, d.switch))]
    passes = [SECRETS if config.secrets else [], pii, INJECTIONS if config.injections else []]
    patterns: list[tuple[str, Column | None]] = [(ASSIGNED, seen.holds(text, ASSIGNED_NEEDS))]
    found: list[list[Column]] = []
    for detectors in passes:
        found.append([])
        for d in detectors:
            at = len(patterns)
            patterns += [(p, seen.test_of(text, d, i)) for i, p in enumerate(d.patterns)]
            found[-1].append(find(text, d, seen, [F.get(all_, F.lit(at + i)) for i in range(len(d.patterns))]))
    if config.secrets:
        found[0].append(find_assigned(text, seen, F.get(all_, F.lit(0))))
    candidates = F.array(*(F.concat(*f) if f else nothing_of(FINDING) for f in found))
    smuggled = _smuggled_last(F.get("_seen_passes", F.lit(2)), text)
    return spans_of_each(text, patterns), candidates, F.transform("_seen_passes", lambda c: greedy(c, FINDING)), smuggled, Seen.of(text, (*ASSIGNED_NEEDS, *_needs([d for ds in passes for d in ds]))).columns("_seen_")


def with_passes(df: DataFrame, config: ScanConfig = ScanConfig(), text_col: str = "text", prefix: str = "_") -> DataFrame:
    """``df`` with the findings of the three passes, each free of overlaps in itself."""
    application = df.sparkSession.sparkContext.applicationId
    matches, cands, apart, smuggled, columns = _candidates(application, replace(config, min_confidence=0.0), "_seen_text")
    df = df.withColumn("_seen_text", F.col(text_col)).withColumns(columns).withColumn("_seen_spans", matches).withColumn("_seen_passes", cands)
    df = df.withColumn("_seen_passes", apart).drop(*columns, "_seen_spans")
    passes = {k: F.get("_seen_passes", F.lit(i)) for i, k in enumerate(("secrets", "pii", "injections"))}
    passes["injections"] = smuggled if config.injections else passes["injections"]
    return df.withColumns({f"{prefix}{k}": c for k, c in passes.items()}).drop("_seen_passes", "_seen_text")


def _rank(f: Column) -> Column:
    out = F.lit(0)
    for category, p in PRIORITY.items():
        out = F.when(f["category"] == category, p).otherwise(out)
    return out


def _beats(f: Column, a: Column) -> Column:
    """Whether f comes strictly before the incumbent a: category, confidence, length."""
    size = lambda x: x["end"] - x["start"]
    same = (_rank(f) == _rank(a)) & (f["confidence"] == a["confidence"])
    return (_rank(f) > _rank(a)) | ((_rank(f) == _rank(a)) & (f["confidence"] > a["confidence"])) | (same & (size(f) > size(a)))


@lru_cache(maxsize=8)
def _resolved(application: str, column: str) -> Column:
    return resolve(F.col(column))


def resolve(findings: Column) -> Column:
    """In order of start (then higher confidence, then as given): a finding that beats the one it overlaps replaces it.

    Those kept so far lie apart and begin no later than the next one, so only the last of them can overlap it.
    """
    numbered = F.transform(findings, lambda f, i: F.struct(f["start"].alias("start"), (-f["confidence"]).alias("order"), i.alias("seq"), f.alias("f")))

    def step(last: Column, x: Column) -> Column:
        f = x["f"]
        apart = F.size(last) == 0
        apart = apart | ~F.exists(last, lambda a: overlap(a, f))
        stays = ~apart & F.exists(last, lambda a: ~_beats(f, a))
        return F.struct(F.when(stays, last).otherwise(F.array(f)).alias("state"), F.when(apart, last).otherwise(nothing_of(FINDING)).alias("out"))

    return sweep(F.array_sort(numbered), nothing_of(FINDING), step, FINDING, lambda last: last)


def scan_array(df: DataFrame, config: ScanConfig = ScanConfig(), text_col: str = "text", out: str = "findings") -> DataFrame:
    """``df`` with its findings in an array column, in order of start. A null text has none."""
    df = with_passes(df, config, text_col, "_scan_")
    merged = F.concat(*(F.col(f"_scan_{k}") for k in ("secrets", "pii", "injections")))
    merged = F.filter(merged, lambda f: config.wants(f["category"]) & (f["confidence"] >= config.min_confidence))
    df = df.withColumn("_scan_all", F.coalesce(merged, nothing_of(FINDING)))
    return df.withColumn(out, _resolved(df.sparkSession.sparkContext.applicationId, "_scan_all")).drop("_scan_all", "_scan_secrets", "_scan_pii", "_scan_injections")


def scan(df: DataFrame, config: ScanConfig = ScanConfig(), id_col: str = "document_id", text_col: str = "text", stage: str = "INPUT") -> DataFrame:
    """One row per finding."""
    rows = scan_array(df.select(id_col, text_col), config, text_col)
    return each(rows, F.col("findings"), "f", id_col).select(id_col, "f.*", F.lit(stage).alias("stage"))


def leaks_array(df: DataFrame, text_col: str = "text", out: str = "leaks") -> DataFrame:
    """All passes over generated text, personal data first, without resolving overlaps between passes."""
    df = with_passes(df, ScanConfig(), text_col, "_leak_")
    merged = F.concat(*(F.col(f"_leak_{k}") for k in ("pii", "secrets", "injections")))
    return df.withColumn(out, F.coalesce(merged, nothing_of(FINDING))).drop("_leak_pii", "_leak_secrets", "_leak_injections")
