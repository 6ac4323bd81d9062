"""Normalization, statistics and quality of text, as column expressions.

Only Unicode composition runs in Python, on Arrow batches, and only on the stretches of a text that it can change.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from palisade.functions.regex import SPACES, WORD, java
from palisade.functions.spans import let

# Characters that go, what marks a text as worth scanning, printable characters, common words.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
ZERO_WIDTH = "[​-‍﻿­]"
CJK = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
PRINTABLE = r"[\x20-\x7E\x0A\x0D\x09\x{A0}-\x{24F}\x{400}-\x{4FF}\x{900}-\x{97F}\x{600}-\x{6FF}\x{4E00}-\x{9FFF}]"
SECRET_SHAPES = (
    r"AKIA[0-9A-Z]{12,}|ASIA[0-9A-Z]{12,}|ghp_[A-Za-z0-9]{10,}|gho_[A-Za-z0-9]{10,}|github_pat_[A-Za-z0-9_]{10,}|glpat-[A-Za-z0-9_-]{10,}|xox[baprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{10,}"
    r"|sk-[A-Za-z0-9]{14,}|AIza[0-9A-Za-z_-]{35}|BEGIN.*PRIVATE KEY|BEGIN PGP|ssh-(?:rsa|ed25519)|eyJ[A-Za-z0-9_-]{6,}\.eyJ|postgres(?:ql)?:\/\/|mongodb(\+srv)?:\/\/|AccountKey=|Bearer\s+[A-Za-z0-9]"
)
COMMON = r"\b(the|and|or|is|to|of|in|for|with|on|as|by|at|from|this|that|was|are|document|report|incident|security)\b"
DICTIONARY = r"\b(the|and|or|is|to|of|in|for|with|on|as|by|at|from|this|that|was|are|has|have|will|document|report|incident|security|management|policy|data|information|system|user|content|page|section|paragraph)\b"
#: What goes from a text, in one class behind a look that tells printable ASCII characters; the characters of \s.
GONE = rf"[[\x00-\x1F\x7F-\x{{10FFFF}}]&&[�{ZERO_WIDTH[1:-1]}{CONTROL[1:-1]}\x{{10000}}-\x{{10FFFF}}]]+"
BLANKS = "".join(chr(i) for a, b in SPACES for i in range(a, b + 1))
#: What secrets begin with is told before their shapes are tried one after another.
SECRET_LOOK = f"(?=[AgxsBepm])(?=A[KSIc]|g[hil]|xo|s[ks]|B[Ee]|ey|po|mo)(?:{java(SECRET_SHAPES)})"
LABELS = {"PUBLIC_RELEASE": "Public Release", "INTERNAL_SUMMARY": "Internal Summary", "EXECUTIVE_BRIEF": "Executive Brief", "HR_SAFE": "HR Safe", "SECURITY_INCIDENT": "Security Incident"}


@F.arrow_udf(ArrayType(StringType()))
def _composed(parts: pa.Array) -> pa.Array:
    return pa.array([None if ps is None else [unicodedata.normalize("NFC", p) for p in ps] for ps in parts.to_pylist()], pa.list_(pa.string()))


def _unsettled() -> str:
    """A Java pattern of the stretches that composition can change: characters that it changes or joins to others, and near ones, with the one before them. All lie above U+02FF, which one look tells."""
    found = [i for i in range(0x300, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and (unicodedata.combining(c := chr(i)) or not unicodedata.is_normalized("NFC", c) or c in _seconds())]
    ranges: list[list[int]] = []
    for i in found:  # few ranges: a class is looked through one after another
        if ranges and i - ranges[-1][1] <= 512 and not ranges[-1][1] < 0xE000 <= i:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    kind = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    return f"(?s)(?=.?[^\\x00-\\x{{2FF}}])[^{kind}]?[{kind}]+"


@cache
def _seconds() -> frozenset[str]:
    """Characters that join one before them though they are no marks, as Hangul vowels and finals do."""
    found = {d[-1] for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and len(d := unicodedata.normalize("NFD", chr(i))) > 1}
    return frozenset(found | {chr(i) for i in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


UNSETTLED = _unsettled()


def compose(c: Column) -> Column:
    """NFC. Only the stretches that it can change go to Python, so batches hold no whole texts; a text without any is not split either."""
    found = F.when((F.octet_length(c) > F.length(c)) & c.rlike(r"[\x{300}-\x{10FFFF}]") & c.rlike(UNSETTLED), F.regexp_extract_all(c, F.lit(UNSETTLED), F.lit(0)))
    put = lambda by: F.array_join(F.zip_with(F.split(c, UNSETTLED, -1), by, lambda gap, b: F.concat(gap, F.coalesce(b, F.lit("")))), "")
    return F.coalesce(let(_composed(found), lambda by: F.when(by.isNotNull(), put(by))), c)


def clean(c: Column) -> Column:
    """Without replacement, zero-width, control and non-BMP characters; at most one blank line, then no blanks at line ends."""
    # lines are looked through only where there is something to mend
    few = lambda x: F.when(F.contains(x, F.lit("\n\n\n")), F.regexp_replace(x, "\n{3,}", "\n\n")).otherwise(x)
    ends = lambda x: F.contains(x, F.lit(" \n")) | F.contains(x, F.lit("\t\n")) | x.endswith(" ") | x.endswith("\t")
    return let(let(F.regexp_replace(c, GONE, ""), few), lambda x: F.when(ends(x), F.regexp_replace(x, "[ \t]+(?=\n|\\z)", "")).otherwise(x))


def normalize_text(c: Column) -> Column:
    return clean(compose(F.coalesce(c, F.lit(""))))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def blank(c: Column) -> Column:
    """Whether ``strip`` leaves nothing: the first character of another kind ends the search."""
    return ~c.rlike(java(r"\S"))


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, java(r"\s+")), lambda w: w != "")


def word_count(c: Column) -> Column:
    """How many words there are: each becomes one character, so none is kept."""
    return F.length(F.regexp_replace(F.regexp_replace(c, java(r"\S+"), "x"), java(r"\s+"), ""))


def pieces_count(c: Column) -> Column:
    """How many pieces ``split`` at blanks gives: the words and what is empty at the ends."""
    ends = blank(F.left(c, F.lit(1))).cast("int") + blank(F.right(c, F.lit(1))).cast("int")
    return F.when(c == "", 1).otherwise(word_count(c) + ends)


def text_stats(c: Column) -> dict[str, Column]:
    """char_count, word_count, sections (by blank lines, at least 1), pages (of 40 lines, at least 1), sha256, size_bytes."""
    c = F.coalesce(c, F.lit(""))
    lines = F.size(F.split(c, "\n", -1))
    blocks = F.filter(F.split(c, java(r"\n\s*\n")), lambda b: ~blank(b))
    return {
        "char_count": F.length(c), "word_count": word_count(c), "sections": F.greatest(F.lit(1), F.size(blocks)),
        "pages": F.greatest(F.lit(1), F.ceil(lines / 40)).cast("int"), "sha256": F.sha2(c.cast("binary"), 256), "size_bytes": F.octet_length(c),
    }


def _words(choice: str) -> str:
    """A Java pattern of whole words in any case, written as a choice between boundaries: most characters begin none."""
    words = choice.removeprefix(r"\b(").removesuffix(r")\b")
    firsts = "".join(sorted({w[0] for w in words.split("|")}))
    return f"(?i)(?=[{firsts}{firsts.upper()}])(?<!{WORD})(?:{words})(?!{WORD})"


def _share(c: Column, n: Column) -> Column:
    return c.cast("double") / F.greatest(F.lit(1), n)


def _count(c: Column, kind: str) -> Column:
    """How many characters are of a class: what is left without the stretches of all others."""
    return F.length(F.regexp_replace(c, f"[^{kind[1:-1]}]+", ""))


def _measure(c: Column, more: Callable[[Column, Column], dict[str, Column]]) -> Column:
    """A struct of what is counted in a sample, each of it once: n, w, printable, cjk, spaces, average, and ``more`` of the sample and its words."""
    def measured(sample: Column) -> Column:
        def counted(words: Column) -> Column:
            n, w = F.length(sample), F.size(words)
            cjk = F.when(F.octet_length(sample) > n, _share(_count(sample, CJK), n)).otherwise(0.0)
            own = {
                "n": n, "w": w, "printable": _share(n - F.length(F.regexp_replace(sample, f"{PRINTABLE}+", "")), n), "cjk": cjk,
                "spaces": _share(n - F.length(F.replace(sample, F.lit(" "), F.lit(""))), n), "average": F.when(w > 0, n.cast("double") / w).otherwise(0.0),
            }
            return F.struct(*(v.alias(k) for k, v in (own | more(sample, words)).items()))

        return let(words_of(sample), counted)

    return let(c, measured)


def looks_binary(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))

    def judged(m: Column) -> Column:
        n, w, spaces, average = m["n"], m["w"], m["spaces"], m["average"]
        # fixed values: the limits, as in text_quality
        return (
            F.when(m["cjk"] > 0.2, False).when(m["printable"] < 0.72, True)
            .when(w < 4, ((average > 15) & (spaces < 0.05)) | ((n > 60) & (spaces < 0.03)))
            .otherwise(((spaces < 0.06) & (average > 12)) | (spaces < 0.04) | (average > 18) | (~m["common"] & (w > 5) & (spaces < 0.08)))
        )

    sample = _measure(F.left(c, F.lit(4000)), lambda sample, words: {"common": sample.rlike(_words(COMMON))})
    return F.when((F.length(strip(c)) < 20) | c.rlike(SECRET_LOOK), False).otherwise(let(sample, judged))


QUALITY = ("printable_ratio", "space_ratio", "avg_word_len", "word_count", "dictionary_ratio", "score", "is_garbage")


def text_quality(c: Column) -> Column:
    """struct<printable_ratio, space_ratio, avg_word_len, word_count, dictionary_ratio, score, is_garbage>."""
    c = F.coalesce(c, F.lit(""))
    make = lambda *x: F.struct(*(v.alias(k) for k, v in zip(QUALITY, x)))
    d = lambda x: F.lit(float(x))

    def words_too(sample: Column, words: Column) -> dict[str, Column]:
        first = F.least(F.size(words), F.lit(200))
        trimmed = F.filter(F.transform(F.slice(words, 1, 200), lambda x: F.regexp_replace(x, r"^[^0-9A-Za-z_]+|[^0-9A-Za-z_]+\z", "")), lambda x: x != "")
        odd = lambda x: ((F.length(x) > 5) & x.rlike("[^a-zA-Z]") & ~x.rlike("[aeiouAEIOU]")).cast("int") + (F.length(x) > 25).cast("int")
        kinds = let(trimmed, lambda t: F.struct(F.size(F.filter(t, lambda x: x.rlike("^[a-zA-Z]{2,20}\\z"))).alias("plain"), F.aggregate(t, F.lit(0), lambda acc, x: acc + odd(x)).alias("odd")))
        return {"known": _share(F.regexp_count(sample, F.lit(_words(DICTIONARY))), F.size(words)), "kinds": kinds, "first": first}

    def judged(m: Column) -> Column:
        w, printable, spaces, average, known = m["w"], m["printable"], m["spaces"], m["average"], m["known"]
        alpha, garbled = _share(m["kinds"]["plain"], m["first"]), _share(m["kinds"]["odd"], m["first"])
        # fixed values: the limits and weights that results depend on
        garbage = (
            F.when(m["cjk"] > 0.2, printable < 0.5)
            .otherwise(
                (printable < 0.72) | ((spaces < 0.04) & (w > 5)) | ((spaces < 0.06) & (average > 14)) | (average > 20) | (garbled > 0.35)
                | ((alpha < 0.15) & (w > 10) & (known < 0.03)) | ((w < 8) & (average > 12) & (known == 0))
            )
        )
        score = printable * 0.35 + F.least(F.lit(1.0), spaces * 6) * 0.25 + F.least(F.lit(1.0), known * 8) * 0.2 + (1 - F.least(F.lit(1.0), garbled * 2)) * 0.2
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
        return let(garbage, lambda bad: make(printable, spaces, average, w, known, F.when(bad, F.least(score, F.lit(0.35))).otherwise(score), bad))

    return (
        F.when(blank(c), make(d(0), d(0), d(0), F.lit(0), d(0), d(0), F.lit(True)))
        .when(F.left(c, F.lit(4000)).rlike(SECRET_LOOK), make(d(1), d(0.15), d(10), F.lit(10), d(0.1), d(0.8), F.lit(False)))
        .otherwise(let(_measure(F.left(c, F.lit(8000)), words_too), judged))
    )


def is_meaningful(c: Column, quality: Column, min_chars: int = 40) -> Column:
    c = F.coalesce(c, F.lit(""))
    few = (quality["dictionary_ratio"] == 0) & (F.size(words_of(c)) < 4)
    return ~quality["is_garbage"] & (quality["score"] >= 0.42) & (F.length(strip(c)) >= min_chars) & ~few


def safe_truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(n - 1)), F.lit("…")))


def truncate_display(c: Column, n: int = 200_000) -> Column:
    return F.left(normalize_text(c), F.lit(n))


def format_bytes(c: Column) -> Column:
    one = lambda x: F.format_string("%.1f", x)
    return (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024 * 1024, F.concat(one(c / 1024.0), F.lit(" KB"))).otherwise(F.concat(one(c / (1024.0 * 1024.0)), F.lit(" MB")))
    )


def risk_label(c: Column) -> Column:
    return F.when(c >= 70, "Critical").when(c >= 40, "High").when(c >= 15, "Medium").when(c > 0, "Low").otherwise("Safe")


def policy_display_name(c: Column) -> Column:
    out = F.initcap(F.replace(F.lower(c), F.lit("_"), F.lit(" ")))
    for k, v in LABELS.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def safe_log_detail(c: Column, n: int = 180) -> Column:
    return safe_truncate(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1F\x7F]+", " ")), n)


def sanitize_filename(c: Column, longest: int = 120, default: str = "upload") -> Column:
    """The last part of a path without controls and brackets, trimmed and cut."""
    last = F.element_at(F.split(F.coalesce(c, F.lit("")), r"[/\\]"), -1)
    plain = F.left(F.trim(F.regexp_replace(last, r"[\x00-\x1F\x7F\[\]]", "")), F.lit(longest))
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit(default))


def html_visible_text(c: Column) -> Column:
    """Text of a page: what is not shown goes, closing blocks become newlines, other tags spaces; entities are decoded one kind after the other."""
    for pattern, by in (
        (r"(?is)<script.*?</script\s*>", " "), (r"(?is)<style.*?</style\s*>", " "), (r"(?is)<noscript.*?</noscript\s*>", " "), (r"(?s)<!--.*?-->", " "),
        (r"(?i)</(?:p|div|h[1-6]|li|tr|br|section|article)[^>]*>", "\n"), (r"<[^>]+>", " "),
        ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'),
    ):
        c = F.regexp_replace(c, pattern, by)
    return c


def svg_text(c: Column) -> Column:
    """Texts of text and tspan nodes, one a line; without any, the text between tags if it has three words and does not look binary."""
    nodes = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)<(?:text|tspan)[^>]*>([^<]+)</(?:text|tspan)>"), F.lit(1)), strip), lambda x: x != "")
    bare = strip(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), java(r"\s+"), " "))
    return F.when(F.size(nodes) > 0, F.array_join(nodes, "\n")).when((F.size(words_of(bare)) >= 3) & ~looks_binary(bare), bare).otherwise("")


def media_placeholder(name: Column, mime: Column, size: Column) -> Column:
    """What stands in for the content of images, video and sound; null for other kinds."""
    shown, kind = sanitize_filename(name, 80, "file"), F.split_part(mime, F.lit("/"), F.lit(2))
    kilobytes = F.format_string("%.1f KB", size / 1024.0)
    return (
        F.when(mime.startswith("image/"), F.concat(F.lit("[Image: "), shown, F.lit(" — "), F.upper(kind), F.lit(" unknown dimensions, "), kilobytes, F.lit("]")))
        .when(mime.startswith("video/") | mime.startswith("audio/"), F.concat(F.lit("[Video/Audio: "), shown, F.lit(" ("), mime, F.lit(") — "), F.left(mime, F.lit(5)), F.lit(" placeholder]")))
    )


def is_placeholder(c: Column) -> Column:
    return c.startswith("[Image:") | c.startswith("[Video/Audio:")


def quality_warning(c: Column) -> Column:
    """What is wrong with a text that is blank, garbage or scores under 0.3; null for one that stays. Placeholders pass."""
    bad = ~is_placeholder(c) & let(text_quality(c), lambda q: q["is_garbage"] | (q["score"] < 0.3))
    return F.when(blank(c), "No extractable text").when(bad, "Low text quality")


def quality_gate(c: Column, warning: Column | None = None) -> tuple[Column, Column]:
    """(text, warning): a text with a warning becomes empty. warning: ``quality_warning`` as a column, where it is at hand, so that it is computed once."""
    warning = quality_warning(c) if warning is None else warning
    return F.when(warning.isNotNull(), "").otherwise(c), warning
