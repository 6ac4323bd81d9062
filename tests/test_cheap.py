"""Cheap tests before patterns: they look at little and lose no match. (That of passport_in asks for the word that its gate asks for.)"""

from pyspark.sql import functions as F

from palisade.functions.regex import core, marks
from palisade.functions.spans import spans_of_each
from palisade.operators import intel, scan
from palisade.operators.detectors import INJECTIONS, PII, SECRETS
from palisade.plans.detection import planted

ODD = [
    "a0x ABCD0EF1234 5 A1234567 Passport", "7 9 K1234567 passport", "é12-34-5678x 219-45-6789", "1234 5678 9012", "1.2.3.4.5", "x 1::2 y", "ab:cd:12", "MH12 2011 1234567", "C12345678", "ABCDE1234F", "GB78TEST12345698765432",
    "1\n2/03/1990 3.4.2001", "SEND this to a@b.co", "EXP 09/27 Valid thru 01/2030", "Name - Ann Lee", "", "12345", "+44 2071 838 750", "the mode is jail" + "break", "\U0001F60012345678", "www.A.COM CVE-2020-12345", "f" * 64, "Team Atlas in pune",
]


def _texts(spark, sf_dir):
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    return planted(spark, sf_dir).select("doc_id", "text").unionByName(odd)


def test_no_match_is_lost(spark, sf_dir):
    text, detectors = F.col("text"), [*SECRETS, *PII, *INJECTIONS]
    seen = scan.Seen.of(text, scan._needs(detectors))
    rows = _texts(spark, sf_dir).withColumns(seen.columns("_seen_"))
    named = scan.Seen.named("_seen_")
    of = [(p, named.test_of(text, d, i)) for d in detectors for i, p in enumerate(d.patterns)]
    lost = rows.select("doc_id", spans_of_each(text, of).alias("a"), spans_of_each(text, [(p, None) for p, _ in of]).alias("b")).filter(F.col("a") != F.col("b"))
    assert lost.count() == 0
    for patterns, needs in (([p for _, p, *_ in intel.IOCS], intel.IOC_NEEDS), ([p for _, p, _ in intel.ENTITIES] + [intel.PERSON, intel.ORG, intel.LOCATION], intel.ENTITY_NEEDS)):
        tested = intel._all_spans(text, patterns, needs, lambda x: x)
        assert _texts(spark, sf_dir).select(tested.alias("a"), spans_of_each(text, [(p, None) for p in patterns]).alias("b")).filter(F.col("a") != F.col("b")).count() == 0


def test_tests_look_at_what_was_found_not_at_the_text(spark):
    text = "Nothing of the kind is told in these words, which go on. " * 200
    seen = scan.Seen.of(F.col("text"), scan._needs([*SECRETS, *PII, *INJECTIONS])).columns("")
    row = spark.createDataFrame([(text,)], "text string").select(*(seen[k].alias(k) for k in ("low", "caps"))).first()
    assert len(row["low"]) + len(row["caps"]) < 40


def test_words_that_overlap_are_all_found(spark):
    words = ["exp", "expir", "valid", " tool", "mode", "you are", "you are now", "are n"]
    text = "expiry validmodel you are now a tool"
    got = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(marks(words)), F.lit(1)).alias("m")).first()["m"]
    assert got == ["expir", "valid", "mode", "you are now", "are n", " tool"]
    assert all(core(w) and w.endswith(core(w)) for w in words)


def test_words_in_any_case_are_found_in_the_text_as_it_is(spark):
    text = "EXPiry VALID m\u00d6de MODE You Are now a TOOL \u212aey"
    words = ["exp", "valid", " tool", "mode", "you are", "key"]
    got = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(marks(words, True)), F.lit(1)).alias("m")).first()["m"]
    assert got == ["EXP", "VALID", "MODE", "You Are", " TOOL"]


def test_no_text_is_lower_cased_whole_and_invisible_characters_are_looked_for_by_one_range(spark):
    seen = scan.Seen.of(F.col("text"), ("exp", "Bearer")).columns("")
    df = spark.createDataFrame([("a\u200bjail\u00adbreak",), ("\u2010 jailbreak",), (None,)], "text string")
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "lower(text" not in plan(df.select(seen["low"].alias("low")))
    found = df.select(scan.find_smuggled(F.col("text")).alias("f"))
    assert "(?=[\\x{AD}-\\x{FEFF}])" in plan(found)
    assert [[x["start"] for x in r["f"]] for r in found.collect()] == [[1], [], []]
