"""Steps whose time or memory grew faster than their input: the same results as a plain rule, and long inputs in a short time."""

import math
import random
import re
import time
import unicodedata

from pyspark.sql import functions as F

from palisade.functions import text
from palisade.operators import outputs


def _grounded(claim, low):
    """The rule, word by word."""
    if "[unsupported]" in claim.lower():
        return "none"
    words = [w for w in claim.split() if len(w) > 3]
    for k, least in ((5, 0), (3, 12)):
        for i in range(len(words) - k + 1):
            run = " ".join(words[i : i + k])
            if len(run) >= least and run.lower() in low:
                return f'source contains: "{run}"'
    long = [x for x in (re.sub("[^a-z0-9]", "", w.lower()) for w in words) if len(x) > 4]
    hit = sum(x in low for x in long)
    return f"keyword overlap: {hit}/{len(long)}" if len(long) >= 3 and hit >= max(3, math.ceil(len(long) / 2)) else "none"


def test_grounding_follows_the_rule_on_odd_claims(spark):
    pick = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "(delta)", "omega", "word", "longer-word", "Ärger", "tail", "x", "of"]
    rows = [(i, [" ".join(pick.choices(words, k=pick.randint(1, 9))) for _ in range(6)], " ".join(pick.choices(words, k=40)).replace("omega ", pick.choice(["omega ", "omega\n", "omega  ", "omegas "]))) for i in range(60)]
    rows.append((60, ["nothing [unsupported] alpha"], "nothing [unsupported] alpha"))
    rows.append((61, ["eone two2 three3 four4 fives"], "someone eone two2 three3 four4 fivesome"))
    df = spark.createDataFrame(rows, "i int, claims array<string>, source string")
    for r in df.select("*", outputs.ground_claims(F.col("claims"), F.col("source")).alias("c")).collect():
        assert [c["evidence"] for c in r["c"]] == [_grounded(x, r["source"].lower()) for x in r["claims"]], r["source"]
        assert all(c["grounded"] == (c["evidence"] != "none") for c in r["c"])


def test_claims_against_a_long_source_take_no_look_at_all_of_it_for_each_word(spark):
    source = " ".join(f"word{i % 997} other{i % 991}" for i in range(50_000))
    claims = [" ".join(f"claim{j}of{i}" for i in range(150)) for j in range(40)]
    df = spark.createDataFrame([(claims, source)], "claims array<string>, source string").cache()
    df.count()
    began = time.time()
    got = df.select(F.size(F.filter(outputs.ground_claims(F.col("claims"), F.col("source")), lambda c: c["grounded"])).alias("n")).first()["n"]
    assert got == 0 and time.time() - began < 15


def test_composition_takes_stretches_and_gives_the_same(spark):
    pick = random.Random(7)
    kinds = [*"ab eé\n", "é", "́", "̣", "Å", "ᄀ", "ᅡ", "ᆨ", "가", "क़", "̈́", "\U0001d15e", "\U0001F600", "ে", "া", "一", "豈", "ཱི", "\U00011099\U000110ba"]
    texts = ["".join(pick.choices(kinds, k=pick.randint(0, 30))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", text.compose(F.col("t")).alias("c")).collect():
        assert r["c"] == (None if r["t"] is None else unicodedata.normalize("NFC", r["t"])), r["t"]


def test_composition_sends_no_whole_text_to_python(spark):
    # a stretch for each composed letter, none of the letters between
    row = spark.createDataFrame([("long words " * 9000 + "é end 一é",)], "t string").select(F.regexp_extract_all("t", F.lit(text.UNSETTLED), F.lit(0)).alias("m")).first()
    assert row["m"] == ["é"]


def test_a_gated_text_is_measured_once(spark, sf_dir):
    from palisade.plans import texts

    plan = texts.gate(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("github_pat") == 1


def test_blank_texts_and_whole_words(spark):
    rows = [("", True), (" \n\t　﻿", True), (" x ", False), ("a" * 5000, False), (None, None)]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(text.blank(F.col("t")).alias("b")).collect()
    assert [r["b"] for r in got] == [b for _, b in rows]
    said = spark.createDataFrame([("The thesis; éand AND or_ is-it this_ content",)], "t string").select(F.regexp_count("t", F.lit(text._words(text.DICTIONARY))).alias("new"), F.regexp_count("t", F.lit("(?i)" + text.java(text.DICTIONARY))).alias("old")).first()
    assert said["new"] == said["old"] == 5


def test_long_words_are_not_read_again_from_each_of_their_characters(spark):
    from palisade.functions.regex import java
    from palisade.operators.detectors import ALL

    odd = ["a@b.com-x@y.com", "a@b.co_c@d.example.org..e@f.gh", "@@x@y.zz", "n@ybl-m@upi.k@paytm", "a.b@c", "éa@b.com"]
    df = spark.createDataFrame([(t,) for t in [*odd, "w" * 20_000 + " a@b.com"]], "t string").cache()
    df.count()
    for name in ("email", "upi"):
        p = ALL[name].patterns[0]
        began = time.time()
        got = [r["m"] for r in df.select(F.regexp_extract_all("t", F.lit(java(p)), F.lit(0)).alias("m")).collect()]
        assert got[:-1] == [re.findall(p, t, re.ASCII) for t in odd]
        assert java(p).startswith("(?:(?<!") and time.time() - began < 10


def test_policies_that_leave_the_same_text_have_it_scanned_once(spark, sf_dir, monkeypatch):
    from palisade.operators import sanitize, scan
    from palisade.plans.detection import planted

    names = ["PUBLIC_RELEASE", "HR_SAFE", "SECURITY_INCIDENT", "UNKNOWN"]
    whole, texts = scan.scan_array, []
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a@mail.test"), (-4, "a@mail.test"), (-4, "plain words")], "doc_id long, text string")
    docs = whole(planted(spark, sf_dir).select("doc_id", "text").limit(60).unionByName(odd)).withColumnRenamed("doc_id", "document_id").localCheckpoint()
    monkeypatch.setattr(scan, "scan_array", lambda df, *a, **k: texts.append(df) or whole(df, *a, **k))
    got = sanitize.policy_compare(docs, names)
    plain = None
    for name in names[:3]:
        rows = sanitize.sanitize(sanitize.with_policy(docs, name)).withColumn("risk_before", sanitize.risk.risk(F.col("findings"))["total"])
        preview = F.when(F.col("blocked"), "— BLOCKED —").otherwise(F.left("sanitized_content", F.lit(400)))
        rows = sanitize.residual_risk(rows).select("document_id", F.lit(name).alias("profile"), preview.alias("preview"), F.size("actions").alias("n_actions"), "risk_before", "risk_after", "blocked")
        plain = rows if plain is None else plain.unionByName(rows)
    assert got.columns == plain.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    assert texts[0].count() < 2 * docs.count()


def _scanned(monkeypatch):
    """The frames that are scanned from now on, each with its column of text."""
    from palisade.operators import scan

    whole, seen = scan.scan_array, []
    monkeypatch.setattr(scan, "scan_array", lambda df, *a, text_col="text", **k: seen.append(df.select(F.col(text_col).alias("t"))) or whole(df, *a, text_col=text_col, **k))
    return seen


def test_an_output_without_leaks_is_scanned_once(spark, monkeypatch):
    seen = _scanned(monkeypatch)
    rows = [("All is quiet in the garden.", "quiet"), ("Write to nora.weiss@mail.test today", "x"), ("ok <script>x</script>", "x"), (None, None)]
    out = outputs.validate_outputs(spark.createDataFrame([(*r, 50) for r in rows], "output string, source string, risk_before int")).select("output_dlp", "leakage_count", "risk_delta", "final_output").collect()
    assert [tuple(r)[:3] for r in out] == [("PASS", 0, 50), ("FAIL", 1, 50), ("PASS", 0, 50), ("PASS", 0, 50)]
    assert [r["t"] for r in seen[0].collect() if r["t"] is not None] == [out[1]["final_output"]]


def test_a_blocked_document_is_not_scanned_again(spark, monkeypatch):
    from palisade.operators import sanitize

    seen = _scanned(monkeypatch)
    docs = spark.createDataFrame([("a@mail.test", True, 9), ("plain words", False, 9)], "sanitized_content string, blocked boolean, risk_before int")
    assert [r["risk_after"] for r in sanitize.residual_risk(docs).collect()] == [9, 0]
    assert [r["t"] for r in seen[0].collect()] == [None, "plain words"]


def test_grounding_follows_the_rule_for_many_claims_and_few(spark):
    pick = random.Random(11)
    words = [f"{a}{b}{c}" for a in ("", "pre", "(") for b in ("alpha", "beta", "gammas", "deltas", "omegas", "word", "tail", "x") for c in ("", "s", ",", ")", "ly")]
    of = lambda n: " ".join(pick.choices(words, k=n))
    rows = []
    for i in range(40):
        source = of(60)
        told = source.split(" ")
        claims = [" ".join(told[j : j + 7]) if pick.random() < 0.3 else of(pick.randint(1, 9)) for j in range(pick.choice([1, 2, 25]))]
        rows.append((i, claims, source.upper() if i % 5 == 0 else source))
    df = spark.createDataFrame(rows, "i int, claims array<string>, source string")
    for r in df.select("*", outputs.ground_claims(F.col("claims"), F.col("source")).alias("c")).collect():
        assert [c["evidence"] for c in r["c"]] == [_grounded(x, r["source"].lower()) for x in r["claims"]], r["source"]


def test_a_report_looks_for_words_and_numbers_once(spark, monkeypatch):
    from palisade.operators import intel

    whole, calls = intel.Seen.of, []
    monkeypatch.setattr(intel.Seen, "of", classmethod(lambda cls, t, words: calls.append(words) or whole(t, words)))
    text_ = "Root cause: the host 10.2.3.4 sent " + "ab" * 16 + " to www.a.com. Write to nora.weiss@mail.test about CVE-2020-12345, Analyst: Ines Okoro. " + "Nothing else is told in this sentence. " * 3
    df = spark.createDataFrame([(text_,), ("",), (" ",), (None,)], "text string").withColumn("findings", F.array().cast("array<struct<category:string,type:string,severity:string,confidence:double,default_action:string,start:int,end:int,matched_text:string,masked_text:string,reason:string>>"))
    got = intel.intelligence_report(df).collect()
    assert len(calls) == 1
    assert [x["type"] for x in got[0]["iocs"]] == ["IP", "DOMAIN", "HASH_MD5", "CVE"] and {"EMAIL", "IP", "PERSON", "ID"} <= {x["type"] for x in got[0]["entities"]}
    assert got[0]["key_findings"][0]["finding"].startswith("Root cause") and [r["summary"].split(" ")[1] for r in got] == [str(len(re.split(r"\s+", t or ""))) for t in (text_, "", " ", None)]


def test_stats_and_cleaning_follow_the_plain_rules(spark):
    from palisade.functions.regex import SPACES, java, re2
    from palisade.functions.spans import spans

    pick = random.Random(3)
    blanks = "".join(chr(i) for a, b in SPACES for i in range(a, b + 1))
    kinds = [*"ab x\n\n\t  ", "\n\n\n\n", " \n", "\u00a0", "\u3000", "\ufeff", "\ufffd", "\u200b", "\x07", "\U0001F600", "é", "\x1c", "\x85"]
    texts = ["".join(pick.choices(kinds, k=pick.randint(0, 25))) for _ in range(300)] + [""]
    c = F.col("t")
    stats = text.text_stats(c)
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(c, stats["word_count"].alias("n"), stats["sections"].alias("s"), text.strip(c).alias("b"), text.clean(c).alias("c"), text.pieces_count(c).alias("p"))
    space = f"[{re.escape(blanks)}]"
    for r in df.collect():
        t = r["t"]
        plain = re.sub("[\ufffd\u200b-\u200d\ufeff\u00ad\x00-\x08\x0b\x0c\x0e-\x1f\x7f\U00010000-\U0010ffff]", "", t)
        assert r["c"] == re.sub(r"[ \t]+(?=\n|\Z)", "", re.sub("\n{3,}", "\n\n", plain)), repr(t)
        assert r["n"] == len([w for w in re.split(f"{space}+", t) if w]) and r["b"] == t.strip(blanks) and r["p"] == len(re.split(f"{space}+", t)), repr(t)
        assert r["s"] == max(1, len([b for b in re.split(f"\n{space}*\n", t) if b.strip(blanks)])), repr(t)
    for pattern, t in ((r"\b123\b", "0123 x123 123 é"), (r"\b123\b", "é 123 1234"), (r"\b123\b", "é 123"), (r"aa", "aaa"), (r"[a-z]+@", "éab@ ab@")):
        got = spark.createDataFrame([(t,)], "t string").select(spans(c, pattern).alias("m")).first()["m"]
        assert [(m["start"], m["end"], m["matched"]) for m in got] == [(*m.span(), m[0]) for m in re.finditer(pattern, t, re.ASCII)], t
    assert "^" not in java(r"\s+\S+") and "&&" not in re2(r"\s[a-z]\S") and "[a-z]" in re2(r"\s[a-z]\S")
