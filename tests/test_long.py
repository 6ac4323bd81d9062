"""Long documents: overlap removal and replacement of many spans, against plain loops."""

import random

from pyspark.sql import functions as F

from palisade.functions import spans as S
from palisade.operators import outputs, sanitize, scan
from palisade.operators.scan import PRIORITY

PIECE = "array<struct<start:int,end:int,by:string>>"


def test_many_candidates_are_kept_as_by_a_plain_loop(spark):
    rng = random.Random(4)
    rows = []
    for n in (0, 1, 5, 33, 300, 1200):
        for spread in (60, 3_000):
            at = [rng.randrange(spread) for _ in range(n)]
            rows.append((len(rows), [(a, a + rng.choice([1, 2, 9, 40]), str(i)) for i, a in enumerate(at)]))
    got = {r[0]: [tuple(x) for x in r[1]] for r in spark.createDataFrame(rows, f"id int, c {S.SPAN}").select("id", S.greedy(F.col("c"), S.SPAN)).collect()}
    for i, candidates in rows:
        kept = []
        for a, b, m in candidates:
            if all(b <= x or a >= y for x, y, _ in kept):
                kept.append((a, b, m))
        assert got[i] == kept


def test_many_pieces_are_put_in_as_one_after_another(spark):
    rng = random.Random(6)
    rows = []
    for n, size, longest in ((0, 50, 5), (3, 50, 20), (40, 400, 30), (400, 9_000, 12), (400, 9_000, 700), (60, 30_000, 5)):
        text = "".join(rng.choice("abcdé漢😀 ") for _ in range(size))
        at = sorted((rng.randrange(size) for _ in range(n)), reverse=True)
        rows.append((len(rows), text, [(a, min(size, a + rng.randrange(1, longest)), rng.choice(["", "[X]", "a longer one"])) for a in at]))
    got = dict(spark.createDataFrame(rows, f"id int, text string, p {PIECE}").select("id", S.replace_spans(F.col("text"), F.col("p"))).collect())
    for i, text, pieces in rows:
        for a, b, by in pieces:
            text = text[:a] + by + text[b:]
        assert got[i] == text


def test_parts_of_long_texts(spark):
    text = "".join(chr(97 + i % 26) + ("é" if i % 7 == 0 else "") for i in range(9_000))
    df = spark.createDataFrame([(text,)], "text string").select("text", S.Blocks.of(F.col("text")).alias("b"))
    for start, size in ((0, 5), (2040, 20), (2048, 1), (4000, 5000), (9_000, 0), (len(text) - 3, 50)):
        assert df.select(S.Blocks(F.col("text"), F.col("b")).part(F.lit(start), F.lit(size))).first()[0] == text[start : start + size]


def test_findings_of_all_passes_are_resolved_as_by_a_plain_loop(spark):
    rng = random.Random(8)
    rows = []
    for n in (2, 40, 700):
        at = [rng.randrange(12 * n) for _ in range(n)]
        rows.append((n, [(rng.choice(list(PRIORITY)), f"T{i}", "LOW", rng.choice([0.5, 0.7, 0.9]), "MASK", a, a + rng.choice([1, 5, 30]), "m", "x", "r") for i, a in enumerate(at)]))
    got = {r[0]: [tuple(x) for x in r[1]] for r in spark.createDataFrame(rows, f"n int, f {scan.FINDING}").select("n", scan.resolve(F.col("f"))).collect()}
    for n, findings in rows:
        kept = []
        for f in sorted(findings, key=lambda f: (f[5], -f[3])):
            met = [k for k in kept if k[5] < f[6] and k[6] > f[5]]
            key = lambda x: (PRIORITY[x[0]], x[3], x[6] - x[5])
            if all(key(f) > key(k) for k in met):
                kept = [k for k in kept if k not in met] + [f]
        assert got[n] == sorted(kept, key=lambda f: f[5])


def test_thousands_of_findings_in_one_document(spark):
    n = 3_000
    text = " ".join(f"write to user{i}.name@mail{i % 97}.example.com and" for i in range(n))
    df = spark.createDataFrame([(1, text)], "document_id long, text string")
    found = scan.scan_array(df)
    first, last = found.select(F.size("findings").alias("n"), F.col("findings")[0]["start"].alias("a"), F.element_at("findings", -1)["end"].alias("b")).select("n", F.struct("a", "b")).first()
    assert first == n and tuple(last) == (9, len(text) - 4)
    clean = sanitize.sanitize(sanitize.with_policy(found, "PUBLIC_RELEASE")).first()["sanitized_content"]
    assert clean == " ".join("write to u***@***.example.com and" for _ in range(n))
    assert outputs.output_dlp(df).first()["repaired"] == clean
