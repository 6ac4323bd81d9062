"""Matches with offsets, context tests, overlap removal and replacement, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.regex import java

SPAN = "array<struct<start:int,end:int,matched:string>>"
#: Elements that a fold appends to before they are put aside; characters of a block of text.
BATCH, BLOCK = 256, 2048
#: Up to so many candidates or pieces the plain fold is the cheaper one.
FEW = 32


def _parted(text: Column, pattern: str, test: Column | None) -> Column:
    """All matches, each with its length and that of the gap before it."""
    p = java(pattern)
    sizes = lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("m"))
    none = nothing_of("array<struct<gap:int,size:int,m:string>>")
    several = lambda matched: F.zip_with(F.slice(F.split(text, p, -1), 1, F.size(matched)), matched, sizes)
    # where the text has the one match's characters once, they tell its place
    place = lambda matched: F.when(F.size(matched) == 1, F.instr(text, F.get(matched, F.lit(0))))
    once = lambda matched, at: (at > 0) & (F.call_function("locate", F.get(matched, F.lit(0)), text, at + 1) == 0)
    alone = lambda matched, at: F.array(F.struct((at - 1).alias("gap"), F.length(F.get(matched, F.lit(0))).alias("size"), F.get(matched, F.lit(0)).alias("m")))
    gaps = lambda matched: let(place(matched), lambda at: F.when(once(matched, at), alone(matched, at)).otherwise(several(matched)))
    # matches are looked for once; what lies between them only where there are some
    found = let(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda matched: F.when(F.size(matched) > 0, gaps(matched)).otherwise(none))
    return found if test is None else F.when(test, found).otherwise(none)


def _located(parted: Column) -> Column:
    """Offsets are running sums of the lengths of matches and gaps, which alternate."""
    def step(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        return F.struct((start + x["size"]).alias("state"), F.array(F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["m"].alias("matched"))).alias("out"))

    # most patterns match nothing in most texts, and a fold costs more than a look at the size
    return F.when(F.size(parted) > 0, sweep(parted, F.lit(0), step, SPAN)).otherwise(nothing_of(SPAN))


def spans(text: Column, pattern: str, test: Column | None = None) -> Column:
    """array<struct<start, end, matched>>: all matches from left to right; 0-based code points, end exclusive.

    test: a cheap condition without which there can be no match, as most texts match few patterns.
    """
    return _located(_parted(text, pattern, test))


def spans_of_each(text: Column, patterns: list[tuple[str, Column | None]]) -> Column:
    """An array of ``spans``, one for each (pattern, test); a plan has the running sums once, however many patterns there are."""
    return F.transform(F.array(*(_parted(text, p, test) for p, test in patterns)), _located)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once per row, however often it is used inside lambdas."""
    return F.transform(F.array(value), use)[0]


def each(df: DataFrame, values: Column, out: str, *keep: str, position: str = "") -> DataFrame:
    """``keep`` and a row per element. An explode would also test the array for elements, and so compute it again below itself."""
    rows = df.select(*keep, F.posexplode_outer(values).alias(position, out)) if position else df.select(*keep, F.explode_outer(values).alias(out))
    return rows.filter(F.col(out).isNotNull())


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def sweep(items: Column, state: Column, step: Callable[[Column, Column], Column], kind: str, close: Callable[[Column], Column] | None = None) -> Column:
    """What ``step`` gives out, as an array of ``kind``, for one item after another.

    step: (state, item) -> struct<state, out array>. close: what the last state gives out. An array that
    grows by one element is copied each time, so items are taken ``BATCH`` at a time and the batches'
    arrays put together at the end: time grows with the number of items, not with its square.
    """
    none = nothing_of(kind)

    def one(acc: Column, x: Column) -> Column:
        return let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))

    def over(rows: Column) -> Column:
        def batch(acc: Column, i: Column) -> Column:
            done = F.aggregate(F.slice(rows, i * BATCH + 1, F.lit(BATCH)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
            return let(done, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

        last = F.floor(F.greatest(F.size(rows) - 1, F.lit(0)) / BATCH).cast("int")
        zero = F.struct(state.alias("state"), nothing_of(f"array<{kind}>").alias("outs"))
        return F.aggregate(F.sequence(F.lit(0), last), zero, batch, lambda acc: F.concat(F.flatten(acc["outs"]), close(acc["state"])) if close else F.flatten(acc["outs"]))

    return let(items, over)


def _one_by_one(candidates: Column, kind: str) -> Column:
    return F.aggregate(
        candidates, nothing_of(kind),
        lambda acc, f: F.when(F.exists(acc, lambda a: overlap(a, f)), acc).otherwise(F.concat(acc, F.array(f))),
    )


def greedy(candidates: Column, kind: str) -> Column:
    """In the given order, those that overlap none accepted before.

    Many candidates are parted into groups that no overlap joins, found from left to right; candidates
    are compared within their group only.
    """
    entry = kind.removeprefix("array<")[:-1]
    group = f"array<struct<start:int,seq:int,f:{entry}>>"
    placed = lambda f, i: F.struct(f["start"].alias("start"), i.alias("seq"), f.alias("f"))

    def settled(g: Column) -> Column:
        in_order = lambda: F.transform(F.array_sort(F.transform(g, lambda x: F.struct(x["seq"].alias("seq"), x["f"]["start"].alias("start"), x["f"]["end"].alias("end"), x["f"].alias("f")))), lambda x: x)
        kept = _one_by_one(in_order(), f"array<struct<seq:int,start:int,end:int,f:{entry}>>")
        return F.when(F.size(g) > 1, F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["seq"].alias("seq"), x["f"].alias("f")))).otherwise(g)

    def step(state: Column, x: Column) -> Column:
        apart, end = x["start"] >= state["reach"], x["f"]["end"]
        now = F.struct(F.when(apart, end).otherwise(F.greatest(state["reach"], end)).alias("reach"), F.when(apart, F.array(x)).otherwise(F.concat(state["group"], F.array(x))).alias("group"))
        return F.struct(now.alias("state"), F.when(apart, settled(state["group"])).otherwise(nothing_of(group)).alias("out"))

    def many(c: Column) -> Column:
        zero = F.struct(F.lit(0).alias("reach"), nothing_of(group).alias("group"))
        kept = sweep(F.array_sort(F.transform(c, placed)), zero, step, group, lambda state: settled(state["group"]))
        in_order = F.array_sort(F.transform(kept, lambda x: F.struct(x["seq"].alias("seq"), x["f"].alias("f"))))
        return F.transform(in_order, lambda x: x["f"])

    return let(candidates, lambda c: F.when(F.size(c) <= FEW, _one_by_one(c, kind)).otherwise(many(c)))


@dataclass(frozen=True)
class Blocks:
    """A text and its blocks of ``BLOCK`` characters: a part far into a long string is found without counting from its start."""

    text: Column
    blocks: Column

    @staticmethod
    def of(text: Column) -> Column:
        return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))

    def part(self, start: Column, size: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        last = F.floor((start + F.greatest(size - 1, F.lit(0))) / BLOCK).cast("int")
        return F.substring(F.array_join(F.slice(self.blocks, first + 1, last - first + 1), ""), start - first * BLOCK + 1, size)


def part(text: Column | Blocks, start: Column, size: Column) -> Column:
    """The characters from start on (0-based); start not below 0."""
    return text.part(start, size) if isinstance(text, Blocks) else F.substring(text, start + 1, size)


def near(text: Column | Blocks, start: Column, end: Column, keywords: list[str], window: int) -> Column:
    """Whether a keyword occurs, as part of a word too and in any case, within ``window`` characters of a span."""
    low = F.greatest(F.lit(0), start - window)

    def holds(around: Column) -> Column:
        out = F.lit(False)
        for k in keywords:
            out = out | F.contains(around, F.lit(k.lower()))
        return out

    return let(F.lower(part(text, low, end + window - low)), holds)


def replace_spans(text: Column, pieces: Column) -> Column:
    """``text`` with the pieces (start, end, by), given from the last to the first, put in one after another.

    Pieces may overlap: each is put into the text as it then is. Many pieces are put together from parts
    of the text from its end on; a piece reaches at most its own length into what was put in before it,
    so only so much of that is kept at hand.
    """
    def step(acc: Column, p: Column) -> Column:
        return F.concat(F.substring(acc, F.lit(1), p["start"]), p["by"], F.substr(acc, p["end"] + 1))

    def many(of: Blocks, ps: Column, longest: Column) -> Column:
        def put(state: Column, p: Column) -> Column:
            gap = F.concat(p["by"], of.part(p["end"], state["at"] - p["end"]), state["ahead"])
            into = F.concat(p["by"], F.substr(state["ahead"], p["end"] - state["at"] + 1))
            full = lambda c: F.length(c) > 2 * longest + BLOCK
            return let(F.when(p["end"] <= state["at"], gap).otherwise(into), lambda c: F.struct(
                F.struct(p["start"].alias("at"), F.when(full(c), F.left(c, longest)).otherwise(c).alias("ahead")).alias("state"),
                F.when(full(c), F.array(F.substr(c, longest + 1))).otherwise(nothing_of("array<string>")).alias("out"),
            ))

        zero = F.struct(F.length(of.text).alias("at"), F.lit("").alias("ahead"))
        out = sweep(ps, zero, put, "array<string>", lambda state: F.array(state["ahead"], of.part(F.lit(0), state["at"])))
        return F.array_join(F.reverse(out), "")

    longest = lambda ps: F.array_max(F.transform(ps, lambda p: p["end"] - p["start"]))
    linear = lambda ps: let(Blocks.of(text), lambda b: let(longest(ps), lambda n: many(Blocks(text, b), ps, n)))
    return let(pieces, lambda ps: F.when(F.size(ps) <= FEW, F.aggregate(ps, text, step)).otherwise(linear(ps)))


def nothing_of(kind: str) -> Column:
    return F.array().cast(kind)


Gate = Callable[[Column, Column], Column]
