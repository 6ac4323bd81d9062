"""Substring deduplication by level-wise doubling.

A window of words that starts at two places repeats all windows inside it. So windows repeated at one
length alone are extended to twice that length: a quarter of the window, half of it, all of it. At
the short levels each window is represented by its smallest inner window (the same one wherever the
window occurs), which keeps the tables a fraction of the corpus; neighbouring windows with one
representative form a run. A run whose whole span of words repeats needs no further look; windows of
the other runs, and of one copy of each repeated span that they could match, are compared one by one.
The search ends early when no candidates survive a level.

Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return, taken
unchanged. Windows lie inside one document and are judged on the input. Null texts have no words.
Every row is a document of its own, also when ids repeat or are null. Windows are equal if their first
128 bits of hash are. Extra columns come back as they were; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm._shared import Scratch, bucketed, mix, quoted, slices

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
#: Odd multipliers: for places of bytes, and of the polynomial hashes over words (of at most some 50 words at a time, too few to cancel out).
BYTE, WORD, WORD2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
WORDS_AT_ONCE = 1 << 16
#: Text taken at once, unless a document is longer.
SLICE = 1 << 20


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n; tables are shared by sizes up to the next power of two."""
    return _powers(base, 1 << max(10, (n - 1).bit_length()))[:n]


class Rolling:
    """Polynomial hashes of all stretches of a sequence, from one running sum."""

    def __init__(self, values: np.ndarray, base: int):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(base, len(values)), dtype=np.uint64)])
        self.back = powers(pow(base, -1, 1 << 64), len(values) + 1)

    def between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin])


class Words:
    """Where the words of some texts stand, and hashes of them."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        edge = np.flatnonzero(np.diff(IS_SPACE[self.data], prepend=True))
        self.begin, self.end = edge[0::2], edge[1::2]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        self.doc = np.searchsorted(starts, self.begin, "right") - 1

    def hashes(self, seed: int) -> np.ndarray:
        """64 bits a word: every byte at every place in a word stands for a random number of its own, and the numbers are added up.

        Unlike powers of one base, which for some pairs of words cancel out whatever the base is.
        """
        out = np.zeros(len(self.begin), np.uint64)
        for a in range(0, len(out), WORDS_AT_ONCE):
            begin, size = self.begin[a : a + WORDS_AT_ONCE], (self.end - self.begin)[a : a + WORDS_AT_ONCE]
            first = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(first, size)
            values = mix((place * 256 + self.data[np.repeat(begin, size) + place]).astype(np.uint64) * np.uint64(BYTE) + np.uint64(seed))
            out[a : a + WORDS_AT_ONCE] = mix(np.add.reduceat(values, first) + size.astype(np.uint64) * np.uint64(BYTE))
        return out


def least_inside(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the first place of the smallest of values[i : i + width]."""
    place, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        a, b = place[:-step], place[step:]
        place = np.where(values[b] < values[a], b, a)
        size += step
    return place


class Slice:
    """Some documents' windows of ``window`` words: number, document, first word."""

    def __init__(self, texts: list[bytes], window: int):
        self.window, self.source = window, Words(texts)
        self.words, self.doc = self.source.hashes(1), self.source.doc
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))  # of each document
        n = max(0, len(self.words) - window + 1)
        self.inside = self.doc[:n] == self.doc[window - 1 : window - 1 + n] if n else np.zeros(0, bool)
        self.roll = Rolling(self.words, WORD)

    def inner(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all stretches of ``length`` words; for each window the place of its smallest."""
        n = max(0, len(self.words) - length + 1)
        at = np.arange(n)
        h = self.roll.between(at, at + length)
        return h, least_inside(h, self.window - length + 1)[: len(self.inside)]

    def hash(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of stretches of words, 64 each from two hashes of every word that have nothing in common."""
        if not hasattr(self, "roll2"):
            self.roll2 = Rolling(self.source.hashes(2), WORD2)
        return self.roll.between(begin, end), self.roll2.between(begin, end)

    def mask(self, places: list, size: int) -> np.ndarray:
        """True at each document's listed word numbers."""
        out = np.zeros(size, bool)
        for first, own in zip(self.first, places):
            if own is not None and len(own):
                out[first + np.asarray(own)] = True
        return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def _lists(column: pa.Array) -> list:
    return [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in column]


def short_windows(window: int, length: int):
    """(row, text) to (h, row, pos): the windows' smallest inner windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                s = Slice(_texts(part), window)
                h, least = s.inner(length)
                at = np.unique(least[s.inside])
                doc = s.doc[at]
                yield pa.RecordBatch.from_arrays([_signed(h[at]), part.column("row").take(pa.array(doc)), pa.array((at - s.first[doc]).astype(np.int32))], ["h", "row", "pos"])

    return run


def runs(window: int, length: int, longer: int):
    """(row, text, places) to (h, s1, s2, row, lo, hi): runs of windows that survive, by their smallest inner window of twice the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                s = Slice(_texts(part), window)
                h, least = s.inner(length)
                alive = np.flatnonzero(s.inside & s.mask(_lists(part.column("places")), len(h))[least] if len(least) else s.inside)
                h, least = s.inner(longer)
                new = np.ones(len(alive), bool)
                new[1:] = (np.diff(alive) > 1) | (np.diff(least[alive]) != 0) | (np.diff(s.doc[alive]) != 0)
                lo = alive[new]
                hi = alive[np.append(np.flatnonzero(new)[1:] - 1, len(alive) - 1)] if len(alive) else lo
                s1, s2 = s.hash(lo, hi + window)
                doc, first = s.doc[lo], s.first[s.doc[lo]]
                yield pa.RecordBatch.from_arrays(
                    [_signed(h[least[lo]]), _signed(s1), _signed(s2), part.column("row").take(pa.array(doc)), pa.array((lo - first).astype(np.int32)), pa.array((hi - first).astype(np.int32))],
                    ["h", "s1", "s2", "row", "lo", "hi"],
                )

    return run


def windows(window: int):
    """(row, text, los, his) to (h, s1, row, pos): the windows of the listed runs, h and s1 their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                s = Slice(_texts(part), window)
                at = [np.zeros(0, np.int64)]
                for first, los, his in zip(s.first, _lists(part.column("los")), _lists(part.column("his"))):
                    at += [first + np.arange(a, b + 1) for a, b in zip(los, his)]
                at = np.unique(np.concatenate(at))
                h, s1 = s.hash(at, at + window)
                doc = s.doc[at]
                yield pa.RecordBatch.from_arrays([_signed(h), _signed(s1), part.column("row").take(pa.array(doc)), pa.array((at - s.first[doc]).astype(np.int32))], ["h", "s1", "row", "pos"])

    return run


def removal(columns: list[str], window: int):
    """(columns, text, los, his) to (columns, n_words, n_removed, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 * SLICE):
                total, gone, kept = [], [], []
                for text, los, his in zip(_texts(part), _lists(part.column("los")), _lists(part.column("his"))):
                    own = text.split()
                    cover = np.zeros(len(own) + 1, np.int64)
                    if los is not None:
                        np.add.at(cover, los, 1)
                        np.add.at(cover, his + window, -1)
                    stay = np.cumsum(cover)[:-1] == 0
                    total.append(len(own))
                    gone.append(len(own) - int(stay.sum()))
                    kept.append(b" ".join([own[i] for i in np.flatnonzero(stay)] if gone[-1] else own))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*columns, "n_words", "n_removed", "kept"]
                )

    return run


def _spread(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``df`` with a number for each row, as a table bucketed by it, so that no later join moves the texts again."""
    numbered = df.withColumn("row", F.monotonically_increasing_id())
    out = bucketed(df.sparkSession, scratch.path(name), numbered.schema, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["row"], numbered)
    del numbered
    scratch.release()
    return out


def remove_repeats(df: DataFrame, window: int = 35, text_col: str = "text") -> DataFrame:
    """``df``'s columns with n_words, n_removed and kept (the words that stay, joined by one space).

    A word goes if a window of ``window`` words that covers it has the same words as a window that
    starts elsewhere, in any document. Columns of ``df`` by those names, or named row, text, los or
    his, come back under their own names and hold what they held.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    scratch = Scratch(df.sparkSession, "substring-dedup")
    others = [F.struct(*map(quoted, df.columns)).alias("document")]
    base = _spread(df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *others), scratch, "documents")
    texts = base.select("row", "text")
    length, longer = -(-window // 4), -(-window // 2)

    short = scratch.save(texts.mapInArrow(short_windows(window, length), "h long, row long, pos int"), "short")
    twice = scratch.save(short.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "short-twice")
    places = short.join(twice, "h").groupBy("row").agg(F.collect_list("pos").alias("places"))
    found = scratch.save(texts.join(places, "row").select("row", "text", "places").mapInArrow(runs(window, length, longer), "h long, s1 long, s2 long, row long, lo int, hi int"), "runs")
    scratch.drop("short", "short-twice")
    scratch.release()
    covered = None
    if not found.isEmpty():
        key = ["h", "s1", "s2"]
        spans = scratch.save(found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "lo", "hi")).alias("one")), "spans")
        groups = scratch.save(spans.groupBy("h").agg(F.sum("n").alias("all"), F.count_if(F.col("n") == 1).alias("lone")).filter("all > 1 and lone > 0").select("h"), "groups")
        whole = scratch.save(spans.filter("n > 1").select(*key), "whole")
        sure = found.join(whole, key).select("row", "lo", "hi")
        look = spans.join(groups, "h").select("one.*").groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("r")).select("row", F.col("r.lo").alias("los"), F.col("r.hi").alias("his"))
        single = scratch.save(texts.join(look, "row").select("row", "text", "los", "his").mapInArrow(windows(window), "h long, s1 long, row long, pos int"), "windows")
        again = scratch.save(single.groupBy("h", "s1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "s1"), "windows-twice")
        covered = sure.unionByName(single.join(again, ["h", "s1"]).select("row", F.col("pos").alias("lo"), F.col("pos").alias("hi")))
        covered = covered.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("r")).select("row", F.col("r.lo").alias("los"), F.col("r.hi").alias("his"))
        joined = base.join(covered, "row", "left")
    else:
        nothing = F.lit(None).cast("array<int>")
        joined = base.withColumns({"los": nothing, "his": nothing})
    schema = T.StructType([base.schema["document"]]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    out = joined.select("document", "text", "los", "his").mapInArrow(removal(["document"], window), schema)
    return out.select("document.*", "n_words", "n_removed", "kept")


def strip_repeats(df: DataFrame, window: int = 35, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with repeated passages cut out of its texts; texts without any stay exactly as they are."""
    out = remove_repeats(df.select(F.struct(*map(quoted, df.columns)).alias("original"), F.col(text_col).alias("text")), window)
    old = {c: F.col("original").getField(c).alias(c) for c in df.columns}
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("original").getField(text_col))
    old[text_col] = text.alias(text_col)
    if length_col in df.columns:
        kind = df.schema[length_col].dataType
        old[length_col] = F.when(F.col("n_removed") > 0, F.length("kept").cast(kind)).otherwise(F.col("original").getField(length_col)).alias(length_col)
    return out.select(*old.values())
