"""Detection of periodic runs of words by online dyadic square catching.

Words come one after another, in appends of any size. A catcher stands over every completed block of
2^k words and waits for squares whose half has 2^(k+1) to 2^(k+2) - 1 words: the left half of such a
square, or rather the stretch of words that come back one period later, holds a whole block. So each
appended word, as the last of a window of 2^k words, advances the comparison with just two catchers of
each level. Squares of short halves wait behind smaller shifts of the two smallest blocks. A catcher
whose block comes back is followed to both sides by comparing suffixes (longest common extensions by
sums of powers, 2 x 31 bits); what still reaches the last word stays open and is taken up by the next
append. Squares of one shift that belong together are reported once, by their first block, and merge
into the run; of shifts that give the same stretch the smallest is its period. Every run is compared
word by word at last; should hashes have lied, all is done again with other ones.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at
least max(``min_length``, 2 q) words that no neighbouring word extends keeping period q. Time and space
grow with n log n and n. Work space is bounded by the longest text and a slice of texts.

Texts are split at ASCII white space (space, \\x09-\\x0D). Null and empty texts have no words and no
runs. Each row is a text of its own, also when ids are null or repeat; extra columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm._shared import large_texts, slices, text_of

#: The modulus of both hashes, a Mersenne prime, and the bases that are tried two by two.
PRIME = np.uint64((1 << 31) - 1)
BASES = [(902_653_123, 1_743_202_891), (611_953_017, 2_019_443_561), (1_333_777_019, 480_120_007)]
#: Words that keep texts apart have numbers from here on, each its own.
APART = 1 << 30
RUNS = T.ArrayType(T.StructType([T.StructField(f, T.LongType()) for f in ("start", "length", "period")]))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x == PRIME, np.uint64(0), x)


class Catchers:
    """The state of the detection: words, sums of powers, open squares and closed ones."""

    def __init__(self, min_length: int = 12, bases: tuple[int, int] = BASES[0]):
        if min_length < 10:
            raise ValueError("runs of at least ten words")  # periods 1 to 3 wait behind blocks of four words
        self.min_length, self.bases = min_length, [np.uint64(b) for b in bases]
        self.n = 0
        self.words, self.since = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.powers = [np.ones(1, np.uint64) for _ in bases]
        self.sums = [np.zeros(1, np.uint64) for _ in bases]
        self.open = np.zeros((0, 2), np.int64)  # first word, shift
        self.closed: list[np.ndarray] = []  # first word, end, shift

    def append(self, words: np.ndarray) -> np.ndarray:
        """Take up words; returns the squares (first word, end, half's length) that closed or grew to the last word by them.

        Words from ``APART`` on begin a new text and must each be another.
        """
        n0, n1 = self.n, self.n + len(words)
        self._grow(words)
        self.n = n1
        if len(self.open):
            x, p = self.open.T
            grown = self._forward(np.full(len(x), n0) - p, np.full(len(x), n0), n1)
            self._settle(x, n0 + grown, p)
        for s, shifts in self._levels(n1):
            self._catch(n0, n1, s, shifts)
        x, p = self.open.T
        square = n1 - x >= np.maximum(2 * p, self.min_length)
        return np.concatenate([*self.closed[-1:], np.stack([x, np.full(len(x), n1), p], 1)[square]])

    def runs(self) -> np.ndarray:
        """(first word, end, period) of all runs, by first word, as if the words ended here."""
        x, p = self.open.T
        last = np.stack([x, np.full(len(x), self.n), p], 1)
        found = np.concatenate([*self.closed, last[self.n - x >= np.maximum(2 * p, self.min_length)]])
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        same = np.zeros(len(found), bool)
        same[1:] = (found[1:, :2] == found[:-1, :2]).all(1)  # multiples of the period
        return found[~same]

    def _grow(self, words: np.ndarray) -> None:
        n0, n = self.n, len(words)
        first = np.maximum.accumulate(np.where(words >= APART, np.arange(n0, n0 + n), self.since[-1] if n0 else 0)) if n else words
        self.words, self.since = np.concatenate([self.words, words]), np.concatenate([self.since, first])
        for k, base in enumerate(self.bases):
            pw = self.powers[k]
            while len(pw) <= n0 + n:
                pw = np.concatenate([pw, _reduced(pw * _reduced(pw[-1:] * base))])
            self.powers[k] = pw
            terms = _reduced((words + 1).astype(np.uint64) * pw[n0 : n0 + n])
            self.sums[k] = np.concatenate([self.sums[k], _reduced(self.sums[k][-1] + np.cumsum(terms))])

    def _levels(self, n: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(block length, blocks back of a window's own block): shifts 1-3, 4-7, 8-15, 16-31 and so on."""
        yield 4, (0,)
        s = 2
        while 3 * s <= n:
            yield s, (2, 3)
            s *= 2

    def _part(self, k: int, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """The hash of words at .. at + size, times the power of its place."""
        s = self.sums[k]
        return _reduced(s[at + size] + (PRIME - s[at]))

    def _catch(self, n0: int, n1: int, s: int, back: tuple[int, ...]) -> None:
        j = np.arange(max(0, n0 - s + 1), n1 - s + 1)
        if back[0]:
            j = j[j - self.since[j] >= 2 * s]  # no block so far back in the same text
        if not len(j):
            return
        here, block = self._part(0, j, s), j // s
        for b in back:
            i = (block - b) * s
            ok = (i >= 0) & (i < j)
            there = self._part(0, np.maximum(i, 0), s)
            hit = np.flatnonzero(ok & (_reduced(there * self.powers[0][j - i]) == here))
            if not len(hit):
                continue
            i, at = i[hit], j[hit]
            # not the first block of its stretch: the block before came back at this shift too
            before = np.maximum(i - s, 0)
            follows = (i >= s) & (self.since[i] <= i - s) & (_reduced(self._part(0, before, s) * self.powers[0][at - i]) == self._part(0, before + (at - i), s))
            i, at = i[~follows], at[~follows]
            left, right = self._backward(i, at), self._forward(i, at, n1)
            real = right >= s
            self._settle((i - left)[real], (at + right)[real], (at - i)[real], add=True)

    def _equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.ones(len(i), bool)
        for k in range(len(self.bases)):
            out &= _reduced(self._part(k, i, size) * self.powers[k][j - i]) == self._part(k, j, size)
        return out

    def _forward(self, i: np.ndarray, j: np.ndarray, end: int) -> np.ndarray:
        """How many words from i on are those from j on, up to the end."""
        low, high = np.zeros(len(i), np.int64), end - j
        while len(low) and (low < high).any():
            mid = (low + high + 1) // 2
            ok = self._equal(i, j, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def _backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i are those before j."""
        low, high = np.zeros(len(i), np.int64), i.copy()
        while len(low) and (low < high).any():
            mid = (low + high + 1) // 2
            ok = self._equal(i - mid, j - mid, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def _settle(self, x: np.ndarray, end: np.ndarray, p: np.ndarray, add: bool = False) -> None:
        """Stretches that reach the last word stay open; of the others the squares are closed."""
        reach = end == self.n
        now = np.stack([x[reach], p[reach]], 1)
        self.open = np.concatenate([self.open, now]) if add else now
        square = ~reach & (end - x >= np.maximum(2 * p, self.min_length))
        if square.any():
            self.closed.append(np.stack([x[square], end[square], p[square]], 1))


def runs_of(words: np.ndarray, min_length: int = 12) -> np.ndarray:
    """(first word, end, period) of the runs of numbered words."""
    for bases in BASES:
        state = Catchers(min_length, bases)
        state.append(words)
        found = state.runs()
        if all(np.array_equal(words[a : b - p], words[a + p : b]) for a, b, p in found.tolist()):
            return found
    raise RuntimeError("hashes of unequal words agree, whatever the base")


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def _find(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = [t.split() for t in large_texts(part.column("text"))]
                sizes = np.array([len(t) for t in texts])
                begin = np.cumsum(sizes + 1) - sizes  # each text's first word; a word that keeps it apart stands before it
                number, words = _Numbers(), np.empty(int(sizes.sum()) + len(texts), np.int64)
                words[begin - 1] = APART + np.arange(len(texts))
                for t, b in zip(texts, begin):
                    words[b : b + len(t)] = list(map(number.__getitem__, t))
                found = runs_of(words, min_length)
                row = np.searchsorted(begin, found[:, 0], "right") - 1
                # what a run repeats: its words after the first period
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, found[:, 0] + found[:, 2], 1)
                np.add.at(edge, found[:, 1], -1)
                gone = np.cumsum(edge) > 0
                hit = set(row.tolist())
                kept = [b" ".join(t) if k not in hit else b" ".join([w for w, g in zip(t, gone[begin[k] : begin[k] + len(t)].tolist()) if not g]) for k, t in enumerate(texts)]
                ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                fields = [found[:, 0] - begin[row], found[:, 1] - found[:, 0], found[:, 2]]
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), runs), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"]
                )

    return run


def find_runs(df: DataFrame, min_length: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed): every text's runs (start, length, period; words from 0, by start, then period), and the text with each run cut to its first period, words joined by one space."""
    docs = df.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType)]).add("n_words", "long").add("runs", RUNS).add("collapsed", "string")
    return docs.mapInArrow(_find(min_length), schema).withColumnRenamed("id", id_col)
