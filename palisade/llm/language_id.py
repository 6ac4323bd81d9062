"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; a binary classifier over byte n-grams (one to four, hashed,
of letters only) predicts each bit. Up to seven languages get the exhaustive code, which has every way
to part them in two; more get columns of a seeded draw, kept apart as far as possible. A bit's classifier
weighs an n-gram by the logarithm of its frequency in the languages on one side over that on the other,
each language counting alike. Decoding is loss-weighted: a language's loss is that of its bits' margins,
weighted by how often each bit's classifier is right on documents of that language; the codeword of
least loss wins. A document whose second-best language comes close is flagged as ambiguous.

Learning counts the n-grams of all rows to learn from, in whole, and measures the classifiers on all of
them once more. What goes to the driver is a number per language and hashed n-gram or bit, so its size
depends on the number of languages only; over ``MOST_LANGUAGES`` are refused.

A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learnt.
Letters beyond ASCII count as letters; digits, punctuation, symbols of ASCII and white space part words.
Rows whose language is null are not learnt from. Each row is judged by its text alone, also when ids
repeat or are null; other columns are not looked at, whatever their names; an empty table gives an empty
result. Texts are read in whole, in pieces of bounded work space.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm._shared import LOWER, UPPER, large_texts, mix, slices, text_of

#: Hashed n-grams; orders of n-grams; languages that can be told apart; positions that are looked up at once.
BUCKETS, ORDERS, MOST_LANGUAGES, PIECE = 1 << 15, (1, 2, 3, 4), 500, 1 << 18
#: Margin of the second-best language's posterior under which a decision is flagged.
CLEAR = 0.2
UND = "und"
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else 32 for b in range(256))
_LETTER = re.compile(rb"[A-Za-z]")
_PAD = b"    "


def code(k: int, seed: int = 7) -> np.ndarray:
    """(languages x bits) of +1 and -1."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 7:
        sides = [s for s in itertools.product((1, -1), repeat=k - 1) if -1 in s]
        return np.array([[1, *s] for s in sides], np.int8).T
    rng, bits = np.random.default_rng(seed), max(15, int(np.ceil(10 * np.log2(k))))
    best, apart = None, -1
    for _ in range(50):
        drawn = rng.choice(np.array([1, -1], np.int8), (k, bits))
        drawn[0, np.abs(drawn.sum(axis=0)) == k] *= -1  # a bit must part the languages
        d = (bits - drawn.astype(int) @ drawn.T.astype(int)) // 2 + bits * np.eye(k, dtype=int)
        if d.min() > apart:
            best, apart = drawn, d.min()
    return best


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "ignore"))))


def folded(text: bytes) -> bytes:
    """Words of letters in small letters between single spaces."""
    return b" ".join([b"", *text.translate(_FOLD).split(), b""])


def _grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's number, bucket) of the n-grams of folded texts, a bounded number at a time; a gram lies within one text."""
    sizes = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(t + _PAD for t in texts) + _PAD, np.uint8).astype(np.uint64)
    begin = np.cumsum(sizes + len(_PAD)) - sizes - len(_PAD)
    for a in range(0, len(raw) - len(_PAD), PIECE):
        at = np.arange(a, min(a + PIECE, len(raw) - len(_PAD)))
        row = np.searchsorted(begin, at, "right") - 1
        left = begin[row] + sizes[row] - at  # bytes of the text from here on
        value = np.zeros(len(at), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            value = value * np.uint64(256) + raw[at + n - 1]
            ok = left >= n
            yield row[ok], (mix(value[ok] + np.uint64(n << 40)) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """languages: in order. weights: (buckets x bits). code, trust: (languages x bits)."""

    languages: tuple[str, ...]
    weights: np.ndarray
    code: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """(texts x bits): the mean weight of a text's n-grams, scaled to its length."""
        out, n = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts))
        for row, bucket in _grams([folded(t) for t in texts]):
            n += np.bincount(row, minlength=len(texts))
            for j in range(out.shape[1]):
                out[:, j] += np.bincount(row, self.weights[bucket, j], len(texts))
        return out / np.sqrt(np.maximum(n, 1))[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best language, posterior of every language) by weighted logistic loss."""
        losses = np.stack([(np.logaddexp(0, -margins * c) * t).sum(axis=1) for c, t in zip(self.code, self.trust)], axis=1)
        p = np.exp(losses.min(axis=1, keepdims=True) - losses)
        return losses.argmin(axis=1), p / p.sum(axis=1, keepdims=True)


def _by_language(part: pa.RecordBatch) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {}
    for lang, text in zip(part.column("lang").to_pylist(), large_texts(part.column("text"))):
        if lang is not None and has_letter(text):
            out.setdefault(lang, []).append(text)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            for lang, texts in _by_language(part).items():
                own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, bucket in _grams([folded(t) for t in texts]):
                    own += np.bincount(bucket, minlength=BUCKETS)
                if len(total) > MOST_LANGUAGES:
                    raise ValueError(f"over {MOST_LANGUAGES} languages")
    for lang, own in total.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], ["lang", "bucket", "n"])


def _measure(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, bits = model.code.shape
        right, seen = np.zeros((k, bits), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for lang, texts in _by_language(part).items():
                    i = model.languages.index(lang)
                    right[i] += (model.margins(texts) * model.code[i] > 0).sum(axis=0)
                    seen[i] += len(texts)
        where = [(i, j) for i in range(k) if seen[i] for j in range(bits)]
        columns = [[i for i, _ in where], [j for _, j in where], [int(right[w]) for w in where], [int(seen[i]) for i, _ in where]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "j", "n_right", "n"])

    return run


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows whose language is known."""
    rows = df.filter(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), text_of(f"`{text_col}`").alias("text"))
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    words = code(len(languages))
    share = np.zeros((len(languages), BUCKETS))
    for i, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        share[i, own["bucket"]] = own["n"]
        share[i] = (share[i] + 0.5) / (share[i].sum() + 0.5 * BUCKETS)
    weights = np.zeros((BUCKETS, words.shape[1]))
    for j in range(words.shape[1]):
        sides = [share[words[:, j] == s] for s in (1, -1)]
        if all(len(s) for s in sides):
            weights[:, j] = np.log(sides[0].mean(axis=0)) - np.log(sides[1].mean(axis=0))
    trust = np.full(words.shape, 1 / max(1, words.shape[1]))
    model = Model(languages, weights, words, trust)
    if not languages:
        return model
    right = np.zeros(words.shape)
    for i, j, n_right, n in rows.mapInArrow(_measure(model), "i long, j long, n_right long, n long").groupBy("i", "j").agg(F.sum("n_right"), F.sum("n")).collect():
        right[i, j] = n_right / n
    # a language whose bits are all wrong is trusted alike
    right[right.sum(axis=1) == 0] = 1
    return Model(languages, weights, words, right / right.sum(axis=1, keepdims=True))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UND], dtype=object)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = large_texts(part.column("text"))
                known = np.array([bool(model.languages) and has_letter(t) for t in texts], bool)
                best, second = np.full(len(texts), len(model.languages)), np.full(len(texts), len(model.languages))
                score, gap = np.zeros(len(texts)), np.zeros(len(texts))
                if known.any():
                    found, p = model.decode(model.margins([t for t, k in zip(texts, known) if k]))
                    order = np.argsort(-p, axis=1, kind="stable")
                    best[known], score[known] = found, p[np.arange(len(p)), found]
                    if p.shape[1] > 1:
                        other = np.where(order[:, 0] == found, order[:, 1], order[:, 0])
                        second[known], gap[known] = other, score[known] - p[np.arange(len(p)), other]
                    else:
                        gap[known] = 1.0
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in part.schema.names if c != "text"), pa.array(names[best], pa.string()), pa.array(np.round(score, 6)), pa.array(names[second], pa.string()), pa.array(known & (gap < CLEAR))],
                    [*(c for c in part.schema.names if c != "text"), "lang_pred", "score", "runner_up", "ambiguous"],
                )

    return run


def identify(df: DataFrame, model: Model, *keep: Column, text_col: str = "text") -> DataFrame:
    """(kept columns, lang_pred, score, runner_up, ambiguous) of every row."""
    rows = df.select(*keep, text_of(f"`{text_col}`").alias("text"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"])
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("runner_up", "string"), ("ambiguous", "boolean")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(_predict(model), schema)
