"""Byte-level BPE encoding and decoding by prefix dynamic programming.

The encoding of every prefix of a piece ends in one token, and that token is the only one that is
both a suffix of the prefix and compatible with the last token of the prefix before it. So a table
with the last token of each byte prefix is enough to read off the encoding of any prefix; appending
bytes extends the table without touching it, and an edit invalidates only entries behind it.

Pieces are the matches of the pre-tokenizer's pattern, each encoded separately, without special
tokens. Null texts count as empty; an empty text has no ids. Extra columns are ignored; rows with
the same id stay separate rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from palisade.llm._shared import int_lists, slices

#: Entries of the two generations of the cache that a Python worker keeps between tasks.
CACHE = 250_000


class Vocabulary:
    """Ranks, and for each token the two tokens that its last merge joins."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.longest = max(map(len, ranks))
        self.left, self.right = list(range(len(self.bytes))), list(range(len(self.bytes)))
        self.known: dict[tuple[int, int], bool] = {}
        #: Nodes by the next byte; under -1 the token that ends there.
        self.trie: dict = {}
        for token, i in ranks.items():
            node = self.trie
            for byte in token:
                node = node.setdefault(byte, {})
            node[-1] = i
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self.left[i], self.right[i] = self._last_merge(token)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _last_merge(self, token: bytes) -> tuple[int, int]:
        """The pair left when the token's bytes are merged by rank until only its own merge remains."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            _, at = min((self.rank.get(a + b, len(self.bytes)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def follows(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together leaves exactly a and b."""
        key = (a, b)
        said = self.known.get(key)
        if said is None:
            if len(self.known) > CACHE:
                self.known.clear()
            said = self.known[key] = self._follows(a, b)
        return said

    def _follows(self, a: int, b: int) -> bool:
        """Undo the merges of both sides, latest first: at no time may a merge across the border come earlier than the one undone."""
        rank, text, limit = self.rank, self.bytes, len(self.bytes)
        while True:
            across = rank.get(text[a] + text[b])
            if across is not None and across < limit:
                return False
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            if whole_a and whole_b:
                return True
            if whole_b or (not whole_a and a > b):
                limit, a = a, self.right[a]
            else:
                # of equal ranks the left one merges first, so a merge over the border of the same rank comes before b's
                limit, b = b + 1, self.left[b]

    def extend(self, piece: bytes, last: list[int], begin: int) -> list[int]:
        """Entries of the table for prefixes longer than ``begin``, given those up to it.

        From each place, tokens that start there are read off the trie; one that may follow the last
        token before the place is the last token of the prefix that it ends.
        """
        follows, trie, n = self.follows, self.trie, len(piece)
        last[begin:] = [-1] * (n - begin)
        for start in range(max(0, begin + 1 - self.longest), n):
            before, node = last[start - 1] if start else -1, trie
            for end in range(start, n):
                node = node.get(piece[end])
                if node is None:
                    break
                token = node.get(-1)
                if token is not None and last[end] < 0 and (before < 0 or follows(before, token)):
                    last[end] = token
        if -1 in last:
            raise ValueError("the vocabulary lacks a byte")
        return last

    def ids(self, last: list[int]) -> list[int]:
        """Follow the table back from its end."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes[last[at - 1]])
        return out[::-1]


class Encoding:
    """The table of a whole text, which grows by ``append`` and changes by ``replace``.

    ``reused`` counts the bytes whose entries the last change left as they were.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.text, self.starts, self.tables, self.reused = "", [], [], 0
        self.replace(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [i for t in self.tables for i in self.vocabulary.ids(t)]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, begin: int, end: int, by: str) -> None:
        """Replace the characters from ``begin`` to ``end``; only pieces that the change can reach are encoded anew."""
        text, shift = self.text[:begin] + by + self.text[end:], len(by) - (end - begin)
        # a match depends on the text before its end and on at most two characters behind it
        k = 0
        while k < len(self.starts) and (self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)) + 1 < begin:
            k += 1
        at = self.starts[k] if k < len(self.starts) else 0
        k = min(k, len(self.starts))
        old = {s + shift: i for i, s in enumerate(self.starts) if s >= end}
        starts, tables = self.starts[:k], self.tables[:k]
        self.reused = sum(map(len, tables))
        for m in self.pattern.finditer(text, at):
            if m.start() in old:
                i = old[m.start()]
                starts += [s + shift for s in self.starts[i:]]
                tables += self.tables[i:]
                self.reused += sum(map(len, self.tables[i:]))
                break
            piece, last, common = m[0].encode(), [], 0
            if len(starts) < len(self.starts) and self.starts[len(starts)] == m.start():
                i = len(starts)
                was = self.text[self.starts[i] : self.starts[i + 1] if i + 1 < len(self.starts) else None].encode()
                common = next((j for j, (x, y) in enumerate(zip(was, piece)) if x != y), min(len(was), len(piece)))
                last = self.tables[i][:common]
                self.reused += common
            tables.append(self.vocabulary.extend(piece, last, common))
            starts.append(m.start())
        self.text, self.starts, self.tables = text, starts, tables


class Generations(dict):
    """A cache that forgets what was not asked for since it last filled up."""

    def __init__(self, compute, size: int):
        super().__init__()
        self.compute, self.size, self.older = compute, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.size:
            self.older = self.copy()
            self.clear()
        self[key] = value
        return value


#: White space on both sides of a space, where cutting before the space could change the matches.
UNSAFE_CUT = re.compile(r"\s (?:\s|\Z)")


class CachedEncoder:
    """Ids of texts as little-endian bytes, with the answer for each word kept.

    A text is cut before every space that follows a character other than white space, or that ends a
    run of white space; matches of the pattern never cross such a cut. Other texts are taken whole.
    """

    def __init__(self, whole, size: int = CACHE):
        """whole: str -> the bytes of its ids."""
        self.whole = whole
        self.rest = Generations(lambda word: whole(" " + word), size)

    def __call__(self, text: str) -> bytes:
        if UNSAFE_CUT.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return b"".join([self.whole(first), *map(self.rest.__getitem__, rest)])


def _int32(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<i4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> CachedEncoder:
    vocabulary, find = Vocabulary.read(path), regex.compile(pattern).findall

    def piece(match: str) -> bytes:
        match = match.encode()
        return _int32(vocabulary.ids(vocabulary.extend(match, [], 0)))

    pieces = Generations(piece, CACHE // 2)
    return CachedEncoder(lambda text: b"".join(map(pieces.__getitem__, find(text))))


@lru_cache(maxsize=2)
def _decoder(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    tokens = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
    sizes = np.array(list(map(len, tokens)), np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>), one row per row of ``df``; ids for a null text: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, text_col):
                ids = [one(t or "") for t in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(id_col), int_lists(ids)], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary): the bytes of the ids; null ids decode to no bytes. Unknown ids raise an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts, sizes = _decoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = part.column(ids_col)
                tokens = np.asarray(ids.flatten())
                if len(tokens) and not (0 <= tokens.min() and tokens.max() < len(sizes)):
                    raise ValueError("an id is not in the vocabulary")
                n = sizes[tokens]
                ends = np.cumsum(n)
                place = np.repeat(starts[tokens] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
                data = flat[place].tobytes()
                counts = np.array([len(x) if x is not None else 0 for x in ids], np.int64) if ids.null_count else np.diff(np.asarray(ids.offsets))
                cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
                out = [data[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(id_col), ids, pa.array(out, pa.binary())], [id_col, ids_col, "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>, decoded binary")


def append(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", more_col: str = "more") -> DataFrame:
    """(id, ids) of ``text`` followed by ``more``, given the ids of ``text``: only the text's last match is encoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, find = encoder(path, pattern), regex.compile(pattern)
        for batch in batches:
            for part in slices(batch, text_col):
                out = []
                for text, ids, more in zip(*(part.column(c).to_pylist() for c in (text_col, ids_col, more_col))):
                    text, more, last = text or "", more or "", 0
                    # a space behind something else always begins a match; start from the last such place
                    for last in (m.start() for m in re.finditer(r"(?<=\S) ", text)):
                        pass
                    tail = one(text[last:])
                    kept = _int32((ids or [])[: len(ids or []) - len(tail) // 4])
                    out.append(kept + b"".join(one(m) for m in find.findall(text[last:] + more)))
                yield pa.RecordBatch.from_arrays([part.column(id_col), int_lists(out)], [id_col, ids_col])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col, ids_col, more_col).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>")
