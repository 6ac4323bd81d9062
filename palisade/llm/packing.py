"""Packing by power-of-two decomposition.

Each document's ids, with the end-of-document id, are cut into pieces whose lengths are powers of
two: as many pieces of the full length as fit, then the binary digits of what is left, longest
first. A piece is a sequence of its own, so no sequence crosses documents and none needs padding;
``bucket`` is the power, and ``write_buckets`` puts sequences of one length together for batching.

Ids are those of the tokenizers library for the whole text without special tokens added; an added
token of the vocabulary that stands in a text has its own id. Null text counts as empty: its only id
is the end-of-document id. Null ids are kept. A repeated row, or another row with the same id, is
packed by itself, with sequences of its own. An empty table gives no pieces. Extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm._shared import slices


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: visible Latin-1 characters for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted({*range(256)} - {*visible})
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str) -> Callable[[str], bytes]:
    """Ids of a text as little-endian bytes, those that ``Tokenizer.encode`` of the file gives without adding special tokens.

    Added tokens in a text have their own ids, as there. A vocabulary whose ids are in order of merging
    can be read by ids alone, which is several times faster; other files, and the few texts that the
    fast reader gives up on (white space of a million characters), go through the file's own library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)

    def slow(text: str) -> bytes:
        return np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    vocabulary = {token: i for token, i in file["model"]["vocab"].items() if token not in added}
    of = {letter: b for b, letter in byte_letters().items()}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in file["model"]["merges"]]
    in_order = [vocabulary.get(m) for m in merges] == list(range(256, 256 + len(merges))) and len(vocabulary) == 256 + len(merges)
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in file["added_tokens"]) and not file["normalizer"] and not file["model"].get("ignore_merges")
    if not (in_order and plain):
        return slow
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={bytes(of[c] for c in token): i for token, i in vocabulary.items()}, special_tokens=added)

    def one(text: str) -> bytes:
        try:
            return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except ValueError:
            return slow(text)

    return one


def lengths(n: int, longest: int) -> list[int]:
    """Powers of two that add up to ``n``, none over ``longest``, longest first."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(df: DataFrame, path: str, pattern: str, end_id: int = 1, longest: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, bucket, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``longest`` must be a power of two. ``sequence_id`` is unique in the result; ``offset`` is 0, as
    a sequence is one piece.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, end = _tokenizer(path, pattern), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                rows, start, size, total, ids = [], [], [], [], []
                for row, text in enumerate(part.column(text_col).to_pylist()):
                    data = one(text or "") + end
                    at, n = 0, len(data) // 4
                    for k in lengths(n, longest):
                        rows.append(row)
                        start.append(at)
                        size.append(k)
                        total.append(n)
                        ids.append(data[4 * at : 4 * (at + k)])
                        at += k
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, total)), pa.array(ids, pa.binary())],
                    [id_col, "start", "length", "doc_tokens", "ids"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    pieces = df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, doc_tokens long, ids binary")
    return pieces.withColumns(
        {"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences of equal length in folders of their own, ready to be read as batches without padding."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)
