"""Exact ranked lexical search with sparse ball trees.

A document is a vector over the terms that any query has: a term's weight times its saturated frequency,
whole numbers; a query is the indicator of its terms, so the score is the inner product. A task puts its
documents into trees of bounded size. A node knows the centroid of its documents, their largest
distance from it (the ball's radius) and, as queries touch few terms, the largest distance along each
term. No document below it scores more than query . centroid + |query| x radius (Cauchy-Schwarz), nor
more than query . centroid + query . distances by term; the lower of the two is the node's bound. Nodes
are opened best first; what is bound below the tenth score so far is left out, unopened. Bounds are
rounded up beyond any error of floating point. Scores at the leaves are sums of 64-bit integers.

Queries come in blocks of bounded numbers of items and terms; each block is sent to all tasks, which
read the documents' term counts from a table in the shared folder. So many passes over that table are
made as there are blocks. The best of a task's documents are ranked once more over all tasks.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased.
Null texts have none. Items without terms have no rows. Every row is a document (an item) of its own,
also if ids repeat; equal scores are in order of the document's id, null ids last. Extra columns are
ignored, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm._shared import LOWER, UPPER, Scratch, large_texts, slices, text_of

#: Bytes of no term become spaces, capitals small letters.
_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else 32 for b in range(256))
#: Documents of a tree and of a leaf.
TREE, LEAF = 256, 4
#: Items and terms of a block of queries, which is what a task holds of them.
ITEMS, TERMS = 512, 8192
#: Relative error granted to bounds; sums of as many products as there are terms stay far below.
SLACK = 1e-9


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Tree:
    """A ball tree over rows of whole numbers (documents by terms)."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.rows, self.order = rows, np.arange(len(rows))
        self.members: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self.centroids, self.radii, self.spread = [], [], []
        x = rows.astype(np.float64)  # below 2 ** 53, so exact
        size = np.einsum("ij,ij->i", x, x)

        def add(a: int, b: int) -> int:
            node = len(self.members)
            self.members.append((a, b))
            self.children.append(None)
            part, square = x[a:b], size[a:b]
            c = part.mean(axis=0)
            cc = float(c @ c)
            d = square - 2 * (part @ c) + cc
            self.centroids.append(c)
            self.spread.append(np.maximum(part.max(axis=0) - c, c - part.min(axis=0)))
            # differences of large squares lose digits, hence a part of the squares' own size
            self.radii.append(math.sqrt(max(0.0, float(d.max())) + SLACK * (float(square.max()) + cc)))
            if b - a > leaf and self.spread[-1].any():
                far = part[d.argmax()]
                other = part[(square - 2 * (part @ far)).argmax()]
                side = np.argsort(part @ (other - far), kind="stable")
                x[a:b], size[a:b], self.order[a:b] = part[side], square[side], self.order[a:b][side]
                half = (a + b) // 2
                self.children[node] = (add(a, half), add(half, b))
            return node

        add(0, len(rows))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(nodes x queries): what no document of the node scores more than. queries: terms by queries, ones and zeros."""
        centroids = np.array(self.centroids)
        ball = centroids @ queries + np.outer(self.radii, np.sqrt(queries.sum(axis=0)))
        by_term = (centroids + np.array(self.spread)) @ queries
        return np.floor(np.minimum(ball, by_term) * (1 + SLACK)) + 1

    def search(self, bounds: np.ndarray, terms: np.ndarray, k: int, best: list, ids: list, number: int) -> int:
        """Improve ``best``, a heap of (score, place before others, id); returns how many documents were scored."""
        queue, scored = [(-bounds[0], 0)], 0
        while queue:
            bound, node = heapq.heappop(queue)
            if len(best) == k and -bound < best[0][0]:
                break
            pair = self.children[node]
            if pair:
                for child in pair:
                    if len(best) < k or bounds[child] >= best[0][0]:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            of = self.order[slice(*self.members[node])]
            scores = self.rows[np.ix_(of, terms)].sum(axis=1)
            scored += len(of)
            for row in np.flatnonzero(scores > 0).tolist() if len(best) < k else np.flatnonzero(scores >= best[0][0]).tolist():
                if scores[row] <= 0:
                    continue
                doc = ids[int(of[row])]
                # a heap's first is the worst: lowest score, then largest id, null the largest of all
                entry = (int(scores[row]), _Last(doc), number + int(of[row]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


class _Last:
    """Ids in descending order, null first."""

    __slots__ = ("id",)

    def __init__(self, id_):
        self.id = id_

    def __lt__(self, other: _Last) -> bool:
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return self.id > other.id

    def __eq__(self, other: object) -> bool:
        return self.id == other.id


def _counted(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, numbers, counts, ends = [], [], [], [0]
                for text in large_texts(part.column("text")):
                    terms = terms_of(text)
                    of = Counter(map(vocabulary.get, terms))
                    of.pop(None, None)
                    n.append(len(terms))
                    numbers += of.keys()
                    counts += of.values()
                    ends.append(len(numbers))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((numbers, pa.int32()), (counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tf"])

    return run


def _ranked(items: list[np.ndarray], weights: np.ndarray, total: int, length: int, k: int):
    """Every task's best documents of each item, and what it took to find them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms = len(weights)
        best: list[list] = [[] for _ in items]
        scored = np.zeros(len(items), np.int64)
        documents, kind = 0, None
        for batch in batches:
            kind = batch.column("id").type
            for first in range(0, batch.num_rows, TREE):
                part = batch.slice(first, TREE)
                lists = part.column("terms")
                sizes = np.diff(np.asarray(lists.offsets))
                cols = np.asarray(lists.flatten()).astype(np.int64)
                tf = np.asarray(part.column("tf").flatten())
                n = np.asarray(part.column("n"))
                m = 10 + (90 * n * total) // max(1, length)
                row = np.repeat(np.arange(part.num_rows), sizes)
                # the terms of this tree's documents: other queries' terms take no room
                used, at = np.unique(cols, return_inverse=True)
                vectors = np.zeros((part.num_rows, len(used)), np.int64)
                vectors[row, at] = weights[cols] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                place = np.full(n_terms, -1)
                place[used] = np.arange(len(used))
                mine = [place[t][place[t] >= 0] for t in items]
                ids = part.column("id").to_pylist()
                asked = [i for i, t in enumerate(mine) if len(t)]
                documents += part.num_rows
                if not asked:
                    continue
                queries = np.zeros((len(used), len(asked)))
                for c, i in enumerate(asked):
                    queries[mine[i], c] = 1.0
                tree = Tree(vectors)
                bounds = tree.bounds(queries)
                for c, i in enumerate(asked):
                    scored[i] += tree.search(bounds[:, c], mine[i], k, best[i], ids, documents)
        if kind is None:
            return
        rows = [(i, doc.id, score) for i, heap in enumerate(best) for score, doc, _ in heap]
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())]
        blank = [pa.nulls(len(rows), pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([*columns, *blank], ["query", "id", "score", "scored", "documents"])
        work = [pa.array(range(len(items)), pa.int32()), pa.nulls(len(items), kind), pa.nulls(len(items), pa.int64()), pa.array(scored), pa.array([documents] * len(items), pa.int64())]
        yield pa.RecordBatch.from_arrays(work, ["query", "id", "score", "scored", "documents"])

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(id, its terms) of the queries, a bounded number at a time."""
    block, terms = [], set()
    for row in items.toLocalIterator():
        own = set(terms_of((row["text"] or "").encode()))
        if block and (len(block) == ITEMS or len(terms | own) > TERMS):
            yield block
            block, terms = [], set()
        if own:
            block.append((row["id"], own))
            terms |= own
    if block:
        yield block


class Ranking:
    """What a search found. ``rows``: item id, rank, document id, score. ``work``: for each item of a block how many documents were scored, of how many."""

    def __init__(self, rows: DataFrame, work: DataFrame):
        self.rows, self.work = rows, work


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> Ranking:
    """The ``k`` highest-scoring documents of each item, scores above 0 only."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "ball-search")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))
    queries = items.select(F.col(f"`{item_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))
    id_type, item_type = source.schema["id"].dataType, queries.schema["id"].dataType
    counted = T.StructType([T.StructField("id", id_type)]).add("n", "long").add("terms", T.ArrayType(T.IntegerType())).add("tf", T.ArrayType(T.LongType()))
    ranked = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.LongType()), T.StructField("scored", T.LongType()), T.StructField("documents", T.LongType())])
    found, work = [], []
    for b, block in enumerate(_blocks(queries)):
        numbers = {t: i for i, t in enumerate(sorted(set().union(*(own for _, own in block))))}
        vectors = scratch.save(source.mapInArrow(_counted(numbers), counted), f"terms-{b}")
        total, length = vectors.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = np.zeros(len(numbers), np.int64)
        # a row per term of the block
        for term, df in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
            frequency[term] = df
        weights = np.array([weight(total, int(df)) for df in frequency], np.int64)
        terms = [np.array(sorted(numbers[t] for t in own)) for _, own in block]
        best = scratch.save(vectors.mapInArrow(_ranked(terms, weights, total, length, k), ranked), f"best-{b}")
        names = spark.createDataFrame([(i, row[0]) for i, row in enumerate(block)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item", item_type)]))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id")))
        top = best.filter("score IS NOT NULL").withColumn("rank", place).filter(F.col("rank") <= k)
        found.append(top.join(F.broadcast(names), "query").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
        work.append(best.filter("scored IS NOT NULL").groupBy("query").agg(F.sum("scored").alias("scored"), F.sum("documents").alias("documents")).join(F.broadcast(names), "query").select(F.col("item").alias(item_col), "scored", "documents"))
    if not found:
        empty = spark.createDataFrame([], T.StructType([T.StructField(item_col, item_type), T.StructField("rank", T.IntegerType()), T.StructField(id_col, id_type), T.StructField("score", T.LongType())]))
        return Ranking(empty, empty.select(item_col, F.col("score").alias("scored"), F.col("score").alias("documents")))
    for i in range(1, len(found)):
        found[0], work[0] = found[0].unionByName(found[i]), work[0].unionByName(work[i])
    return Ranking(found[0], work[0])
