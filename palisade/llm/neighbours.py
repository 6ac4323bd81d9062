"""Approximate nearest neighbours with a forest of hash prefixes.

Each tree gives every vector a long string of bits (sides of random planes) and keeps the vectors in
order of it. A query descends to the places where its own string would stand and ascends in all trees
at once, to shorter and shorter common prefixes, until the entries under its prefixes are enough;
those are compared exactly. A table of the number of entries under every short prefix, of fixed size,
tells in advance how far each query has to ascend, so it is sent only to the cells of the trees that
it will read. A cell is a stretch of a tree's order; one with many entries is cut into parts. Where
even the table's longest prefixes hold more than enough, a query descends on in the cell's sorted codes.

Cosines that agree to 12 digits tie, and ties go to the smaller id, however many there are.

Equal vectors are one entry; each keeps its smallest ids, as many as a result can hold. Vectors that
are null, zero, of another than the most common dimension, or that hold null or non-finite components
take no part. Repeated rows count once. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm._shared import Scratch

#: Bits of a hash string, and how many of its first bits the table of counts covers.
BITS, COUNTED = 48, 12
#: Entries of a cell, and rows compared at once.
CELL = 4096
#: Digits to which cosines are compared, so that vectors of one direction tie whatever their lengths.
DIGITS = 12


def usable(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v array<double>) of the vectors that take part, and their dimension."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0.0)
    rows = df.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & ~zero)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = sizes["n"] if sizes else 0
    return rows.filter(F.size("v") == dims).distinct(), dims


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


class Trees:
    """Random planes through the mean of a bounded sample, the same for every run."""

    def __init__(self, count: int, dims: int, mean: np.ndarray, seed: int = 11):
        self.planes = np.random.default_rng(seed).normal(size=(dims, count * BITS))
        self.count, self.mean = count, mean

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(n, trees) strings of bits as integers, the first bit highest."""
        side = ((x / np.linalg.norm(x, axis=1, keepdims=True) - self.mean) @ self.planes > 0).reshape(len(x), self.count, BITS)
        return side.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


class Counts:
    """How many entries each tree has under each prefix of up to COUNTED bits."""

    def __init__(self, leaves: np.ndarray):
        self.levels = [leaves]
        while self.levels[0].shape[1] > 1:
            self.levels.insert(0, self.levels[0].reshape(len(leaves), -1, 2).sum(axis=2))

    def ascend(self, codes: np.ndarray, enough: int) -> np.ndarray:
        """The longest prefix, in bits, under which all trees together have enough entries; 0 if none has."""
        trees, out = np.arange(codes.shape[1]), np.zeros(len(codes), np.int64)
        for bits in range(1, COUNTED + 1):
            out[self.levels[bits][trees, codes >> (BITS - bits)].sum(axis=1) >= enough] = bits
        return out


def _send(trees: Trees, counts: Counts, depth: int, dims: int, enough: int | None):
    """Entries (enough None) or queries to the rows of the cells that they belong to or read."""
    parts = -(-counts.levels[depth] // CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x, ids = matrix(part.column("v"), dims), part.column("id").to_numpy()
                codes = trees.codes(x)
                level = np.full(len(x), depth) if enough is None else counts.ascend(codes, enough)
                rows = []
                for t in range(trees.count):
                    for i, (code, bits) in enumerate(zip(codes[:, t].tolist(), level.tolist())):
                        low = code >> (BITS - min(bits, depth)) << max(0, depth - bits)
                        for cell in range(low, low + (1 << max(0, depth - bits))):
                            n = int(parts[t, cell])
                            own = range(n) if enough is not None else [int(ids[i]) % n]
                            rows += [(t, cell, p, i, code, bits) for p in own]
                if not rows:
                    continue
                tree, cell, p, i, code, bits = map(np.array, zip(*rows))
                for a in range(0, len(i), 4096):
                    s = slice(a, a + 4096)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tree[s].astype(np.int32)), pa.array(cell[s].astype(np.int32)), pa.array(p[s].astype(np.int32)), pa.array(np.full(len(i[s]), enough is not None)), pa.array(code[s]), pa.array(bits[s].astype(np.int32)), pa.array(ids[i[s]]), part.column("v").take(pa.array(i[s]))],
                        ["tree", "cell", "part", "asks", "code", "bits", "id", "v"],
                    )

    return run


def reach(codes: np.ndarray, code: np.ndarray, bits: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """From where to where in the sorted codes each query reads.

    bits: the prefix that it ascends to, by the table of counts. At the table's last level it descends
    on, to the longest prefix that it shares with ``need`` codes.
    """
    shift = BITS - bits
    lo, hi = np.searchsorted(codes, code >> shift << shift), np.searchsorted(codes, ((code >> shift) + 1) << shift)
    open_ = np.flatnonzero(bits == COUNTED)
    for b in range(BITS, COUNTED, -1):
        if not len(open_):
            break
        low = code[open_] >> (BITS - b) << (BITS - b)
        l, h = np.searchsorted(codes, low), np.searchsorted(codes, low + (1 << (BITS - b)))
        ok = h - l >= need
        lo[open_[ok]], hi[open_[ok]] = l[ok], h[ok]
        open_ = open_[~ok]
    return lo, hi


def _compare(dims: int, k: int, need: int):
    """Sorted entries and queries of cells to each query's best ``k`` entries there; of equal cosines those with the smaller ids."""

    def best(codes, ids, x, batch: pa.RecordBatch) -> pa.RecordBatch:
        q, asked = matrix(batch.column("v"), dims), batch.column("id").to_numpy()
        # a prefix shorter than the cells' holds every cell that the query was sent to, the siblings of its own too
        lo, hi = reach(codes, batch.column("code").to_numpy(), batch.column("bits").to_numpy().astype(np.int64), need)
        near = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
        at = np.arange(len(codes))
        near[(at < lo[:, None]) | (at >= hi[:, None])] = -np.inf
        last = -np.partition(-near, min(k, len(codes)) - 1, axis=1)[:, min(k, len(codes)) - 1]
        # all that may tie with the last one, however many; then in the order of the result, of which only k can count
        row, top = np.nonzero((near >= last[:, None] - 10.0 ** (3 - DIGITS)) & np.isfinite(near))
        score = np.concatenate([np.zeros(0), *(
            (q[r] * x[t]).sum(axis=1) / (np.sqrt((q[r] ** 2).sum(axis=1)) * np.sqrt((x[t] ** 2).sum(axis=1))) for r, t in ((row[i : i + CELL], top[i : i + CELL]) for i in range(0, len(row), CELL))
        )])
        order = np.lexsort((ids[top], -np.round(score, DIGITS), row))
        row, top, score = row[order], top[order], score[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, top, score = row[first], top[first], score[first]
        return pa.RecordBatch.from_arrays([pa.array(asked[row]), pa.array(ids[top]), pa.array(score)], ["query", "entry", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, ids, x = None, [], [], []
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tree", "cell", "part", "asks")], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(where, axis=0) != 0).any(axis=1)) + 1).tolist(), len(where)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now != (cell := tuple(where[a, :3])):
                    now, codes, ids, x = cell, [], [], []
                part = batch.slice(a, b - a)
                if not where[a, 3]:
                    codes.append(part.column("code").to_numpy())
                    ids.append(part.column("id").to_numpy())
                    x.append(matrix(part.column("v"), dims))
                elif codes:
                    codes, ids, x = [np.concatenate(codes)], [np.concatenate(ids)], [np.concatenate(x)]
                    for at in range(0, b - a, 256):
                        yield best(codes[0], ids[0], x[0], part.slice(at, 256))

    return run


def nearest(df: DataFrame, asks: Column, k: int = 5, trees: int = 24, share: float = 1.0, sample: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest cosines found for every row for which ``asks`` holds.

    A query does not find itself; ties go to the smaller id. A query ascends until the trees together
    have ``share`` times the number of vectors under its prefixes; vectors without structure, whose
    neighbours are hardly nearer than others, need about 1 for a recall over 0.9. The planes go
    through the mean of at most ``sample`` vectors, picked by a hash; every vector is indexed.
    """
    scratch = Scratch(df.sparkSession, "neighbours")
    rows, dims = usable(df, id_col, vector_col)
    rows = scratch.save(rows, "vectors")
    order = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    entries = scratch.save(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).select(F.col("members")[0].alias("id"), "v", "members"), "entries")
    n = entries.count()
    queries = rows.join(df.filter(asks).select(F.col(id_col).alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = scratch.save(queries.groupBy("v").agg(F.min("vec_id").alias("id")), "asked")
    if not n:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    some = np.array([r["v"] for r in entries.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()])
    forest = Trees(trees, dims, (some / np.linalg.norm(some, axis=1, keepdims=True)).mean(axis=0))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, 1 << COUNTED), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CELL):
                np.add.at(total, (np.arange(trees), forest.codes(matrix(batch.column("v").slice(at, CELL), dims)) >> (BITS - COUNTED)), 1)
        t, leaf = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(total[t, leaf])], ["tree", "leaf", "n"])

    # at most trees * 2 ** COUNTED rows, however many vectors there are
    total = np.zeros((trees, 1 << COUNTED), np.int64)
    for r in entries.select("v").mapInArrow(leaves, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        total[r["tree"], r["leaf"]] = r["n"]
    counts, depth = Counts(total), min(COUNTED, max(0, (n // CELL).bit_length()))
    enough = min(trees * n, max(trees * (k + 1), int(share * n)))
    nearest_first = [F.desc(F.round("score", DIGITS)), F.col("entry")]
    schema = "tree int, cell int, part int, asks boolean, code long, bits int, id long, v array<double>"
    sent = entries.select(F.col("id").cast("long"), "v").mapInArrow(_send(forest, counts, depth, dims, None), schema)
    sent = sent.unionByName(asked.select(F.col("id").cast("long"), "v").mapInArrow(_send(forest, counts, depth, dims, enough), schema))
    cell = ["tree", "cell", "part"]
    found = sent.repartition(*cell).sortWithinPartitions(*cell, "asks", "code").mapInArrow(_compare(dims, k + 1, -(-enough // trees)), "query long, entry long, score double")
    best = found.groupBy("query", "entry").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query")
    best = best.withColumn("r", F.row_number().over(w.orderBy(*nearest_first))).filter(F.col("r") <= k + 1)
    best = scratch.save(best.select("query", "entry", "score"), "best")
    ids = best.join(entries.select(F.col("id").alias("entry"), "members"), "entry").select("query", "score", F.explode("members").alias("vec_id"))
    ids = ids.withColumn("r", F.row_number().over(w.orderBy(F.desc(F.round("score", DIGITS)), "vec_id"))).filter(F.col("r") <= k + 1)
    ids = scratch.save(ids.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found")), "found")
    same = scratch.save(queries.join(asked, "v").select(F.col("vec_id").alias("query_id"), F.col("id").alias("query")), "same")
    others = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    out = same.join(ids, "query").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
