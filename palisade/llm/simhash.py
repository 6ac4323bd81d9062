"""SimHash near-duplicates: fingerprints, linked when few bits differ, grouped by connection.

Fingerprints that differ in at most ``radius`` bits of 64 agree on one of ``radius + 1`` blocks of
bits (or, with more blocks, on several at once), so every link is found among fingerprints that
share a key of that kind. ``keep_one`` finds its pairs in the same way, by fingerprints of 256 bits and
keys of random bits; within what such pairs connect, tasks decide pairs by the shingle sets themselves.

Within a key the comparison is bit-sliced: 64 fingerprints are stored as one word per bit; XOR with
the query's bit gives 64 difference bits at once, which go into carry-save counters one bit wide
each; a block of 64 is abandoned once all its counters exceed the radius.

Equal fingerprints are one node. Keys with many fingerprints are cut into chunks and compared chunk
against chunk in separate tasks; each task returns only what each fingerprint leads to, the smallest
of those it connects, so that different keys tend to give the same links.
Nothing is capped: every pair that shares a key and is within the radius ends up connected.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm._shared import Scratch, int_lists, quoted, mix, slices
from palisade.llm.components import components, contracted

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: 64-bit words of the fingerprints by which ``keep_one`` looks for pairs.
WORDS = 4
FPS = [f"fp{w}" for w in range(WORDS)]


def fingerprint(text: bytes, size: int = 4, seed: int = 42, words: int = 1) -> bytes:
    """Majority bits of XXH64 over the shingles of ``size`` lower-cased words, most significant first; zeros if there are no words.

    words: the first 64 bits are those of the hash itself, further ones those of the hash mixed again.
    """
    split = text.lower().split()
    if not split:
        return bytes(8 * words)
    shingles = [b" ".join(split)] if len(split) < size else [b" ".join(s) for s in zip(*(split[i:] for i in range(size)))]
    digest = xxhash.xxh64_digest
    return majority(np.frombuffer(b"".join([digest(s, seed) for s in shingles]), ">u8").astype(np.uint64), words)


def majority(hashes: np.ndarray, words: int = 1) -> bytes:
    """The bits that over half the hashes have; zeros if there are none."""
    counts = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        for w in range(words):
            if w:
                part = part * np.uint64(0x9E3779B97F4A7C15)
                part = part ^ (part >> np.uint64(29))
            counts[w] += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, words: int = 1) -> DataFrame:
    """(id, fp0, fp1, ... long): one row per row of ``df``; a null or blank text has fingerprint 0."""
    names = [f"fp{w}" for w in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(text_col).cast(pa.binary()).to_pylist()
                fps = np.frombuffer(b"".join([fingerprint(t or b"", size, words=words) for t in texts]), ">i8").reshape(-1, words).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(id_col), *(pa.array(fps[:, w]) for w in range(words))], [id_col, *names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'{n} long' for n in names)}")


def planes(fps: np.ndarray) -> np.ndarray:
    """Vertical bit planes: fingerprints (64 n, words) to (n, 64 words), one word for each bit of 64 fingerprints."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 64, 8 * fps.shape[1]), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64).reshape(-1, 64 * fps.shape[1])


def close(word: np.ndarray, queries: np.ndarray, block: np.ndarray, valid: np.ndarray, radius: int, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which comparisons of a query with a block of 64 have lanes within the radius; (index, lanes as bits).

    word: planes of the blocks. queries, block: the fingerprint (words) and the block's number for
    each comparison. Counters are as many carry-save bits as the radius needs; a lane whose counter
    overflows or exceeds the radius is over for good, and a comparison whose lanes are all over is dropped.
    """
    width = (radius + 1).bit_length()
    alive = np.arange(len(queries))
    over = ~valid[block]
    count = [np.zeros(len(queries), np.uint64) for _ in range(width)]
    q, b = queries, block
    for step, bit in enumerate(order):
        carry = word[b, bit] ^ (np.uint64(0) - ((q[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)))
        for k in range(width):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over = over | carry
        if step % 8 == 7 and step > radius or step == len(order) - 1:
            # lanes with a count above the radius: compare from the highest counter bit down
            above, equal = np.zeros_like(over), np.full_like(over, ONES)
            for k in range(width - 1, -1, -1):
                if radius >> k & 1:
                    equal = equal & count[k]
                else:
                    above = above | (equal & count[k])
                    equal = equal & ~count[k]
            over = over | above
            stay = over != ONES
            if not stay.all():
                alive, over, q, b, count = alive[stay], over[stay], q[stay], b[stay], [c[stay] for c in count]
            if not len(alive):
                break
    return alive, ~over


def _root(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join i and j in ``parent``, for whole arrays of links; returns which links did so, a spanning forest."""
    chosen, at = [np.zeros(0, np.int64)], np.arange(len(i))
    while len(at):
        a, b = parent[i[at]], parent[j[at]]
        apart = a != b
        at, high, low = at[apart], np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        high, first = np.unique(high, return_index=True)
        parent[high] = low[first]
        chosen.append(at[first])
        while len(at):
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
    return np.concatenate(chosen)


def group_links(
    group: np.ndarray, fps: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, order: list[int], may: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """What the links between left and right members of each group connect, as row numbers: each row and the first that it leads to.

    group: group numbers, ascending. left, right: whether a row is compared as a query, and whether
    it is compared against. may: whether two close rows are linked, asked in order of the first, and not for rows that are connected already.
    """
    parent = np.arange(len(fps))
    lane_of = np.flatnonzero(right)
    starts = np.flatnonzero(np.diff(group[lane_of], prepend=-1))
    # blocks of 64 lanes that do not cross groups
    sizes = np.diff(np.append(starts, len(lane_of)))
    blocks = -(-sizes // 64)
    first = np.cumsum(blocks) - blocks
    slot = (np.repeat(first, sizes) * 64 + np.arange(len(lane_of)) - np.repeat(starts, sizes)) if len(lane_of) else lane_of
    n = int(blocks.sum())
    padded, owner, valid = np.zeros((n * 64, fps.shape[1]), np.uint64), np.full(n * 64, -1), np.zeros(n * 64, bool)
    padded[slot], owner[slot], valid[slot] = fps[lane_of], lane_of, True
    word = planes(padded)
    lanes = np.packbits(valid.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
    group_first, group_blocks = dict(zip(group[lane_of[starts]].tolist(), first.tolist())), dict(zip(group[lane_of[starts]].tolist(), blocks.tolist()))
    asks = np.flatnonzero(left)
    begin = np.array([group_first.get(g, 0) for g in group[asks].tolist()], np.int64)
    many = np.array([group_blocks.get(g, 0) for g in group[asks].tolist()], np.int64)
    if len(asks):
        # a lane of the same side is met from one end only: blocks before the asking row's own are left out
        own = np.full(len(fps), -1)
        own[lane_of] = slot // 64 if n else 0
        skip = np.where(own[asks] >= 0, own[asks] - begin, 0)
        begin, many = begin + skip, many - skip
    total = np.cumsum(many)
    at = 0
    while at < len(asks):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 16), "right")))
        m = many[at:end]
        who = np.repeat(asks[at:end], m)
        block = np.repeat(begin[at:end] - (np.cumsum(m) - m), m) + np.arange(len(who))
        found, bits = close(word, fps[who], block, lanes, radius, order)
        if len(found):
            row, lane = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, j = who[found[row]], owner[block[found[row]] * 64 + lane]
            size = 1 << 10
            while len(i):
                apart = parent[i] != parent[j]
                i, j = i[apart], j[apart]
                x, y, i, j = i[:size], j[:size], i[size:], j[size:]
                if may is not None:
                    ok = may(x, y)
                    x, y = x[ok], y[ok]
                _root(parent, x, y)
                size *= 2
        at = end
    led = np.flatnonzero(parent != np.arange(len(parent)))
    return led, parent[led]


def block_keys(radius: int, blocks: int) -> list[list[int]]:
    """Choices of bits of which every two words within the radius share one: all but ``radius`` of the blocks.

    More blocks mean more but longer keys, as larger tables want.
    """
    if blocks <= radius:
        raise ValueError("blocks must exceed the radius")
    cut = [range(64 * i // blocks, 64 * (i + 1) // blocks) for i in range(blocks)]
    return [[b for r in pick for b in r] for pick in combinations(cut, blocks - radius)]


def enough_blocks(nodes: int, radius: int, most: int = 4096) -> int:
    """Blocks for which a key holds at most ``most`` of so many nodes on average, so that comparisons grow with the nodes and not with their square."""
    blocks = radius + 1
    while nodes >> (64 // blocks * (blocks - radius)) > most:
        blocks += 1
    return blocks


@dataclass(frozen=True)
class Search:
    """Links of at most ``radius`` bits among nodes that share a key; a key has the bits of one of the choices. least, most: only for nodes of such sizes n."""

    choices: list[list[int]]
    radius: int
    least: int = 0
    most: int | None = None

    def keys(self, fps: np.ndarray, number: int) -> Iterator[np.ndarray]:
        """For each choice the fingerprints' keys; the last two bits are the search's number."""
        for i, bits in enumerate(self.choices):
            out = np.full(len(fps), mix(np.array([4 * i + number], np.uint64))[0])
            for w in range(fps.shape[1]):
                mask = sum(1 << b % 64 for b in bits if b // 64 == w)
                if mask:
                    out = mix(out ^ (fps[:, w] & np.uint64(mask)))
            yield (out & ~np.uint64(3)) | np.uint64(number)


#: Rows with equal values of these are compared with each other.
CELL = ["key", "cell"]


def _cells(rows: DataFrame, large: DataFrame, chunk: int) -> DataFrame:
    """``rows`` with the cells in which they are compared; ``large``: the keys with more than a chunk, and how many rows they have.

    A row meets its own chunk and each other one once; of two chunks the lower asks and the higher is compared against.
    """
    if large.isEmpty():
        return rows.withColumns({"cell": F.lit(0).cast("long"), "higher": F.lit(False), "both": F.lit(True)})
    own, other = F.col("mine"), F.col("other")
    cut = rows.join(large, "key", "left").withColumn("parts", F.ceil(F.coalesce("held", F.lit(1)) / chunk).cast("int"))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.shiftleft(F.least(own, other).cast("long"), 32).bitwiseOR(F.greatest(own, other).cast("long"))
    return cut.withColumns({"cell": cell, "higher": own > other, "both": own == other}).drop("held", "parts", "mine", "other")


def _by_cell(rows: DataFrame, compare: Callable[[pa.Table], pa.RecordBatch], enough: int, bytes_: int = 64 << 20) -> DataFrame:
    """(u, v): what ``compare`` makes of whole cells, of some ``enough`` rows or so many bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < enough and sum(b.nbytes for b in held) < bytes_:
                continue
            table = pa.Table.from_batches(held)
            last = np.any([table.column(c).to_numpy() != table.column(c)[-1].as_py() for c in CELL], axis=0)
            end = len(last) - int(np.argmax(last[::-1])) if last.any() else 0  # the last cell may go on
            if end:
                yield compare(table.slice(0, end))
            held = table.slice(end).to_batches()
        if held and sum(b.num_rows for b in held):
            yield compare(pa.Table.from_batches(held))

    return rows.repartition(*CELL).sortWithinPartitions(*CELL, "node").mapInArrow(run, "u long, v long")


def near_links(nodes: DataFrame, searches: list[Search], words: int = 1, chunk: int = 2048, share: tuple[int, int] | None = None) -> DataFrame:
    """(u, v): links between nodes (node long, fp0, fp1, ...) whose components are those of all pairs that up to four searches look for.

    chunk: so many nodes of a key one task compares with as many others. share: sets of sizes n (a
    column) so different that no such share of them can be common are not linked.
    """
    scratch = Scratch(nodes.sparkSession, "simhash-keys")
    names = [f"fp{w}" for w in range(words)]
    more = [c for c in ("n",) if c in nodes.columns]
    kinds = {"node": "long", **{n: "long" for n in names}, "n": "int"}

    def keyed(columns: list[str]) -> DataFrame:
        """key and the columns, a row for each node and choice."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    fps = np.stack([part.column(n).to_numpy() for n in names], axis=1).view(np.uint64)
                    for number, search in enumerate(searches):
                        rows = np.arange(len(fps))
                        if "n" in more:
                            n = part.column("n").to_numpy()
                            rows = np.flatnonzero((n >= search.least) & (n <= (search.most or n.max())))
                        if not len(rows):
                            continue
                        held = [part.column(c).take(pa.array(rows)) for c in columns]
                        for key in search.keys(fps[rows], number):
                            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *held], ["key", *columns])

        return nodes.select("node", *names, *more).mapInArrow(run, ", ".join(["key long", *(f"{c} {kinds[c]}" for c in columns)]))

    # only keys with more than a chunk are cut; there are at most rows / chunk of them
    large = scratch.save(keyed([]).groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > chunk), "large")
    rows = _cells(keyed(["node", *names, *more]), large, chunk)
    order = list(range(64 * words))

    def compare(table: pa.Table) -> pa.RecordBatch:
        cols = {c: table.column(c).to_numpy() for c in (*CELL, "higher", "both", "node", *names, *more)}
        fp = np.stack([cols[n] for n in names], axis=1).view(np.uint64)
        group = np.cumsum(np.any([np.diff(cols[c], prepend=cols[c][:1]) != 0 for c in CELL], axis=0))
        company = np.bincount(group)[group] > 1
        out = []
        for number, search in enumerate(searches):
            s = np.flatnonzero(company & (cols["key"] & 3 == number))

            def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                ok = np.ones(len(i), bool)
                if share:
                    x, y = cols["n"][s[i]].astype(np.int64), cols["n"][s[j]].astype(np.int64)  # noqa: B023
                    ok &= np.minimum(x, y) * share[1] >= np.maximum(x, y) * share[0]
                return ok

            u, v = group_links(group[s], fp[s], cols["both"][s] | ~cols["higher"][s], cols["both"][s] | cols["higher"][s], search.radius, order, may)
            out.append(np.stack([cols["node"][s[u]], cols["node"][s[v]]]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], ["u", "v"])

    return _by_cell(rows, compare, 8 * chunk)


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id that links lead to, the document's own included.

    Null and blank texts have fingerprint 0 and link like any other. Rows with equal ids are separate
    rows of one document; null ids never are a component_id unless all ids of a component are null.
    Extra columns are ignored; an empty table gives an empty result. blocks: of bits, by default as
    many as the number of distinct fingerprints asks for; the result is the same for any number.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    fps = scratch.save(fingerprints(df, id_col, text_col, size), "fingerprints")
    nodes = scratch.save(fps.groupBy("fp0").agg(F.min(id_col).alias("least")).withColumn("node", F.col("fp0")), "nodes")
    choices = block_keys(radius, blocks or enough_blocks(nodes.count(), radius))
    roots = scratch.save(components(contracted(near_links(nodes.select("node", "fp0"), [Search(choices, radius)])), scratch), "roots")
    joined = scratch.save(nodes.join(roots, "node", "left").select("fp0", F.coalesce("root", "node").alias("root"), "least"), "joined")
    named = scratch.save(joined.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    labels = scratch.save(joined.join(named, "root").select("fp0", "component_id"), "labels")
    return fps.join(labels, "fp0").select(id_col, F.col("fp0").alias("fp"), "component_id")


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of the distinct shingles of ``size`` lower-cased words, ascending. A text of fewer words is one shingle; a blank text has none."""
    split = text.lower().split()
    if not split:
        return np.zeros(0, np.int64)
    shingles = {b" ".join(split)} if len(split) < size else {b" ".join(s) for s in zip(*(split[i:] for i in range(size)))}
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles)), ">i8").astype("<i8"))


def set_nodes(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, node, n, fp0 to fp3): a hash of the text's shingle set, the set's size, and its fingerprint of 256 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                sets = [shingle_hashes(t or b"", size) for t in part.column(text_col).cast(pa.binary()).to_pylist()]
                fps = np.frombuffer(b"".join([majority(x.view(np.uint64), WORDS) for x in sets]), ">i8").reshape(-1, WORDS).astype(np.int64)
                nodes = np.frombuffer(b"".join([xxhash.xxh64_digest(x.tobytes()) for x in sets]), ">i8").astype(np.int64)
                columns = [part.column(id_col), pa.array(nodes), pa.array(np.array(list(map(len, sets)), np.int32)), *(pa.array(np.ascontiguousarray(fps[:, w])) for w in range(WORDS))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "node", "n", *FPS])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, node long, n int, {', '.join(f'{c} long' for c in FPS)}")


def shingle_sets(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """(node, shingles array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                sets = [shingle_hashes(t or b"", size).tobytes() for t in part.column(text_col).cast(pa.binary()).to_pylist()]
                nodes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, sets)), ">i8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), int_lists(sets, "<i8")], ["node", "shingles"])

    return df.select(text_col).mapInArrow(run, "node long, shingles array<long>")


@dataclass(frozen=True)
class Reach:
    """How pairs of sets of some sizes are looked for: with bits that agree by the chance ``agree`` at the threshold, up to ``radius`` bits of 256 apart."""

    least: int
    most: int | None
    agree: float
    radius: int

    def keys(self, nodes: int, missed: float = 0.001, held: int = 1024, seed: int = 7) -> list[list[int]]:
        """Choices of random bits, longer ones for more nodes, so that a key holds some ``held`` of them; so many that a pair at the threshold is missed by the chance ``missed`` at most."""
        bits, all_ = max(14, (nodes // held).bit_length()), 64 * WORDS
        apart = np.arange(self.radius + 1)
        chance = np.array([math.comb(all_, d) * (1 - self.agree) ** d * self.agree ** (all_ - d) for d in apart])
        count = 1
        while 1 - chance.sum() + (chance * (1 - (1 - apart / all_) ** bits) ** count).sum() > missed:
            count += 1
        rng = np.random.default_rng(seed)
        return [sorted(rng.choice(all_, bits, replace=False).tolist()) for _ in range(count)]


#: Bits of two sets with a similarity of 0.8 or more differ by the chance 0.154 at most, from about 50 shingles on (39 of 256, give or take 6).
#: Of fewer they may differ more often: by 0.161 for 12 of 13 and 14, and by 0.188 for 4 of 4 and 5, all counted out. Pairs at the borders of sizes are met in both ways.
REACHES = (Reach(1, 5, 0.812, 74), Reach(4, 62, 0.838, 66), Reach(50, None, 0.846, 64))


def similar_links(members: DataFrame, share: tuple[int, int], chunk: int = 512) -> DataFrame:
    """(u, v): links between similar members (key, node, n, fp0 to fp3, shingles) of each key whose components are those of all its similar pairs within REACHES.

    Pairs are decided where they are compared, by their whole sets; no more than a link a row leaves a task.
    """
    scratch = Scratch(members.sparkSession, "simhash-similar")
    a, b = share
    large = scratch.save(members.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > chunk), "large")
    order = list(range(64 * WORDS))

    def compare(table: pa.Table) -> pa.RecordBatch:
        cols = {c: table.column(c).to_numpy() for c in (*CELL, "higher", "both", "node", "n", *FPS)}
        fp = np.stack([cols[c] for c in FPS], axis=1).view(np.uint64)
        group = np.cumsum(np.any([np.diff(cols[c], prepend=cols[c][:1]) != 0 for c in CELL], axis=0))
        lists = table.column("shingles").combine_chunks()
        edge, values, n = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(), cols["n"].astype(np.int64)
        out = [np.zeros((2, 0), np.int64)]
        for reach in REACHES:
            s = np.flatnonzero((n >= reach.least) & (n <= (reach.most or n.max())))

            def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                i, j = s[i], s[j]  # noqa: B023
                ok = np.minimum(n[i], n[j]) * b >= np.maximum(n[i], n[j]) * a
                at = np.flatnonzero(ok)
                for part in np.split(at, np.flatnonzero(np.diff(i[at])) + 1) if len(at) else []:
                    one, others = i[part[0]], j[part]
                    x, y = values[edge[one] : edge[one + 1]], np.concatenate([values[edge[k] : edge[k + 1]] for k in others.tolist()])
                    held = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                    common = np.add.reduceat(held.astype(np.int64), np.cumsum(n[others]) - n[others])
                    ok[part] = common * (a + b) >= a * (n[one] + n[others])
                return ok

            u, v = group_links(group[s], fp[s], cols["both"][s] | ~cols["higher"][s], cols["both"][s] | cols["higher"][s], reach.radius, order, may)
            out.append(np.stack([cols["node"][s[u]], cols["node"][s[v]]]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], ["u", "v"])

    return _by_cell(_cells(members, large, chunk), compare, 8 * chunk)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their group of similar texts; a null id stays, as nothing names it.

    Texts are similar if the Jaccard similarity of their shingle sets is at least ``share``, a
    fraction; groups are connected by similar pairs. Pairs are found by fingerprints within a radius
    that share one of some keys (see REACHES: one pair in a thousand at the threshold is missed, fewer
    above it). What the close fingerprints connect is compared once more, in
    chunks, and pairs are decided by their whole sets (of 64-bit hashes), so no others are linked.
    Texts of equal sets are one node. Extra columns come back as they were; an empty table gives an
    empty result.
    """
    scratch = Scratch(df.sparkSession, "simhash-keep")
    known = df.filter(F.col(id_col).isNotNull())
    sets = scratch.save(set_nodes(known, id_col, text_col, size), "sets")
    nodes = scratch.save(sets.filter("n > 0").groupBy("node", "n", *FPS).agg(F.min(id_col).alias("one")), "nodes")
    total = nodes.count()

    searches = [Search(r.keys(total), r.radius, r.least, r.most) for r in REACHES]
    forest = contracted(near_links(nodes.drop("one"), searches, WORDS, share=share))
    close = scratch.save(components(scratch.save(forest, "forest"), scratch), "close")
    scratch.release()
    members = scratch.save(nodes.join(close.withColumnRenamed("root", "key"), "node"), "members")
    # one text of each member is read again; while the members' table is small, the texts are not shuffled
    texts = known.select(id_col, F.col(text_col).cast("string").alias("_text")).join(members.select(F.col("one").alias(id_col)), id_col, "left_semi")
    shingles = shingle_sets(texts, "_text", size).join(members.select("node"), "node", "left_semi").dropDuplicates(["node"])
    members = scratch.save(members.drop("one").join(shingles, "node"), "members-sets")
    links = scratch.save(contracted(similar_links(members, share)), "similar")
    roots = scratch.save(components(links, scratch), "roots")
    named = sets.select(id_col, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = scratch.save(named.groupBy("root").agg(F.min(id_col).alias(id_col)).select(id_col), "kept")
    scratch.drop("sets", "nodes", "forest", "members", "members-sets")
    return df.join(kept, id_col, "left_semi").select(*map(quoted, df.columns)).unionByName(df.filter(F.col(id_col).isNull()))
