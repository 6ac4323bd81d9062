"""Line deduplication with levelled sorted runs of line hashes.

A run is a table of line keys (128-bit hashes, in buckets and in order of the key) with the number of
documents that hold the line and the largest id among them. Each new batch of documents is
merge-anti-joined with the runs, which tells new lines from known ones without moving the runs. New
lines are added as a run of level 0, so that a line is in one run only; what the batch says about known
lines is noted beside the runs. Whenever a level has ``fanout`` runs they are compacted into one of the
next level, so few runs are read however many batches came; no line of theirs meets another, so nothing
is summed. A line's counts are its row in the one run that has it and what was noted since, which is
little, as most lines occur once. Runs in a named folder can be opened again and added to.

A line's key is the line without white space (space, \\x09-\\x0D) at both ends and with A-Z lower-cased.
Lines are the parts between newlines; a null or empty text is one empty line. Every row is a document
of its own when lines are dropped, also when ids repeat or are null; rows with equal ids are counted as
one document, all rows with a null id as one whose id is never the largest, unless all holders' ids are
null. Extra columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm._shared import SPACE, Scratch, ascii_lower, bucketed, located, slices, text_of

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def line_hashes(df: DataFrame, min_length: int, *columns: Column, text_col: str = "text") -> DataFrame:
    """(columns, pos, h1, h2) of every line whose key has at least ``min_length`` code points."""
    lines = df.select(*columns, F.posexplode(F.split(text_of(text_col), "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_length)
    return keyed.withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64(F.lit(1), F.col("key"))}).drop("line", "key")


class LineRuns:
    """The runs in a shared folder. ``levels`` maps a level to its runs' names, each of which says the batches that it covers.

    folder: one that stays. Runs that a compaction made needless but did not get to delete are covered by its result and
    left out; notes of a batch whose run was never finished count for nothing and are written anew with the batch.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, folder: str | None = None, buckets: int | None = None):
        self.spark, self.fanout, self.scratch = spark, fanout, Scratch(spark, "line-runs", folder)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[str]] = defaultdict(list)
        self.frames: dict[str, DataFrame] = {}
        spans = {n: tuple(map(int, n.split("-")[1:])) for n in self.scratch.finished("run-")}
        for name, (level, first, last, buckets) in spans.items():
            if not any(f <= first and last <= l and k > level for k, f, l, _ in spans.values()):
                schema = spark.read.parquet(self.scratch.path(name)).schema
                self.levels[level].append(name)
                self.frames[name] = bucketed(spark, self.scratch.path(name), schema, buckets, KEY)
        self.made = 1 + max((last for _, _, last, _ in spans.values()), default=-1)
        self.notes = [n for n in self.scratch.finished("seen-") if int(n.split("-")[1]) < self.made]

    def _write(self, run: DataFrame, level: int, first: int, last: int) -> DataFrame:
        name = f"run-{level}-{first:06d}-{last:06d}-{self.buckets}"
        self.frames[name] = bucketed(self.spark, self.scratch.path(name), run.schema, self.buckets, KEY, run)
        self.levels[level].append(name)
        return self.frames[name]

    def runs(self) -> list[DataFrame]:
        """A line has a row in one of them."""
        return [self.frames[n] for level in self.levels.values() for n in level]

    def known(self) -> DataFrame | None:
        """h1, h2, documents, last: every line's counts over all batches."""
        names = [n for level in self.levels.values() for n in level]
        if not names:
            return None
        lines = self._files(names)
        if not self.notes:
            return lines
        noted = self._files(self.notes).groupBy(*KEY).agg(F.sum("documents").alias("more"), F.max("last").alias("later"))
        both = lines.join(noted, KEY, "left")
        return both.select(*KEY, (F.col("documents") + F.coalesce("more", F.lit(0))).alias("documents"), F.greatest("last", "later").alias("last"))

    def _files(self, names: list[str]) -> DataFrame:
        """The rows of several tables, read as plain files: a union of tables in equal buckets counts as in buckets itself, though it puts equal keys in several parts."""
        return self.spark.read.schema(next(iter(self.frames.values())).schema).parquet(*map(self.scratch.path, names))

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch (id, h1, h2); returns its run: h1, h2, documents, last of the lines met for the first time."""
        batch = lines.groupBy(*KEY, "id").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("documents"), F.max("id").alias("last"))
        before = self.runs()
        if before:
            # the batch is moved to the runs' buckets once, the runs stay where they are
            batch = self.scratch.save(batch.repartition(self.buckets, *KEY), f"batch-{self.made}").repartition(self.buckets, *KEY)
            seen = [batch.join(run.select(*KEY), KEY, "left_semi") for run in before]
            self.notes.append(f"seen-{self.made:06d}")
            self.scratch.save(reduce(DataFrame.unionByName, seen), self.notes[-1])
            for run in before:
                batch = batch.join(run.select(*KEY), KEY, "left_anti")
        written, level = self._write(batch, 0, self.made, self.made), 0
        self.scratch.drop(f"batch-{self.made}")
        self.made += 1
        while len(self.levels[level]) >= self.fanout:
            old = self.levels.pop(level)
            ends = [int(x) for n in old for x in n.split("-")[2:4]]
            self._write(self._files(old), level + 1, min(ends), max(ends))
            level += 1
        return written


def _drop(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                total, gone, kept = [], [], []
                for text, drop in zip(part.column("text").to_pylist(), part.column("drop").to_pylist()):
                    lines = (text or "").split("\n")
                    out = set(drop or ())
                    total.append(len(lines))
                    gone.append(len(out))
                    kept.append("\n".join(x for i, x in enumerate(lines) if i not in out) if out else text or "")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*columns, "n_lines", "n_dropped", "kept"])

    return run


def drop_common_lines(df: DataFrame, min_length: int = 40, min_documents: int = 5, batches: int = 4, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept): lines whose key is long and common enough go, except in the largest id holding it.

    batches: the documents come to the runs in so many batches, by a hash of the id.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "line-dedup")
    docs = located(df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), scratch, id=F.col("id"), text=F.col("text"))
    docs = docs.withColumn("file", F.xxhash64("file"))  # a number says which of the files
    batch = F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch")
    lines = line_hashes(docs, min_length, F.col("id"), F.col("file"), F.col("row"), batch)
    lines = scratch.save(lines, "lines", "batch")
    runs = LineRuns(spark, fanout)
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i).select("id", *KEY))
    common = scratch.save(runs.known().filter(F.col("documents") >= min_documents).select(*KEY, "last"), "common")
    drop = lines.join(common, KEY).filter(~F.col("id").eqNullSafe(F.col("last"))).groupBy("file", "row").agg(F.collect_set("pos").alias("drop"))
    both = docs.join(drop, ["file", "row"], "left").select("id", "text", "drop")
    schema = T.StructType([docs.schema["id"]]).add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    return both.mapInArrow(_drop(["id"]), schema).withColumnRenamed("id", id_col)


def drop_seen_lines(lines: DataFrame, runs: LineRuns) -> DataFrame:
    """Incremental use: of a batch (id, pos, h1, h2) the lines that no earlier batch had; the batch is added to the runs."""
    return lines.join(runs.add(lines).select(*KEY), KEY, "left_semi")
