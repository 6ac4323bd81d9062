"""Exact deduplication by stateful streaming.

Arrivals flow through a streaming query whose keyed state, on disk (RocksDB) and without expiry,
holds for each digest the stable identifier of the first document, the locator of its content (file
and row) and a count. Whenever a digest is hit again, the full bytes behind it are compared; texts
that share a digest without being equal are told apart by their bytes.

Texts are equal when identical after every run of space, tab, newline, vertical tab, form feed and
carriage return is replaced by one space; null counts as empty. The row with the smallest id stays;
among rows with that id, the first in file order. Null ids come after all others. Extra columns are
ignored. An empty table gives an empty result.

With a named folder the state lasts: a later call goes on from it, in the same session or another.
What an earlier call kept stays kept, whatever the later ids; its bytes are fetched by the locator,
so the files of earlier calls must be there as they were. A call that was cut off is made again with
the same rows and takes up its state where it stopped; other rows are refused until then.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm._shared import SPACE_RUN, Scratch, quoted, text_of

#: The state's settings: on disk, with one bounded block cache and write buffer per executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # an open store takes some MB of disk and memory, so each is closed once its part of a batch is committed
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(c: Column) -> Column:
    return F.regexp_replace(c, SPACE_RUN, " ")


def sha256(c: Column) -> Column:
    return F.unhex(F.sha2(c.cast("binary"), 256))


def locator(df: DataFrame) -> tuple[str, str]:
    """Names for file and row that no column of ``df`` has."""
    taken, names = {c.lower() for c in df.columns}, []
    for name in ("_file", "_row"):
        while name in taken:
            name = "_" + name
        names.append(name)
    return names[0], names[1]


#: A digest with one row of so many at least is hot, so at most this many digests are; the rows of each are dealt to so many tasks.
HOT, DEALT = 1000, 64
#: Bits of the map of digests that were hit: 8 MB, in pieces of 4 KB, whatever the table's size. A fuller map lets more texts through to the join, which decides.
BITS, PIECE = 1 << 26, 1 << 15


def with_locator(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``df`` and the columns file and row of its content; a frame that is no file scan is written first."""
    file, row = locator(df)
    where = (F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    try:
        return df.select("*", *where)
    except AnalysisException:
        return (scratch.read(name, df) if scratch.finished(name) == [name] else scratch.save(df, name)).select("*", *where)


def follow(spark: SparkSession, schema: T.StructType, scratch: Scratch, call: int, files_per_batch: int) -> DataFrame:
    """Stream the folder's new arrivals into the state; returns digest, first (struct) and n of the digests among them."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    changes = scratch.path(f"changes-{call:06d}")
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        state = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(scratch.path("arrivals-*"))
            .groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        )
        # the folder's name is the batch's, so a batch that is run again writes the same rows over the old ones
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", scratch.path("state")).trigger(availableNow=True)
            .foreachBatch(lambda changed, i: changed.write.mode("overwrite").parquet(f"{changes}/batch={i}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    fs, path = scratch.files(changes)
    rows = spark.read.schema(state.schema).option("basePath", changes).parquet(f"{changes}/batch=*") if fs.exists(path) else spark.createDataFrame([], state.schema)
    return rows.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))


def maybe_in(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows whose digest's bit is set in a bitmap of ``digests``: all that are among them, and a few others."""
    bit = F.pmod(F.xxhash64("digest"), F.lit(BITS))
    piece, at = F.floor(bit / PIECE).alias("piece"), F.bitmap_bit_position(bit).alias("at")
    pieces = digests.select(piece, at).groupBy("piece").agg(F.bitmap_construct_agg("at").alias("bits"))
    byte = F.expr("cast(conv(hex(substring(bits, cast(at div 8 AS int) + 1, 1)), 16, 10) AS int)")
    found = rows.withColumns({"piece": piece, "at": at}).join(F.broadcast(pieces), "piece")
    return found.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 AS int))")) != 0).select(rows.columns)


def fetched(places: DataFrame, field: T.StructField) -> DataFrame:
    """(digest, place, text) of places in files of earlier calls. The driver learns the files' names, not the rows."""
    spark = places.sparkSession
    files = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(r["file"])) for r in places.select("place.file").distinct().collect()]
    if not files:
        return places.withColumn("text", F.lit(""))
    text = normalised(text_of(quoted(field.name))).alias("text")
    found = spark.read.schema(T.StructType([field])).parquet(*files).select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r"), text)
    return found.join(places, (F.col("_f") == F.col("place.file")) & (F.col("_r") == F.col("place.row"))).select("digest", "place", "text")


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 10_000, folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(decisions, content).

    decisions: one row per row of ``df``: id, keep_id, group_size (over all calls), kept, digest, _file, _row.
    content: ``df`` with the place of each row, by which decisions are joined back to it; its two columns are named _file and _row, with more underscores where ``df`` has such columns (``locator``).
    folder: keeps the state for later calls, which must name the same columns and digest.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "exact-dedup", folder)
    field = next(f for f in df.schema if f.name.lower() == text_col.lower())
    call = len(scratch.finished("done-"))
    step = lambda name: f"{name}-{call:06d}"
    content = with_locator(df, scratch, step("content"))
    file, row = locator(df)
    text, id_ = normalised(text_of(quoted(text_col))), F.col(quoted(id_col))
    place = F.struct(F.lit(call).alias("call"), id_.isNull().alias("none"), id_.alias("id"), F.col(file).alias("file"), F.col(row).alias("row"))
    arriving = content.select(digest(text).alias("digest"), place.alias("place"))
    if scratch.finished(step("arrivals")):  # by a call that was cut off
        arrivals = scratch.read(step("arrivals"), arriving)
        if arrivals.select("place.file", "place.row").exceptAll(content.select(file, row)).limit(1).count() or arrivals.count() != content.count():
            raise ValueError("a call with other rows was cut off in this folder; make it again first")
    else:
        arrivals = scratch.save(arriving, step("arrivals"))
    groups = scratch.save(follow(spark, arrivals.schema, scratch, call, files_per_batch), step("groups"))

    # the full bytes behind every digest that was hit again; rows of hot digests are dealt out, and copies collapse before texts move on
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(groups.filter(F.col("n") * HOT >= total).select("digest", F.lit(True).alias("hot")))
    salts = F.when(F.col("n") * HOT >= total, F.sequence(F.lit(0), F.lit(DEALT - 1))).otherwise(F.array(F.lit(0)))
    hit = groups.filter("n > 1").select("digest", F.explode(salts).alias("salt"))
    texts = content.select(digest(text).alias("digest"), text.alias("text"), F.pmod(F.xxhash64(file, row), F.lit(DEALT)).cast("int").alias("salt"))
    texts = maybe_in(texts, groups.filter("n > 1")).join(hot, "digest", "left")
    texts = texts.withColumn("salt", F.when(F.col("hot"), F.col("salt")).otherwise(0)).join(hit, ["digest", "salt"], "left_semi").select("digest", "text")
    earlier = groups.filter(F.col("first.call") < call).select("digest", F.col("first").alias("place"))
    if call:
        texts = texts.unionByName(fetched(earlier, field).select("digest", "text"))
    unlike = texts.distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    for i in range(call):  # what once had several texts has
        unlike = unlike.unionByName(scratch.read(f"collisions-{i:06d}", unlike))
    unlike = scratch.save(unlike.distinct(), step("collisions"))
    scratch.save(spark.range(0), step("done"))  # the call counts from here on

    def decide(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("place.id").alias(id_col), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"),
            (F.col("place") == F.col("first")).alias("kept"), "digest", F.col("place.file").alias("_file"), F.col("place.row").alias("_row"),
        )

    if unlike.isEmpty():
        return decide(arrivals.join(groups, "digest")), content
    alike = content.select(digest(text).alias("digest"), place.alias("place"), text.alias("text")).join(unlike, "digest", "left_semi")
    seen = alike
    for i in range(call):
        seen = seen.unionByName(fetched(scratch.read(f"arrivals-{i:06d}", arrivals).join(unlike, "digest", "left_semi"), field))
    exact = seen.groupBy("digest", "text").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    apart = alike.join(scratch.save(exact, step("exact")), ["digest", "text"]).drop("text")
    plain = arrivals.join(groups, "digest").join(unlike, "digest", "left_anti")
    return decide(plain).unionByName(decide(apart)), content


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    decisions, content = exact_dedup(df, id_col, text_col)
    file, row = locator(df)
    stay = decisions.filter("kept").select(F.col("_file").alias(file), F.col("_row").alias(row))
    return content.join(stay, [file, row], "left_semi").select(*(F.col(f"`{c}`") for c in df.columns))
