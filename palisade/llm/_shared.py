"""Helpers that several operators use: scratch tables, normalised columns, Arrow building blocks."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the contracts: space and \x09-\x0D.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Tables in a new folder under ``spark.checkpoint.dir``, which every executor can read.

    The setting is taken from the session. Where it is unset, a local session gets a temporary
    folder and any other master is refused, as executors elsewhere would not see that folder. Such
    folders go when the session ends; ``folder`` names one that stays, which a later session can open.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.gettempdir()
        self.spark, self.root = spark, folder.rstrip("/") if folder else f"{root.rstrip('/')}/palisade-{name}-{uuid.uuid4().hex}"
        fs, path = self.files(self.root)
        fs.mkdirs(path)
        if not folder:
            fs.deleteOnExit(path)  # results are lazy, so the tables behind them are needed as long as the session lasts

    def files(self, name: str):
        """The file system of a path, and the path."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Write ``df`` and return it as read back: lineage ends here and a lost executor rereads files."""
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def release(self) -> None:
        """Let Spark delete the shuffle files of frames that nothing refers to. It does so when the driver collects garbage, for which a driver with memory to spare waits while executors' disks fill."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def finished(self, prefix: str) -> list[str]:
        """The names of the folder's tables with the prefix that were written to their end."""
        fs, path = self.files(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(n for n in names if n.startswith(prefix) and fs.exists(self.files(f"{self.path(n)}/_SUCCESS")[1]))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            fs, path = self.files(self.path(name))
            fs.delete(path, True)


def located(df: DataFrame, scratch: Scratch, **columns: Column) -> DataFrame:
    """The columns, and where each row lies: file (path) and row (number in it). A frame that is no scan of Parquet files is written first."""
    named = [c.alias(n) for n, c in columns.items()]
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return df.select(*named, *where)
    except AnalysisException:
        return scratch.save(df.select(*named), "content").select(*columns, *where)


def bucketed(spark: SparkSession, path: str, schema: T.StructType, buckets: int, keys: list[str], rows: DataFrame | None = None) -> DataFrame:
    """A folder of rows in buckets by ``keys``, in order within each, so that joins on them move only the other side. rows: written there first.

    The catalog has a name for it only while the frame is made; the files are the caller's.
    """
    table = "palisade_" + uuid.uuid4().hex
    if rows is not None:
        rows.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").saveAsTable(table)
    else:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def quoted(name: str) -> str:
    """A column of any name, also one with dots or quotes, as ``F.col`` takes it."""
    return "`" + name.replace("`", "``") + "`"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; the slow ``translate`` only where other letters occur."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def mix(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, scattered."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def large_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of an Arrow string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Parts of a batch of about ``limit`` bytes of text each, so that work space stays bounded."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    edge = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
    cuts = [0, *edge.tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def int_lists(parts: list[bytes], width: str = "<i4") -> pa.ListArray:
    """An Arrow list column from the little-endian bytes of each row's integers."""
    size = np.dtype(width).itemsize
    ends = np.cumsum([0, *map(len, parts)]) // size
    flat = pa.array(np.frombuffer(b"".join(parts), dtype=width))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
