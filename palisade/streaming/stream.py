"""The narrow operators over unbounded sources, duplicates by content, and running counts of the audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.text import normalize_text, text_stats
from palisade.operators import risk, scan


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 1000) -> DataFrame:
    """New parquet files below ``path``, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_scan(df: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """id, sha256, findings, risk_score, classification: normalizing, scanning and scoring need no state."""
    rows = df.select(id_col, normalize_text(F.col(text_col)).alias("text"))
    rows = scan.scan_array(rows.withColumn("sha256", text_stats(F.col("text"))["sha256"]))
    return rows.select(id_col, "sha256", "findings", risk.risk(F.col("findings")).alias("r")).select(id_col, "sha256", "findings", F.col("r.total").alias("risk_score"), "r.classification")


def stream_dedup(df: DataFrame, time_col: str = "at", lateness: str = "1 hour", text_col: str = "text") -> DataFrame:
    """``df`` with sha256, without rows whose content came before within the lateness; the state is bounded by it."""
    return df.withColumn("sha256", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(["sha256"])


def stream_audit_counts(df: DataFrame, window: str = "1 hour", lateness: str = "1 hour", time_col: str = "timestamp", key: str = "action") -> DataFrame:
    """Counts per window and action; a window is final once the watermark has passed it."""
    counts = df.withWatermark(time_col, lateness).groupBy(F.window(time_col, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("since"), key, "n")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop. A restart with the same checkpoint goes on where it stopped."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
