"""The registered queries of the operators, over whole tables, with the parameters of their contracts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import ball_search, bpe, exact_dedup, language_id, licenses, line_dedup, neighbours, packing, periodic, quality, simhash, sql, substring_dedup, url_filter
from palisade.llm._shared import SPACE_RUN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(c) -> F.Column:
    return F.sha2(c.cast("binary"), 256)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions, _ = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return decisions.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", url_filter.fetched_at(F.col("page_id")).alias("fetched_at"))
    return url_filter.judge(pages, url_filter.list_history(pages))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", _sha(F.col("kept")).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    out = bpe.decode(ids, path)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256")
    )


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "documents").withColumn("path", licenses.tree_path())
    return licenses.scan(files)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("document.doc_id", "p_text", "p_meta", "score", "accept")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), 35)
    return out.select("doc_id", "n_words", "n_removed", _sha(F.col("kept")).alias("kept_sha256"))


def tails_repeated(docs: DataFrame) -> DataFrame:
    """The documents, of which a tenth, told by the id's checksum, repeat words from some place on up to their end."""
    words = F.filter(F.split("text", SPACE_RUN), lambda w: w != "")
    h, n = F.crc32(F.col("doc_id").cast("string")), F.size("words")
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get("words", a + i % p))
    text = F.when((h % 10 == 0) & (F.size(words) > 0), F.array_join(F.concat(F.slice("words", 1, a), tail), " ")).otherwise(F.col("text"))
    return docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words")).select("doc_id", text.alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(tails_repeated(_table(spark, sf_dir, "documents")), 12)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), _sha(said).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", (-F.col("top.start")).alias("start"), "top.length", (-F.col("top.period")).alias("period"), F.expr("(1000 * top.length) div (-top.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10).rows


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.fit(docs.filter(F.coalesce(~held_out, F.lit(True))))
    return language_id.identify(docs, model, F.col("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (op1_exact_dedup, op2_url_filter, op3_line_dedup, op4_simhash, op5_bpe, op6_neighbours, op7_licenses, op8_packing, op9_quality, op10_substring, op11_runs, op12_search, op13_language)
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": sql.OP1, "op2_url_filter": sql.OP2, "op3_line_dedup": sql.OP3, "op7_licenses": sql.OP7, "op10_substring": sql.OP10, "op11_runs": sql.OP11, "op12_search": sql.OP12}
