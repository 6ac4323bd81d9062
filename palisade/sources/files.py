"""Reading files and checking uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions.text import strip

# Limits and types.
MOST_TEXT, MOST_MEDIA = 10 * 1024 * 1024, 25 * 1024 * 1024
MEDIA = ["mp4", "mov", "webm", "avi", "mp3", "wav", "ogg"]
EXTENSIONS = ["pdf", "docx", "doc", "pptx", "txt", "md", "csv", "json", "png", "jpg", "jpeg", "webp", "tiff", "svg", *MEDIA, "html"]
MIME_PREFIXES = ["text/", "application/json", "application/csv", "image/", "video/", "audio/"]
MIME_EXACT = [
    "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/msword", "application/vnd.ms-powerpoint",
    "text/html", "text/markdown", "image/png", "image/jpeg", "image/webp", "image/tiff", "image/svg+xml", "video/mp4", "video/quicktime", "video/webm", "video/x-msvideo", "audio/mpeg", "audio/wav", "audio/webm", "audio/ogg",
]


def decode_text(content: F.Column) -> F.Column:
    """UTF-8; Latin-1 if over 2 % of the characters would be replaced and Latin-1 shows more printable ones."""
    utf8 = content.cast("string")  # invalid bytes stay and are counted below
    valid = F.make_valid_utf8(utf8)
    latin = F.decode(content, "ISO-8859-1")
    printable = lambda c: F.regexp_count(c, F.lit(r"[\x20-\x7E\n\r]"))
    bad = F.regexp_count(valid, F.lit("�")) > F.length(valid) * 0.02
    return F.when(bad & (printable(latin) > printable(valid)), latin).otherwise(valid)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, mime, size_bytes, text) of the text files below ``path``."""
    kinds = {"txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "html": "text/html"}
    ext = F.lower(F.element_at(F.split("path", "\\."), -1))
    mime = F.lit("text/plain")
    for k, v in kinds.items():
        mime = F.when(ext == k, v).otherwise(mime)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", mime.alias("mime"), F.col("length").alias("size_bytes"), decode_text(F.col("content")).alias("text"))


def validate_upload(df: DataFrame) -> DataFrame:
    """``df`` (filename, mime_type, size_bytes) with error (null if none) and warnings (array)."""
    ext, mime = F.lower(F.element_at(F.split(F.coalesce("filename", F.lit("")), "\\."), -1)), F.lower(F.coalesce("mime_type", F.lit("")))
    media = ext.isin(MEDIA) | mime.startswith("video/") | mime.startswith("audio/")
    allowed = mime.isin(MIME_EXACT)
    for p in MIME_PREFIXES:
        allowed = allowed | mime.startswith(p)
    warnings = F.when(~allowed & ~ext.isin(EXTENSIONS), F.array(F.lit("Unrecognized type"))).otherwise(F.array().cast("array<string>"))
    most = F.when(media, MOST_MEDIA).otherwise(MOST_TEXT)
    return df.withColumns({"error": F.when(F.col("size_bytes") > most, "File too large"), "warnings": warnings})


# Nodes of text, and limits on slides.
NODE, TITLE = r"<a:t[^>]*>([^<]+)</a:t>", r"<dc:title[^>]*>([^<]+)</dc:title>"
MOST_SLIDES, MOST_NOTES, MOST_XML, MOST_SLIDE_TEXT = 200, 10, 2_000_000, 5_000_000


def slide_xml_text(parts: DataFrame) -> DataFrame:
    """(document_id, text) from the XML parts of slides (document_id, path, xml); one row per document.

    The title comes first, then the first 200 slides by path as text (slide10 before slide2), then the
    first 10 notes. Slides of over 2,000,000 characters of XML are left out, as are all behind the one
    whose text brings the slides' texts over 5,000,000 characters. A document without text has an empty one.
    """
    path = F.col("path")
    kind = F.when(path == "docProps/core.xml", 0).when(path.rlike(r"^ppt/slides/slide[0-9]+\.xml$"), 1).when(path.rlike("^ppt/notesSlides/"), 2)
    title = F.regexp_extract("xml", TITLE, 1)
    nodes = strip(F.array_join(F.regexp_extract_all("xml", F.lit(NODE), F.lit(1)), " "))
    text = F.when(kind == 0, F.when(title != "", F.concat(F.lit("Title: "), title))).when((kind == 2) | (F.length("xml") <= MOST_XML), F.nullif(nodes, F.lit("")))
    w = Window.partitionBy("document_id", "kind").orderBy("path")
    rows = parts.select("document_id", kind.alias("kind"), "path", text.alias("text")).withColumn("i", F.row_number().over(w))
    rows = rows.filter((F.col("kind") == 0) & (F.col("i") == 1) | (F.col("kind") == 1) & (F.col("i") <= MOST_SLIDES) | (F.col("kind") == 2) & (F.col("i") <= MOST_NOTES))
    # texts are counted as joined by one character
    before = F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)) - 1
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).filter((F.col("kind") != 1) | (F.col("before") <= MOST_SLIDE_TEXT))
    found = rows.filter("text is not null").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("kind", "path", "text"))).alias("p"))
    found = found.select("document_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))
    return parts.select("document_id").distinct().join(found, "document_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
