"""Normalization, statistics, quality, visible text, names and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.functions.regex import re2_sql
from palisade.plans.detection import documents, spread
from palisade.sources import files

#: Characters that normalization changes, put behind each text: expressions that Spark and DuckDB share.
NOISE = "concat(text, CASE doc_id % 5 WHEN 0 THEN concat(' e', chr(769), '  ', chr(9), chr(10), chr(10), chr(10), chr(10), ' x') WHEN 1 THEN concat(chr(8203), 'zero', chr(65279), chr(173)) WHEN 2 THEN concat(chr(65533), chr(7), 'ctl', chr(127)) WHEN 3 THEN concat('tail ', chr(10), ' ', chr(10), ' ', chr(10)) ELSE '' END)"


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = NOISE.replace("chr(769)", "'\\u0301'").replace("chr(8203)", "'\\u200B'").replace("chr(65279)", "'\\uFEFF'").replace("chr(173)", "'\\u00AD'").replace("chr(65533)", "'\\uFFFD'")
    return spread(documents(spark, sf_dir)).select("doc_id", F.expr(noise).alias("text"), "n_chars")


def normalized(spark, sf_dir):
    return _noisy(spark, sf_dir).select("doc_id", F.sha2(T.normalize_text(F.col("text")).cast("binary"), 256).alias("text_sha256"), F.length(T.normalize_text(F.col("text"))).cast("long").alias("char_count"))


def stats(spark, sf_dir):
    cols = T.text_stats(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", *(c.cast("long").alias(k) if k != "sha256" else c.alias(k) for k, c in cols.items()))


#: Texts of odd kinds: without spaces, without vowels, with vowels in capitals, with a secret in front.
ODD = "CASE doc_id % 7 WHEN 0 THEN replace(text, ' ', '') WHEN 1 THEN regexp_replace(text, '[aeiou]', '7'{g}) WHEN 2 THEN translate(text, 'aeiou', 'AEIOU') WHEN 3 THEN concat('AKIA', repeat('AB12', 4), ' ', text) ELSE text END"


def _odd(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("doc_id", F.expr(ODD.format(g="")).alias("text"))


def binary(spark, sf_dir):
    return _odd(spark, sf_dir).select("doc_id", T.looks_binary(F.col("text")).alias("binary"))


def quality(spark, sf_dir):
    q = _odd(spark, sf_dir).withColumn("q", T.text_quality(F.col("text")))
    return q.select(
        "doc_id", *(F.round(f"q.{n}", 6).alias(n) for n in ("printable_ratio", "space_ratio", "avg_word_len", "dictionary_ratio", "score")), F.col("q.word_count").cast("long").alias("word_count"),
        "q.is_garbage", T.is_meaningful(F.col("text"), F.col("q")).alias("meaningful"),
    )


def gate(spark, sf_dir):
    text, warning = T.quality_gate(F.col("text"), F.col("w"))
    return _odd(spark, sf_dir).withColumn("w", T.quality_warning(F.col("text"))).select("doc_id", F.length(text).cast("long").alias("char_count"), warning.alias("warning"))


#: Some texts longer than the limits on what is shown or sent.
LONG = "concat(text, CASE WHEN doc_id % 50 = 0 THEN repeat('long words ', 20000) ELSE '' END)"


def display(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.expr(LONG).alias("text")).select("doc_id", F.sha2(T.truncate_display(F.col("text")).cast("binary"), 256).alias("shown_sha256"), T.safe_truncate(F.col("text"), 100).alias("head"))


def labels(spark, sf_dir):
    n = F.col("n_chars")
    score = F.col("doc_id") % 101
    name = F.concat(F.lit("CUSTOM_"), F.upper("lang"), F.lit("_"), F.upper("source"))
    return documents(spark, sf_dir).select("doc_id", T.format_bytes(n * n).alias("size_shown"), T.risk_label(score).alias("risk_label"), T.policy_display_name(F.when(F.col("doc_id") % 2 == 0, "HR_SAFE").otherwise(name)).alias("policy_shown"))


def log_detail(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.safe_log_detail(F.col("text")).alias("detail"))


def visible(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.sha2(T.html_visible_text(F.col("html")).cast("binary"), 256).alias("text_sha256"), F.length(T.html_visible_text(F.col("html"))).cast("long").alias("char_count"))


SVG = "concat('<svg><g>', CASE doc_id % 3 WHEN 0 THEN concat('<text x=\"1\"> ', replace(text, '<', ''), ' </text><tspan>', lang, '</tspan>') WHEN 1 THEN concat('<rect/> ', replace(text, '<', '')) ELSE '<rect/> one' END, '</g></svg>')"


def svg(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.svg_text(F.expr(SVG)).alias("svg_text"))


NAMES = "concat('dir/', source, '\\\\', '[', lang, ']', chr(7), text, CASE doc_id % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.txt' ELSE '.odd' END)"
NAMES_SQL = NAMES.replace("'\\\\'", "chr(92)")
MIMES = "CASE doc_id % 6 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'image/png' WHEN 3 THEN '' WHEN 4 THEN 'Application/PDF' ELSE 'application/x-odd' END"


def _uploads(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.expr(NAMES).alias("filename"), F.expr(MIMES).alias("mime_type"), (F.col("n_chars") * 9000).alias("size_bytes"))


def filenames(spark, sf_dir):
    return _uploads(spark, sf_dir).select("doc_id", T.sanitize_filename(F.col("filename")).alias("name"), T.sanitize_filename(F.col("filename"), 80, "file").alias("short_name"))


def uploads(spark, sf_dir):
    return files.validate_upload(_uploads(spark, sf_dir)).select("doc_id", "error", F.array_join("warnings", "|").alias("warnings"))


def placeholders(spark, sf_dir):
    return _uploads(spark, sf_dir).select("doc_id", T.media_placeholder(F.col("filename"), F.col("mime_type"), F.col("size_bytes")).alias("placeholder"))


#: Decks of slides, notes and a title out of six documents each.
PART_PATH = "CASE doc_id % 6 WHEN 5 THEN concat('ppt/notesSlides/notesSlide', CAST(doc_id AS STRING), '.xml') WHEN 4 THEN CASE WHEN doc_id % 12 = 4 THEN 'docProps/core.xml' ELSE 'ppt/media/image.xml' END ELSE concat('ppt/slides/slide', CAST(doc_id AS STRING), '.xml') END"
PART_XML = "CASE doc_id % 6 WHEN 4 THEN concat('<dc:title lang=\"x\">', lang, '</dc:title>', text) ELSE concat('<p:sld><a:t>', replace(replace(text, '<', ' '), chr(10), '</a:t> 1 <a:t lang=\"en\"> '), '</a:t></p:sld>') END"


def slides(spark, sf_dir):
    parts = documents(spark, sf_dir).select(F.floor(F.col("doc_id") / 6).alias("document_id"), F.expr(PART_PATH).alias("path"), F.expr(PART_XML).alias("xml"))
    return files.slide_xml_text(parts).select("document_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.length("text").cast("long").alias("char_count"))


_S = r"\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}-\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_P = "'" + T.PRINTABLE + "'"
_C = "'" + T.CJK + "'"


def _n(pattern: str, text: str = "sample") -> str:
    return f"len(regexp_extract_all({text}, {pattern}))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{_S}]+'), lambda w: w <> '')"


def _normal(x: str) -> str:
    steps = [("\\x{FFFD}", ""), ("[\\x{200B}-\\x{200D}\\x{FEFF}\\x{AD}]", ""), ("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", ""), ("[\\x{10000}-\\x{10FFFF}]", ""), ("\\n{3,}", "\n\n"), ("(?m)[ \\t]+$", "")]
    out = f"nfc_normalize({x})"
    for pattern, by in steps:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return out


_ODD = f"(SELECT doc_id, {ODD.format(g=', ' + chr(39) + 'g' + chr(39))} AS text FROM documents)"
_SHAPES = re2_sql(T.SECRET_SHAPES)
_QUALITY = f"""
WITH o AS {_ODD},
a AS (SELECT doc_id, text, left(text, 8000) AS sample, {_words('left(text, 8000)')} AS words FROM o),
b AS (SELECT *, greatest(1, length(sample)) AS n, len(words) AS w,
  list_filter(list_transform(words[1:200], lambda x: regexp_replace(x, '^[^0-9A-Za-z_]+|[^0-9A-Za-z_]+$', '', 'g')), lambda x: x <> '') AS t FROM a),
c AS (SELECT *, {_n(_P)} / n AS printable, {_n("' '")} / n AS spaces, CASE WHEN w > 0 THEN length(sample) / w ELSE 0 END AS average, {_n(_C)} / n AS cjk,
  {_n("'(?i)" + re2_sql(T.DICTIONARY)[1:])} / greatest(1, w) AS known,
  len(list_filter(t, lambda x: regexp_matches(x, '^[a-zA-Z]{{2,20}}$'))) / greatest(1, least(w, 200)) AS alpha,
  (len(list_filter(t, lambda x: regexp_matches(x, '[^a-zA-Z]') AND NOT regexp_matches(x, '[aeiouAEIOU]') AND length(x) > 5)) + len(list_filter(t, lambda x: length(x) > 25))) / greatest(1, least(w, 200)) AS garbled FROM b),
d AS (SELECT *, CASE WHEN cjk > 0.2 THEN printable < 0.5 ELSE printable < 0.72 OR (spaces < 0.04 AND w > 5) OR (spaces < 0.06 AND average > 14) OR average > 20 OR garbled > 0.35 OR (alpha < 0.15 AND w > 10 AND known < 0.03) OR (w < 8 AND average > 12 AND known = 0) END AS garbage,
  greatest(0, least(1, printable * 0.35::DOUBLE + least(1, spaces * 6) * 0.25::DOUBLE + least(1, known * 8) * 0.2::DOUBLE + (1 - least(1, garbled * 2)) * 0.2::DOUBLE)) AS s,
  length({_strip('text')}) = 0 AS blank, regexp_matches(left(text, 4000), {_SHAPES}) AS secret FROM c),
q AS (SELECT doc_id, text,
  CASE WHEN blank THEN 0 WHEN secret THEN 1 ELSE printable END AS printable_ratio, CASE WHEN blank THEN 0 WHEN secret THEN 0.15::DOUBLE ELSE spaces END AS space_ratio, CASE WHEN blank THEN 0 WHEN secret THEN 10 ELSE average END AS avg_word_len,
  CASE WHEN blank THEN 0 WHEN secret THEN 0.1::DOUBLE ELSE known END AS dictionary_ratio, CASE WHEN blank THEN 0 WHEN secret THEN 0.8::DOUBLE WHEN garbage THEN least(s, 0.35) ELSE s END AS score,
  CASE WHEN blank THEN 0 WHEN secret THEN 10 ELSE w END AS word_count, CASE WHEN blank THEN true WHEN secret THEN false ELSE garbage END AS is_garbage FROM d)"""

QUERIES = {
    "normalize_text": normalized, "text_stats": stats, "looks_binary": binary, "text_quality": quality, "quality_gate": gate, "truncate_display": display, "display_labels": labels, "safe_log_detail": log_detail,
    "html_visible_text": visible, "svg_text": svg, "sanitize_filename": filenames, "validate_upload": uploads, "media_placeholder": placeholders, "slide_xml_text": slides,
}
def _name(n: int, d: str) -> str:
    return f"coalesce(nullif(left(trim(regexp_replace(list_last(string_split_regex(filename, '[/\\\\]')), '[\\x00-\\x1F\\x7F\\[\\]]', '', 'g')), {n}), ''), '{d}')"


_UPLOADS = f"(SELECT doc_id, {NAMES_SQL} AS filename, {MIMES} AS mime_type, n_chars * 9000 AS size_bytes FROM documents)"
SQL = {
    "slide_xml_text": f"""WITH p AS (SELECT floor(doc_id / 6)::BIGINT AS document_id, {PART_PATH} AS path, {PART_XML} AS xml FROM documents),
k AS (SELECT *, CASE WHEN path = 'docProps/core.xml' THEN 0 WHEN regexp_matches(path, '^ppt/slides/slide[0-9]+\\.xml$') THEN 1 WHEN starts_with(path, 'ppt/notesSlides/') THEN 2 END AS kind FROM p),
n AS (SELECT *, CASE WHEN kind = 0 THEN 'Title: ' || regexp_extract(xml, '<dc:title[^>]*>([^<]+)</dc:title>', 1) WHEN kind = 2 OR length(xml) <= 2000000 THEN nullif({_strip("array_to_string(regexp_extract_all(xml, '<a:t[^>]*>([^<]+)</a:t>', 1), ' ')")}, '') END AS t,
  row_number() OVER (PARTITION BY document_id, kind ORDER BY path) AS i FROM k WHERE kind IS NOT NULL),
c AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY document_id, kind ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0) AS so_far FROM n),
u AS (SELECT document_id, string_agg(t, chr(10) || chr(10) ORDER BY kind, path) AS t FROM c WHERE t IS NOT NULL AND (kind = 0 OR (kind = 1 AND i <= 200 AND so_far <= 5000000) OR (kind = 2 AND i <= 10)) GROUP BY document_id)
SELECT d.document_id, sha256(coalesce(t, '')) AS text_sha256, length(coalesce(t, '')) AS char_count FROM (SELECT DISTINCT document_id FROM p) d LEFT JOIN u ON d.document_id = u.document_id""",
    "normalize_text": f"WITH n AS (SELECT doc_id, {_normal(NOISE)} AS t FROM documents) SELECT doc_id, sha256(t) AS text_sha256, length(t) AS char_count FROM n",
    "text_stats": f"""SELECT doc_id, length(text) AS char_count, len({_words('text')}) AS word_count,
  greatest(1, len(list_filter(string_split_regex(text, '\\n[{_S}]*\\n'), lambda b: length({_strip('b')}) > 0))) AS sections, greatest(1, ceil(len(string_split(text, chr(10))) / 40)::BIGINT) AS pages, sha256(text) AS sha256, strlen(text) AS size_bytes FROM documents""",
    "looks_binary": f"""WITH a AS (SELECT doc_id, text, left(text, 4000) AS sample, {_words('left(text, 4000)')} AS words FROM {_ODD}),
b AS (SELECT *, greatest(1, length(sample)) AS n, len(words) AS w, CASE WHEN len(words) > 0 THEN length(sample) / len(words) ELSE 0 END AS average, {_n("' '")} / greatest(1, length(sample)) AS spaces FROM a)
SELECT doc_id, CASE WHEN length({_strip('text')}) < 20 OR regexp_matches(text, {_SHAPES}) THEN false WHEN {_n(_C)} / n > 0.2 THEN false WHEN {_n(_P)} / n < 0.72 THEN true
  WHEN w < 4 THEN (average > 15 AND spaces < 0.05) OR (length(sample) > 60 AND spaces < 0.03)
  ELSE (spaces < 0.06 AND average > 12) OR spaces < 0.04 OR average > 18 OR (NOT regexp_matches(sample, {"'(?i)" + re2_sql(T.COMMON)[1:]}) AND w > 5 AND spaces < 0.08) END AS binary FROM b""",
    "text_quality": f"""{_QUALITY} SELECT doc_id, round(printable_ratio, 6) AS printable_ratio, round(space_ratio, 6) AS space_ratio, round(avg_word_len, 6) AS avg_word_len, round(dictionary_ratio, 6) AS dictionary_ratio, round(score, 6) AS score, word_count, is_garbage,
  length({_strip('text')}) >= 40 AND NOT is_garbage AND score >= 0.42 AND NOT (len({_words('text')}) < 4 AND dictionary_ratio = 0) AS meaningful FROM q""",
    "quality_gate": f"""{_QUALITY}, g AS (SELECT doc_id, text, length({_strip('text')}) = 0 AS blank, NOT (starts_with(text, '[Image:') OR starts_with(text, '[Video/Audio:')) AND (is_garbage OR score < 0.3) AS bad FROM q)
SELECT doc_id, CASE WHEN blank OR bad THEN 0 ELSE length(text) END AS char_count, CASE WHEN blank THEN 'No extractable text' WHEN bad THEN 'Low text quality' END AS warning FROM g""",
    "truncate_display": f"SELECT doc_id, sha256(left({_normal('text')}, 200000)) AS shown_sha256, CASE WHEN length(text) <= 100 THEN text ELSE left(text, 99) || '…' END AS head FROM (SELECT doc_id, {LONG} AS text FROM documents)",
    "display_labels": """WITH b AS (SELECT *, n_chars * n_chars AS b, doc_id % 101 AS r FROM documents)
SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN format('{:.1f} KB', floor(b / 1024 * 10 + 0.5) / 10) ELSE format('{:.1f} MB', floor(b / 1048576 * 10 + 0.5) / 10) END AS size_shown,
  CASE WHEN r >= 70 THEN 'Critical' WHEN r >= 40 THEN 'High' WHEN r >= 15 THEN 'Medium' WHEN r > 0 THEN 'Low' ELSE 'Safe' END AS risk_label,
  CASE WHEN doc_id % 2 = 0 THEN 'HR Safe' ELSE 'Custom ' || upper(lang[1]) || lang[2:] || ' ' || upper(source[1]) || source[2:] END AS policy_shown FROM b""",
    "safe_log_detail": r"WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[\x00-\x1F\x7F]+', ' ', 'g')) AS d FROM documents) SELECT doc_id, CASE WHEN length(d) <= 180 THEN d ELSE left(d, 179) || '…' END AS detail FROM d",
    "html_visible_text": r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script\s*>', ' ', 'g'), '(?is)<style.*?</style\s*>', ' ', 'g'), '(?is)<noscript.*?</noscript\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS t FROM pages),
u AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</(?:p|div|h[1-6]|li|tr|br|section|article)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM s),
v AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&quot;', '"', 'g') AS t FROM u)
SELECT page_id, sha256(t) AS text_sha256, length(t) AS char_count FROM v""",
    "sanitize_filename": f"SELECT doc_id, {_name(n=120, d='upload')} AS name, {_name(n=80, d='file')} AS short_name FROM {_UPLOADS}",
    "validate_upload": f"""SELECT doc_id,
  CASE WHEN size_bytes > (CASE WHEN ext IN ({', '.join(f"'{x}'" for x in files.MEDIA)}) OR regexp_matches(mime, '^(video|audio)/') THEN 26214400 ELSE 10485760 END) THEN 'File too large' END AS error,
  CASE WHEN NOT (mime <> '' AND (mime IN ({', '.join(f"'{x}'" for x in files.MIME_EXACT)}) OR regexp_matches(mime, '^(text/|application/json|application/csv|image/|video/|audio/)'))) AND ext NOT IN ({', '.join(f"'{x}'" for x in files.EXTENSIONS)}) THEN 'Unrecognized type' ELSE '' END AS warnings
FROM (SELECT *, lower(mime_type) AS mime, lower(list_last(string_split(filename, '.'))) AS ext FROM {_UPLOADS})""",
    "media_placeholder": f"""SELECT doc_id, CASE WHEN starts_with(mime_type, 'image/') THEN '[Image: ' || {_name(n=80, d='file')} || ' — ' || upper(split_part(mime_type, '/', 2)) || ' unknown dimensions, ' || format('{{:.1f}} KB', floor(size_bytes / 1024 * 10 + 0.5) / 10) || ']'
  WHEN starts_with(mime_type, 'video/') OR starts_with(mime_type, 'audio/') THEN '[Video/Audio: ' || {_name(n=80, d='file')} || ' (' || mime_type || ') — ' || left(mime_type, 5) || ' placeholder]' END AS placeholder FROM {_UPLOADS}""",
    "svg_text": f"""WITH s AS (SELECT doc_id, {SVG} AS t FROM documents),
a AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '(?i)<(?:text|tspan)[^>]*>([^<]+)</(?:text|tspan)>', 1), lambda x: {_strip('x')}), lambda x: x <> '') AS nodes, {_strip(f"regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '[{_S}]+', ' ', 'g')")} AS bare FROM s),
b AS (SELECT *, len({_words('bare')}) AS w, {_n("' '", 'bare')} / greatest(1, length(bare)) AS spaces, length(bare) / greatest(1, len({_words('bare')})) AS average FROM a)
SELECT doc_id, CASE WHEN len(nodes) > 0 THEN array_to_string(nodes, chr(10)) WHEN w >= 3 AND NOT CASE WHEN length(bare) < 20 OR regexp_matches(bare, {_SHAPES}) THEN false WHEN {_n(_P, 'bare')} / length(bare) < 0.72 THEN true
  WHEN w < 4 THEN (average > 15 AND spaces < 0.05) OR (length(bare) > 60 AND spaces < 0.03) ELSE (spaces < 0.06 AND average > 12) OR spaces < 0.04 OR average > 18 OR (NOT regexp_matches(bare, {"'(?i)" + re2_sql(T.COMMON)[1:]}) AND w > 5 AND spaces < 0.08) END THEN bare ELSE '' END AS svg_text FROM b""",
}
