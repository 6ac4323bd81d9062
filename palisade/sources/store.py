"""The store: six tables under one manifest.

A manifest is a small file that names, for each table and bucket of keys, the folders with its rows. A
commit writes the changed buckets of any number of tables to new folders and then one manifest; readers
follow the newest manifest, so they see all of a commit or nothing of it, and a crash in between leaves
what was there. Only buckets that hold changed keys are written anew; appended rows are folders beside
the others. The manifest also remembers the last batch of each stream, so that a batch that comes twice
is taken once. Two commits at a time: the later one is refused.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

CONFIG = "struct<pii:boolean,secrets:boolean,injections:boolean,internal_assets:boolean,unsafe_urls:boolean,min_confidence:double>"
SCHEMAS = {
    "documents": "document_id string, filename string, mime_type string, title string, source_kind string, classification string, status string, size_bytes int, risk_score int, risk_before int, risk_after int, raw_content string, sanitized_content string, "
    f"metadata struct<sha256:string,char_count:int,word_count:int,pages:int,sections:int,parser:string,warnings:array<string>,sanitized_policy:string,scan_config:{CONFIG}>, created_at timestamp",
    "findings": "document_id string, category string, type string, severity string, confidence double, default_action string, applied_action string, stage string, start int, end int, matched_text string, masked_text string, reason string",
    "transformations": "document_id string, profile string, output_type string, model string, output_content string, grounding string, policy_status string, output_dlp string, risk_delta int, leakage_count int, citations array<struct<claim:string,evidence:string,grounded:boolean>>, batch_id string, created_at timestamp",
    "audit": "audit_id string, document_id string, actor string, action string, detail string, timestamp timestamp",
    "policies": "name string, classification string, audience string, allow array<string>, mask array<string>, remove array<string>, block array<string>, builtin boolean, active boolean",
    "intelligence": "document_id string, entities array<struct<type:string,value:string,start:int,end:int,confidence:double,context:string>>, iocs array<struct<type:string,value:string,start:int,end:int,severity:string,confidence:double,context:string>>, "
    "ttps array<struct<mitre_id:string,technique:string,tactic:string,severity:string,keyword:string,start:int,end:int,confidence:double,evidence:string>>, risks array<struct<category:string,severity:string,score:int,n:int>>, "
    "key_findings array<struct<finding:string,score:double,start:int,confidence:double>>, evidence array<struct<claim:string,start:int>>, summary string, risk_score int, classification string, model string, created_at timestamp",
}
KEYS = {name: "name" if name == "policies" else "document_id" for name in SCHEMAS}


def scratch_root(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, for stores that go with the session; a local session without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.gettempdir()
    path = f"{root.rstrip('/')}/palisade-{name}-{uuid.uuid4().hex}"
    fs, hadoop = _files(spark, path)
    fs.mkdirs(hadoop(path))
    fs.deleteOnExit(hadoop(path))
    return path


def _files(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


@dataclass(frozen=True)
class Change:
    """Rows that a commit brings to a table.

    ids: the keys whose rows they replace; without it the rows are added. only: a condition; of the keys'
    rows just those that meet it are replaced.
    """

    table: str
    rows: DataFrame
    ids: DataFrame | None = None
    only: str | None = None


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets
        self.fs, self.path = _files(spark, root)

    def _manifests(self) -> list[int]:
        folder = self.path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _parsed(self, version: int) -> dict | None:
        stream = self.fs.open(self.path(f"{self.root}/manifest/v{version:010d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:  # cut short by a crash: as if it had not been written
            return None
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict:
        """What readers follow: the newest whole manifest, or that of a version."""
        for v in reversed(self._manifests()):
            if version in (None, v) and (found := self._parsed(v)):
                return found
        if version:
            raise ValueError(f"no version {version}")
        return {"version": 0, "buckets": self._buckets, "tables": {}, "batches": {}}

    def table(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows; one that was never written is empty. buckets: of these alone."""
        held = self.manifest(version)["tables"].get(name, {})
        folders = [f"{self.root}/{f}" for b, fs in sorted(held.items()) if buckets is None or int(b) in buckets for f in fs]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[name])

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        return {name: self.table(name, version) for name in SCHEMAS}

    def bucket(self, key: str, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets or self.manifest()["buckets"])).cast("int")

    def touched(self, name: str, ids: DataFrame) -> list[int]:
        """The buckets that hold the keys: so many numbers at most as there are buckets."""
        return sorted(r[0] for r in ids.select(self.bucket(KEYS[name])).distinct().collect())

    def of(self, name: str, ids: DataFrame) -> DataFrame:
        """The rows of some keys, read from their buckets alone."""
        return self.table(name, buckets=self.touched(name, ids)).join(ids.select(KEYS[name]).distinct(), KEYS[name], "left_semi")

    def stage(self, rows: DataFrame) -> DataFrame:
        """Rows from which several tables are made, computed once."""
        folder = f"{self.root}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def _write(self, name: str, rows: DataFrame, version: int, buckets: int) -> dict[str, str]:
        """Folders by bucket."""
        kinds = self.spark.createDataFrame([], SCHEMAS[name]).schema
        typed = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))
        folder = f"{name}/v{version:010d}-{uuid.uuid4().hex}"
        dealt = typed.withColumn("bucket", self.bucket(KEYS[name], buckets)).hint("rebalance", "bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        found = [s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.root}/{folder}"))]
        return {n.split("=")[1]: f"{folder}/{n}" for n in found if n.startswith("bucket=")}

    def commit(self, *changes: Change, batch: tuple[str, int] | None = None) -> int:
        """Write all changes under one new manifest; returns its version.

        batch: a stream's name and the number of its batch; one that is in already changes nothing.
        """
        base, taken = self.manifest(), self._manifests()
        if batch and base["batches"].get(batch[0], -1) >= batch[1]:
            return base["version"]
        version, buckets = max(taken, default=0) + 1, base["buckets"]
        tables = {name: {b: list(fs) for b, fs in held.items()} for name, held in base["tables"].items()}
        for c in changes:
            held, key = tables.setdefault(c.table, {}), KEYS[c.table]
            if c.ids is None:
                for b, folder in self._write(c.table, c.rows, version, buckets).items():
                    held.setdefault(b, []).append(folder)
                continue
            ids = c.ids.select(key).distinct()
            touched = self.touched(c.table, ids)
            old = self.table(c.table, base["version"] or None, touched)
            marked = old.join(ids.withColumn("_new", F.lit(True)), key, "left")
            gone = F.col("_new") & F.expr(c.only) if c.only else F.col("_new")
            kept = marked.filter(~F.coalesce(gone, F.lit(False))).drop("_new")
            written = self._write(c.table, kept.unionByName(c.rows.select(*(x for x in old.columns if x in c.rows.columns)), allowMissingColumns=True), version, buckets)
            for b in touched:
                held[str(b)] = [written[str(b)]] if str(b) in written else []
        batches = base["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._publish({"version": version, "buckets": buckets, "tables": tables, "batches": batches})
        return version

    def _publish(self, manifest: dict) -> None:
        at = self.path(f"{self.root}/manifest/v{manifest['version']:010d}.json")
        out = self.fs.create(at, False)  # refused if another commit was faster
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()


def read_store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables below ``root`` as of the newest commit."""
    return Store(spark, root).tables()


def from_json_text(c: Column, kind: str) -> Column:
    """Nested data kept as JSON text; what cannot be parsed is empty."""
    return F.coalesce(F.from_json(c, kind), F.from_json(F.lit("[]" if kind.startswith("array") else "{}"), kind))


def write_findings(spark: SparkSession, root: str, new: DataFrame, scanned: DataFrame) -> int:
    """Replace the scanned documents' input findings; findings of outputs and buckets without such documents stay as they are."""
    return Store(spark, root).commit(Change("findings", new, scanned, "stage = 'INPUT'"))


def slug(title: Column, output_type: Column) -> Column:
    """File name of an artefact: up to 60 letters of the title in lower case, with dashes, and the type."""
    t = F.left(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(60))
    return F.concat(F.coalesce(F.nullif(t, F.lit("")), F.lit("output")), F.lit("-"), F.replace(F.lower(output_type), F.lit("_"), F.lit("-")), F.lit(".md"))


def export_artefacts(df: DataFrame, path: str) -> None:
    """Artefacts (title, output_type, output) as files ``<slug>-<type>.md`` in one folder.

    Of equal names all but the first get a number behind the slug, in order of the text, which makes the
    names the same whenever it is run. Files are written by the tasks that hold the rows, each first under
    a name of its own and then renamed, so a task that runs twice leaves one file.
    """
    rows = df.select(slug(F.col("title"), F.col("output_type")).alias("name"), F.coalesce("output", F.lit("")).alias("output"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.sha2(F.col("output").cast("binary"), 256)))
    rows = rows.withColumn("i", place).select(F.when(F.col("i") > 1, F.concat(F.regexp_replace("name", r"\.md$", ""), F.lit("-"), F.col("i").cast("string"), F.lit(".md"))).otherwise(F.col("name")).alias("name"), "output")
    df.sparkSession.dataSource.register(NamedFiles)
    rows.write.format(NamedFiles.name()).mode("append").save(path)


class NamedFiles(DataSource):
    """Rows (name, output) as one file each, by the file system that all tasks see through pyarrow or as a local path."""

    @classmethod
    def name(cls) -> str:
        return "palisade_named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _NamedFilesWriter(self.options["path"])


class _NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyarrow import fs as arrow_fs

        system, base = arrow_fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (arrow_fs.LocalFileSystem(), self.path)
        system.create_dir(base, recursive=True)
        for name, output in rows:
            part = f"{base}/.{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(output.encode())
            system.move(part, f"{base}/{name}")
        return WriterCommitMessage()
