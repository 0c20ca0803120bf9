"""File sources: folders and object stores, web pages, JSON lines, and text out of bytes."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_BYTES = 100 << 20


@dataclass(frozen=True)
class Connector:
    """Where files come from: any path that Spark reads (a folder, s3a://, abfss://, hdfs://), with patterns, depth and a size limit.

    Exclusion wins over inclusion; no include pattern takes all. Patterns are those of file names: * and ?.
    """

    path: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    recursive: bool = True
    max_bytes: int = MAX_BYTES

    def validate(self) -> list[str]:
        """What is wrong with the configuration."""
        return [m for bad, m in ((not self.path, "a path is needed"), (self.max_bytes <= 0, "max_bytes must be positive")) if bad]

    def info(self) -> dict:
        return {"path": self.path, "kind": self.path.split("://")[0] if "://" in self.path else "folder", "include": list(self.include), "exclude": list(self.exclude)}

    def listed(self, spark: SparkSession, since: str | None = None, before: str | None = None) -> DataFrame:
        """path, name, length, modificationTime of the files that pass; contents are pruned from the scan. `since` takes only files changed later: the cursor of an incremental sync."""
        return self._files(spark, since, before).drop("content")

    def files(self, spark: SparkSession, since: str | None = None, before: str | None = None) -> DataFrame:
        """The same with content."""
        return self._files(spark, since, before)

    def _files(self, spark: SparkSession, since: str | None, before: str | None) -> DataFrame:
        r = spark.read.format("binaryFile").option("recursiveFileLookup", str(self.recursive).lower())
        for k, v in (("modifiedAfter", since), ("modifiedBefore", before)):
            r = r.option(k, v) if v else r
        name = F.element_at(F.split("path", "/"), -1)
        df = r.load(self.path).withColumn("name", name).filter(F.col("length") <= self.max_bytes)
        return df.filter(passes(F.col("name"), self.include, self.exclude)).select("path", "name", "length", "modificationTime", "content")

    def test(self, spark: SparkSession) -> tuple[bool, str]:
        """Whether the source can be listed."""
        try:
            self.listed(spark).limit(1).count()
        except Exception as e:  # noqa: BLE001  any failure of a store is an answer here
            return False, str(e)[:300]
        return True, "ok"

    def sync(self, spark: SparkSession, to: str, since: str | None = None) -> dict:
        """Copies files into a Parquet catalogue with checksums and returns files, bytes and the new cursor.

        A sync is a folder named by what it starts from, and it is written over as a whole, so one that is run again after a failure adds no file twice. `synced` reads the catalogue."""
        df = self.files(spark, since).withColumn("sha256", F.sha2("content", 256)).withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))
        part = f"{to}/since={''.join(c if c.isalnum() else '-' for c in since or 'start')}"
        df.write.mode("overwrite").parquet(part)
        done = spark.read.schema(df.schema).parquet(part).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b"), F.max("modificationTime").alias("t")).first()
        return {"files": done.n, "bytes": done.b, "cursor": done.t.isoformat() if done.t else since, "errors": 0}


def synced(spark: SparkSession, to: str) -> DataFrame:
    """The catalogue of all syncs: of each path the latest copy."""
    w = Window.partitionBy("path").orderBy(F.desc("modificationTime"))
    return spark.read.parquet(to).drop("since").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def passes(name: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Whether a file name is taken."""
    ok = F.lit(not include)
    for p in include:
        ok = ok | F.rlike(name, F.lit(glob(p)))
    for p in exclude:
        ok = ok & ~F.rlike(name, F.lit(glob(p)))
    return ok


def glob(pattern: str) -> str:
    """A file-name pattern as a regular expression."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in pattern) + "$"


def web_pages(pages: DataFrame, max_pages: int = 50) -> DataFrame:
    """url, filename, html of the first pages by id; the limit is the connector's own. A file is named by host and path."""
    host, path = F.expr("parse_url(url, 'HOST')"), F.coalesce(F.expr("parse_url(url, 'PATH')"), F.lit(""))
    name = F.concat(host, F.regexp_replace(path, "/", "_"), F.lit(".html"))
    return pages.orderBy("page_id").limit(max_pages).select("url", name.alias("filename"), "html")


def texts(files: DataFrame, content: str = "content", name: str = "name") -> DataFrame:
    """files with text and how it was found: UTF-8, else PDF page by page behind fences where pypdf is there, else null. Other columns are kept."""
    keep = [c for c in files.columns if c not in (content, "text", "extracted_by")]
    types = dict(files.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], [*keep, "text", "extracted_by"])

    return files.select(*keep, content).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", text string, extracted_by string")


def extract(data: bytes | None) -> tuple[str | None, str | None]:
    """Text out of one file's bytes."""
    if data is None:
        return None, None
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass
    try:
        from pypdf import PdfReader
    except ImportError:
        return None, None
    try:
        return "\n".join(f"=== PAGE {i} ===\n{p.extract_text() or ''}" for i, p in enumerate(PdfReader(io.BytesIO(data)).pages, 1)), "pdf"
    except Exception:  # noqa: BLE001  a broken file has no text
        return None, None


def write_jsonl(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """One JSON object a line, in folders by the given columns."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines under a fixed schema; what isn't JSON becomes a row of nulls."""
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def import_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation items of a CSV file with query, expected_chunks (comma list) and metadata (JSON), and the rows that were turned down with the reason."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for c in ("query", "expected_chunks", "metadata"):
        raw = raw if c in raw.columns else raw.withColumn(c, F.lit(None).cast("string"))
    blank = F.trim(F.coalesce("query", F.lit(""))) == ""
    bad_json = F.col("metadata").isNotNull() & F.expr("try_parse_json(metadata)").isNull()
    x = raw.withColumn("reason", F.when(blank, "blank query").when(bad_json, "bad metadata"))
    ids = F.filter(F.transform(F.split(F.coalesce("expected_chunks", F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    return x.filter("reason IS NULL").select("query", ids.alias("expected_chunks"), "metadata"), x.filter("reason IS NOT NULL").select("query", "reason")


def export_bundle(chunks: DataFrame, vectors: DataFrame, path: str, version: str) -> None:
    """Chunks as JSON lines, vectors as Parquet, and a manifest of both beside them."""
    write_jsonl(chunks, f"{path}/chunks")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    counts = chunks.agg(F.count(F.lit(1)).alias("chunks")).join(vectors.agg(F.count(F.lit(1)).alias("vectors")), F.lit(True))
    counts.withColumn("version", F.lit(version)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
