"""Source files from rows, folders and archives, and the tables that keep them."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..operators import tree
from . import zips
from .store import Store
from .zips import IGNORED, MEMBER_BYTES, REFUSED

# What is read, and up to which size.
READ = [".py", ".js", ".ts", ".jsx", ".tsx", ".c", ".cpp", ".h", ".hpp"]
ARCHIVE_BYTES, READ_BYTES = 200 << 20, 5 << 20


def ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED)))


def inline(spark: SparkSession, project: str, files: list[dict]) -> DataFrame:
    """A request's `files` of `filename` and `content`; equal names are refused."""
    names = [f["filename"] for f in files]
    if len(set(names)) != len(names):
        raise ValueError("file names must be unique in a project")
    return spark.createDataFrame([(project, k, f["filename"], f.get("content", "")) for k, f in enumerate(files)], schemas.SOURCE_FILE)


def numbered(files: DataFrame) -> DataFrame:
    """SOURCE_FILE of `project_id`, `path`, `content`: a file's number is a hash of its path, the same in every upload."""
    return files.select("project_id", F.xxhash64("path").bitwiseAND(F.lit((1 << 63) - 1)).alias("file_ord"), "path", "content")


def folder(spark: SparkSession, root: str, project: str, suffixes: list[str] | None = None, blank: bool = False) -> DataFrame:
    """A directory tree: known suffixes, no ignored folders, UTF-8 with replacement, blank files left out.

    Names are tested before contents are decoded.
    """
    base = root.rstrip("/")
    # the listing's paths have a scheme, the given root may have none
    relative = F.regexp_extract("path", "^(?:[a-z]+:)?/*" + _quote(base.split(":", 1)[-1].lstrip("/")) + "/(.*)$", 1)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(relative.alias("path"), "content")
    rows = rows.where(text.suffix(F.col("path")).isin(suffixes or READ) & ~ignored(F.col("path")))
    rows = rows.select(F.lit(project).alias("project_id"), "path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return numbered(rows if blank else rows.where(~text.is_blank(F.col("content"))))


def _quote(s: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in s)


def archives(uploaded: DataFrame) -> DataFrame:
    """ZIP rows (`project_id`, `content` binary) to `project_id`, `path`, `status`, `bytes`, `content`.

    Status: extracted, skipped (folders, ignored ones, refused suffixes, members of
    over MEMBER_BYTES), or an error; archives of over ARCHIVE_BYTES and broken ones are
    a row with an error. Members are read one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("project_id", pa.string()), ("path", pa.string()), ("status", pa.string()), ("bytes", pa.int64()), ("content", pa.binary())])
        for b in batches:
            for project, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for row in members(raw):
                    yield pa.RecordBatch.from_pylist([{"project_id": project, **row}], kind)

    return uploaded.select("project_id", "content").mapInArrow(run, "project_id string, path string, status string, bytes long, content binary")


def members(raw: bytes | None) -> Iterator[dict]:
    if raw is None or len(raw) > ARCHIVE_BYTES:
        yield {"path": "", "status": "error: no archive" if raw is None else "error: archive too large", "bytes": len(raw or b""), "content": None}
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile:
        yield {"path": "", "status": "error: not a zip archive", "bytes": len(raw), "content": None}
        return
    for row in zips.unpack(archive, enumerate(archive.infolist())):
        yield {c: row[c] for c in ("path", "status", "bytes", "content")}


def archive_summary(rows: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    return rows.groupBy("project_id").agg(n(F.col("status") == "extracted").alias("extracted"), n(F.col("status") == "skipped").alias("skipped"), n(F.col("status").startswith("error")).alias("errors"))


def from_archives(rows: DataFrame) -> DataFrame:
    kept = rows.where((F.col("status") == "extracted") & text.suffix(F.col("path")).isin(READ))
    return numbered(kept.select("project_id", "path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")))


def archive_upload(uploaded: DataFrame) -> dict[str, DataFrame]:
    """What an uploaded archive is answered with: its files, summary, tree and figures."""
    rows = archives(uploaded)
    files = from_archives(rows)
    return {"files": files, "summary": archive_summary(rows), "tree": tree.ordered_tree(tree.tree(files)), "info": tree.project_info(files), "extensions": tree.extension_histogram(files)}


def uploads(rows: DataFrame, keep_folders: bool = True) -> DataFrame:
    """Loose files or a folder (`project_id`, `path`, `content` binary): safe relative paths or base names, no refused suffixes, no large files."""
    path = text.safe_path(F.col("path"))
    path = path if keep_folders else text.short_name(path)
    out = rows.select("project_id", path.alias("path"), "content").where((F.col("path") != "") & ~text.suffix(F.col("path")).isin(REFUSED) & (F.octet_length("content") <= MEMBER_BYTES))
    return numbered(out.select("project_id", "path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")))


def save(files: DataFrame, table_path: str, replace: bool = False) -> str:
    """The project store: a commit of `store`. What is saved later takes the place of equal paths, or with `replace` of all that its projects had."""
    return Store(files.sparkSession, table_path).save(files, replace)


def load(spark: SparkSession, table_path: str, project: str | None = None) -> DataFrame:
    return Store(spark, table_path).load(project)


def delete(spark: SparkSession, table_path: str, project: str) -> bool:
    """Empties a project; whether there was one."""
    return Store(spark, table_path).delete(project)


def one_file(files: DataFrame, project: str, path: str) -> DataFrame:
    """One file of a project, of READ_BYTES at most; a path that leaves the project is refused."""
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError("path outside of the project")
    return files.where((F.col("project_id") == project) & (F.col("path") == path) & (F.octet_length("content") <= READ_BYTES))


def projects(info: DataFrame) -> DataFrame:
    """Project rows, the newest first."""
    return info.orderBy(F.desc("mtime"), "project_id")


def cached(spark: SparkSession, info: DataFrame, path: str) -> DataFrame:
    """A small table kept as Parquet; made again where it is missing or broken."""
    try:
        rows = spark.read.parquet(path)
        rows.limit(1).collect()
        return rows
    except (AnalysisException, CapturedException, Py4JJavaError) as e:
        # only what is missing or damaged is made again; any other failure is the caller's
        if not re.search("PATH_NOT_FOUND|UNABLE_TO_INFER_SCHEMA|CANNOT_READ_FILE|is not a Parquet file|FAILED_READ_FILE", str(e)):
            raise
        info.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def export_report(report: DataFrame, path: str) -> None:
    """A report's rows as JSON lines."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).write.mode("overwrite").text(path)


def report_bundle(report: DataFrame, diagram: str | None = None) -> bytes:
    """A report of a row, and its diagram, as a ZIP archive for a download."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("report.json", request_json(report))
        if diagram is not None:
            archive.writestr("diagram.mmd", diagram)
    return out.getvalue()


def log_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("content"))


def sessions(rows: DataFrame, hours: int = 24) -> DataFrame:
    """Rows with a `ts` of the last hours."""
    return rows.where(F.col("ts") > F.current_timestamp() - F.make_interval(hours=F.lit(hours)))


def request_json(report: DataFrame) -> str:
    """The single row of a report for an answer."""
    return json.dumps(report.first().asDict(recursive=True), default=str, ensure_ascii=False)
