"""ZIP archives as a data source, `spark.read.format("code_zip")`, and as a sink.

The driver lists names and sizes only. A large archive is read by several tasks, each of which
takes the members that begin in its share of the bytes; small archives share a task. A task
seeks: of an archive it reads the directory and its own members, never the whole. Filters on
`project_id` leave out archives before tasks are made, filters on `suffix` members before they
are unpacked, for which `register` lets the session hand filters to Python sources.
"""

from __future__ import annotations

import io
import struct
import sys
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

# What is skipped and refused, and up to which size.
IGNORED = ["__pycache__", ".git", "node_modules", ".venv", "venv", "env", ".env", "dist", "build", ".next", ".nuxt", "target", ".idea", ".vscode", ".pytest_cache", ".mypy_cache", "*.egg-info"]
REFUSED = [".exe", ".dll", ".so", ".bat", ".cmd", ".ps1", ".msi", ".bin"]
MEMBER_BYTES = 50 << 20
PART_BYTES = 16 << 20
SCHEMA = "project_id string, archive string, member int, path string, suffix string, status string, bytes long, content binary"


def safe_name(name: str) -> str:
    return "/".join(p for p in name.replace("\\", "/").split("/") if p not in ("", ".", ".."))


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    return "." + name.rsplit(".", 1)[1] if "." in name else ""


def unpack(archive: zipfile.ZipFile, wanted: Iterable[tuple[int, zipfile.ZipInfo]]) -> Iterator[dict]:
    """Members one at a time: extracted, skipped (folders, ignored ones, refused suffixes, over MEMBER_BYTES, whatever the directory says of their size) or an error."""
    for k, m in wanted:
        path = safe_name(m.filename)
        row = {"member": k, "path": path, "suffix": suffix_of(path), "status": "skipped", "bytes": m.file_size, "content": None}
        if not (m.is_dir() or not path or set(path.split("/")) & set(IGNORED) or row["suffix"] in REFUSED or m.file_size > MEMBER_BYTES):
            try:
                with archive.open(m) as member:
                    data = member.read(MEMBER_BYTES + 1)
                if len(data) <= MEMBER_BYTES:
                    row |= {"status": "extracted", "bytes": len(data), "content": data}
            except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, EOFError, zipfile.zlib.error) as e:
                row["status"] = f"error: {e}"
        yield row


class _Seekable(io.RawIOBase):
    """A file of pyarrow as Python's files are: a place before the start is an OSError."""

    def __init__(self, raw: pa.NativeFile):
        self.raw = raw

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.raw.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.raw.tell(), self.raw.size())[whence]
        if at < 0:
            raise OSError("before the start")
        self.raw.seek(at)
        return at

    def readinto(self, buffer) -> int:
        return self.raw.readinto(buffer)


@dataclass
class Part(InputPartition):
    """Shares of archives: project, path, bytes, which share, of how many."""

    shares: list[tuple[str, str, int, int, int]]


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("code_zip needs a path")
        self.root, self.part = options["path"], int(options.get("partBytes", PART_BYTES))
        self.projects: set | None = None
        self.suffixes: set | None = None

    def partitions(self) -> list[Part]:
        system, root = fs.FileSystem.from_uri(self.root) if ":" in self.root else (fs.LocalFileSystem(), self.root)
        root = root.rstrip("/")
        top = system.get_file_info(root)
        found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        parts: list[Part] = [Part([])]
        filled = 0
        for info in sorted((i for i in found if i.type == fs.FileType.File and i.path.lower().endswith(".zip")), key=lambda i: i.path):
            inside = info.path[len(root) :].lstrip("/") or info.base_name
            project = inside.split("/")[0] if "/" in inside else inside[: -len(".zip")]
            if self.projects is not None and project not in self.projects:
                continue
            n = max(1, -(-info.size // self.part))
            for k in range(n):
                size = -(-info.size // n)
                if filled and filled + size > self.part:
                    parts.append(Part([]))
                    filled = 0
                parts[-1].shares.append((project, info.path, info.size, k, n))
                filled += size
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.root)[0] if ":" in self.root else fs.LocalFileSystem()
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for project, path, size, k, n in partition.shares:
            with system.open_input_file(path) as raw, io.BufferedReader(_Seekable(raw), 1 << 16) as file:
                try:
                    archive = zipfile.ZipFile(file)
                except (zipfile.BadZipFile, NotImplementedError, ValueError, struct.error):
                    if k == 0 and self.suffixes is None:
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([project, path, None, "", None, "error: not a zip archive", size, None], kinds, strict=True)], names)
                    continue
                with archive:
                    own = ((i, m) for i, m in enumerate(archive.infolist()) if min(max(m.header_offset, 0) * n // max(size, 1), n - 1) == k)
                    if self.suffixes is not None:
                        own = ((i, m) for i, m in own if suffix_of(safe_name(m.filename)) in self.suffixes)
                    for row in unpack(archive, own):
                        row |= {"project_id": project, "archive": path}
                        yield pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in zip(names, kinds, strict=True)], names)


class PushedZipReader(ZipReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("project_id",):
                self.projects = values if self.projects is None else self.projects & values
            elif values is not None and f.attribute == ("suffix",):
                self.suffixes = values if self.suffixes is None else self.suffixes & values
            else:
                yield f


class ZipSource(DataSource):
    """Rows of SCHEMA for each member of the ZIP archives under `path`; a broken archive is a row with an error.

    A project is the archive's name, or the first folder under `path`. Options: `partBytes`, bytes a task;
    `pushFilters`, false for a session that keeps filters to itself.
    """

    @classmethod
    def name(cls) -> str:
        return "code_zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return (ZipReader if self.options.get("pushFilters", "true").lower() == "false" else PushedZipReader)(self.options)


def register(spark: SparkSession) -> None:
    """Makes `code_zip` known to a session; the source goes to workers as it is, wherever this library lies."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    module = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(module)
    try:
        spark.dataSource.register(ZipSource)
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("code_zip").load(path)


def pack(files: DataFrame, folder: str, most: int = 512) -> DataFrame:
    """Writes files as archives `<project>/<block>.zip`, a block for each `most` numbers of files; rows `project_id`, `archive`, `files`.

    An archive gets its name when it is whole, so a task that runs twice leaves one. Null contents are empty files; null paths are left out.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        project, block = key[0].as_py(), key[1].as_py()
        system, root = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        place = f"{root}/{safe_name(project).replace('/', '_')}"
        system.create_dir(place, recursive=True)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for path, content in sorted(zip(table["path"].to_pylist(), table["content"].to_pylist(), strict=True), key=lambda r: (r[0], r[1] or "")):
                archive.writestr(path, content or "")
        name = f"{place}/{block}.zip"
        mark = f"{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(mark) as sink:
            sink.write(out.getbuffer())
        system.move(mark, name)
        return pa.table({"project_id": [project], "archive": [name], "files": pa.array([table.num_rows], pa.int64())})

    rows = files.where("path is not null").select(F.coalesce("project_id", F.lit("")).alias("project_id"), F.floor(F.col("file_ord") / most).cast("long").alias("block"), "path", "content")
    return rows.groupBy("project_id", "block").applyInArrow(run, "project_id string, archive string, files long")
