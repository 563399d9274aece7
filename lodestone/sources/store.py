"""The project store: Parquet files that count once a commit names them.

A commit is a small JSON file that appears whole, by a rename: which data folder it adds, which
earlier commits it takes the place of, and which projects it empties. Commits never conflict:
of equal paths the row saved later counts (ties: the greater commit id), and a project's rows
saved before it was emptied do not. So uploads, retention and compaction may run at once, from
several drivers, and a reader has the commits that it listed. Their clocks decide what is later.
Data lies sorted by project and path, so that a project's rows are found by Parquet's statistics.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tree

ROWS = "project_id string, file_ord long, path string, content string, saved long, commit_id string"
COMMIT = "id string, at long, added boolean, compacted boolean, replaces array<string>, emptied map<string, long>"
KEY = ["project_id", "path"]
DAY = 24 * 3600


class Store:
    """Files of projects under one folder. Rows of a null project or path belong to nothing and are left out."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _commit(self, own: str, at: int, added: bool = False, compacted: bool = False, replaces: list[str] | None = None, emptied: dict[str, int] | None = None) -> str:
        text = json.dumps({"id": own, "at": at, "added": added, "compacted": compacted, "replaces": replaces or [], "emptied": emptied or {}})
        system, hidden = self._hadoop(f"{self.path}/commits/.{own}")
        out = system.create(hidden, True)
        out.write(text.encode())
        out.close()
        if not system.rename(hidden, self._hadoop(f"{self.path}/commits/{own}.json")[1]):
            raise OSError(f"commit {own} was not renamed")
        return own

    def _write(self, rows: DataFrame, own: str) -> None:
        rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.parquet(f"{self.path}/data/{own}")

    def commits(self) -> list:
        """All commits, the earliest first: as many as uploads since the last vacuum, a line each."""
        system, folder = self._hadoop(f"{self.path}/commits")
        rows = self.spark.read.schema(COMMIT).json(f"{self.path}/commits/*.json").collect() if system.exists(folder) and len(system.listStatus(folder)) else []
        return sorted(rows, key=lambda c: (c.at, c.id))

    def live(self, as_of: int | None = None) -> list:
        """Commits that nothing takes the place of, as of a time in microseconds."""
        known = [c for c in self.commits() if as_of is None or c.at <= as_of]
        gone = {x for c in known for x in c.replaces}
        return [c for c in known if c.id not in gone]

    def save(self, files: DataFrame, replace: bool = False) -> str:
        """Adds files; equal paths are replaced, or with `replace` all that the projects had, in the same commit. The commit's id."""
        own, at = uuid.uuid4().hex, time.time_ns() // 1000
        newest = files.where("project_id is not null and path is not null").groupBy(*KEY).agg(F.max_by(F.struct("file_ord", "content"), F.struct("file_ord", "content")).alias("x"))
        self._write(newest.select("project_id", "x.file_ord", "path", "x.content", F.lit(at).alias("saved"), F.lit(own).alias("commit_id")), own)
        emptied = {r.project_id: at for r in self._read([own]).select("project_id").distinct().toLocalIterator()} if replace else {}
        return self._commit(own, at, added=True, emptied=emptied)

    def _read(self, ids: list[str]) -> DataFrame:
        if not ids:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(*[f"{self.path}/data/{i}" for i in ids])

    def _rows(self, live: list, project: str | None = None) -> DataFrame:
        """The rows that count. Those of one compaction are unique: they are only held against the keys of what came beside it."""
        own = (lambda df: df) if project is None else (lambda df: df.where(F.col("project_id") == project))
        whole = [c for c in live if c.compacted]
        base = whole[0] if len(whole) == 1 else None
        beside = own(self._read([c.id for c in live if c.added and c is not base]))
        newest = beside.groupBy(*KEY).agg(F.max_by(F.struct("file_ord", "content", "saved", "commit_id"), F.struct("saved", "commit_id")).alias("x")).select("project_id", "x.file_ord", "path", "x.content", "x.saved", "x.commit_id")
        if base is not None:
            old, new = own(self._read([base.id])), newest
            later = lambda a, b: F.struct(a.saved, a.commit_id) > F.struct(b.saved, b.commit_id)
            same = lambda a, b: (a.project_id == b.project_id) & (a.path == b.path) & later(b, a)
            a, b = old.alias("a"), new.select(*KEY, "saved", "commit_id").alias("b")
            kept = a.join(b, same(_Of("a"), _Of("b")), "left_anti")
            if any(c.added and c.at <= base.at for c in live if c is not base):
                # something was saved before the compaction that it did not see
                new = new.alias("a").join(old.select(*KEY, "saved", "commit_id").alias("b"), same(_Of("a"), _Of("b")), "left_anti")
            newest = kept.unionByName(new)
        emptied = self._emptied(live)
        if emptied:
            dead = self.spark.createDataFrame(list(emptied.items()), "project_id string, emptied long")
            newest = newest.join(dead, "project_id", "left").where("emptied is null or saved >= emptied").drop("emptied")
        return newest

    @staticmethod
    def _emptied(live: list) -> dict[str, int]:
        out: dict[str, int] = {}
        for c in live:
            for project, at in (c.emptied or {}).items():
                out[project] = max(at, out.get(project, at))
        return out

    def load(self, project: str | None = None, as_of: int | None = None) -> DataFrame:
        return self._rows(self.live(as_of), project).select("project_id", "file_ord", "path", "content")

    def projects(self) -> DataFrame:
        """`project_id`, `files`, `bytes`, `mtime` (microseconds of the last file saved)."""
        return self._rows(self.live()).groupBy("project_id").agg(F.count("*").alias("files"), F.sum(F.coalesce(F.octet_length("content"), F.lit(0))).alias("bytes"), F.max("saved").alias("mtime"))

    def delete(self, *projects: str) -> bool:
        """Empties projects; whether one of them had a file."""
        if not projects or not all(projects):
            raise ValueError("no project id")
        had = bool(self._rows(self.live()).where(F.col("project_id").isin(*projects)).take(1))
        at = time.time_ns() // 1000
        self._commit(uuid.uuid4().hex, at, emptied=dict.fromkeys(projects, at))
        return had

    def retain(self, kept: int) -> DataFrame:
        """Empties all but the newest `kept` projects, as far as they have not been saved to since they were listed. The projects with `keep`."""
        listed = self.projects().persist()
        try:
            ranked = tree.retention(listed, kept).persist()
            gone = {r.project_id: r.mtime + 1 for r in ranked.where("not keep").select("project_id", "mtime").toLocalIterator()}
            if gone:
                self._commit(uuid.uuid4().hex, time.time_ns() // 1000, emptied=gone)
            return ranked
        finally:
            listed.unpersist()

    def compact(self, seconds: float = DAY) -> str:
        """Writes what counts as one commit in place of all that are live. Emptied projects are remembered for `seconds`, for uploads that were under way."""
        live, own, at = self.live(), uuid.uuid4().hex, time.time_ns() // 1000
        self._write(self._rows(live), own)
        emptied = {p: t for p, t in self._emptied(live).items() if t > at - seconds * 1e6}
        return self._commit(own, at, added=True, compacted=True, replaces=[c.id for c in live], emptied=emptied)

    def vacuum(self, seconds: float = DAY) -> int:
        """Removes the data of commits that were replaced more than `seconds` ago, then the commits. How many; readers have as long as that."""
        known, limit = self.commits(), time.time_ns() // 1000 - seconds * 1e6
        gone = {x for c in known if c.at < limit for x in c.replaces}
        for c in known:
            if c.id in gone:
                for path in (f"{self.path}/data/{c.id}", f"{self.path}/commits/{c.id}.json"):
                    system, place = self._hadoop(path)
                    system.delete(place, True)
        return sum(c.id in gone for c in known)


class _Of:
    """Columns of a side of a join by its alias."""

    def __init__(self, side: str):
        self.project_id, self.path, self.saved, self.commit_id = (F.col(f"{side}.{c}") for c in ("project_id", "path", "saved", "commit_id"))
