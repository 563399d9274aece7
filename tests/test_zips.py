"""The archives' data source: shares of a large archive, broken ones, lying sizes, filters that are pushed down, packing twice."""

import io
import zipfile

import pytest

from lodestone import schemas
from lodestone.sources import files, zips


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "big.zip").write_bytes(archive([(f"src/m_{k}.py", f"x = {k}\n" * 200) for k in range(200)] + [("node_modules/a.js", "a"), ("run.exe", "a"), ("../up.ts", "é"), ("empty.py", "")]))
    (tmp_path / "deep" / "one.zip").write_bytes(archive([("a.py", "a"), ("a.py", "b")]))
    (tmp_path / "none.zip").write_bytes(archive([]))
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 and no more")
    (tmp_path / "void.zip").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"no archive")
    raw = bytearray(archive([("good.py", "good"), ("bad.py", "wxyz")]))
    at = raw.index(b"wxyz")
    raw[at : at + 4] = b"wxyq"
    (tmp_path / "damaged.zip").write_bytes(bytes(raw))
    return str(tmp_path)


def test_every_member_once(spark, folder):
    zips.register(spark)
    for part in (1 << 30, 40_000, 3_000):
        rows = spark.read.format("code_zip").option("partBytes", part).load(folder)
        got = rows.collect()
        big = [r for r in got if r.project_id == "big"]
        assert sorted(r.member for r in big) == list(range(204)) and sum(r.status == "extracted" for r in big) == 202
        assert {r.path: r.status for r in big if not r.path.startswith("src/")} == {"node_modules/a.js": "skipped", "run.exe": "skipped", "up.ts": "extracted", "empty.py": "extracted"}
        assert [bytes(r.content) for r in sorted((r for r in got if r.project_id == "deep"), key=lambda r: r.member)] == [b"a", b"b"]
        assert {r.project_id for r in got if r.status == "error: not a zip archive"} == {"broken", "void"}
        assert sorted((r.path, r.status[:5]) for r in got if r.project_id == "damaged") == [("bad.py", "error"), ("good.py", "extra")]
        assert len(got) == 204 + 2 + 2 + 2 and (rows.rdd.getNumPartitions() > 10) == (part == 3_000)


def test_filters_leave_out_archives_and_members(folder):
    reader = zips.PushedZipReader({"path": folder, "partBytes": "3000"})
    other = zips.EqualTo(("status",), "extracted")
    assert list(reader.pushFilters([zips.In(("project_id",), ("big", "deep")), zips.EqualTo(("suffix",), ".ts"), other])) == [other]
    parts = reader.partitions()
    assert {s[0] for p in parts for s in p.shares} == {"big", "deep"}
    assert [b.column("path")[0].as_py() for p in parts for b in reader.read(p)] == ["up.ts"]


def test_filters_give_equal_rows(spark, folder):
    zips.register(spark)
    ask = lambda pushed: sorted(r.path for r in spark.read.format("code_zip").option("pushFilters", pushed).load(folder).where("project_id = 'big' and suffix = '.py' and status = 'extracted'").collect())
    assert ask(True) == ask(False) and len(ask(True)) == 201


def test_no_archive_and_no_path(spark, tmp_path):
    assert zips.read(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError, match="needs a path"):
        zips.ZipReader({})


def test_over_the_limit_whatever_the_directory_says(monkeypatch):
    monkeypatch.setattr(zips, "MEMBER_BYTES", 3)
    assert [(r["path"], r["status"]) for r in files.members(archive([("a.py", "abc"), ("b.py", "abcd")]))] == [("a.py", "extracted"), ("b.py", "skipped")]


def test_pack_and_read_back(spark, tmp_path):
    rows = [("p", k, f"d/{k}.py", "x" * k) for k in range(20)] + [("q/r", 3, "a.ts", None), ("q/r", 4, None, "lost")]
    made = zips.pack(spark.createDataFrame(rows, schemas.SOURCE_FILE), str(tmp_path), most=8)
    for _ in range(2):
        assert sorted((r.project_id, r.files) for r in made.collect()) == [("p", 4), ("p", 8), ("p", 8), ("q/r", 1)]
    got = zips.read(spark, str(tmp_path)).collect()
    assert sorted((r.project_id, r.path, r.bytes) for r in got) == sorted([("p", f"d/{k}.py", k) for k in range(20)] + [("q_r", "a.ts", 0)])
