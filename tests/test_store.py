"""The store: uploads at once with a reader between, late commits beside a compaction, retention, vacuum, odd rows."""

import threading
import time

import pytest

from lodestone import schemas
from lodestone.sources.store import Store


def files(spark, rows):
    return spark.createDataFrame([(p, k, path, c) for k, (p, path, c) in enumerate(rows)], schemas.SOURCE_FILE)


def held(store, **asked):
    return sorted((r.project_id, r.path, r.content) for r in store.load(**asked).collect())


def test_uploads_at_once_and_a_reader(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert held(store) == [] and store.projects().count() == 0
    store.save(files(spark, [("p", "a.py", "0"), ("q", "a.py", "0")]))
    before, failures = store.load(), []

    def upload(k):
        try:
            Store(spark, store.path).save(files(spark, [("p", f"{k}.py", str(k)), ("p", "a.py", str(k))]))
        except Exception as e:  # noqa: BLE001
            failures.append(e)

    threads = [threading.Thread(target=upload, args=(k,)) for k in (1, 2)]
    for t in threads:
        t.start()
    while any(t.is_alive() for t in threads):
        seen = {(p, f) for p, f, _ in held(store)}
        assert {("p", "a.py"), ("q", "a.py")} <= seen
    for t in threads:
        t.join()
    got = held(store)
    assert not failures and len(got) == 4 and {r[:2] for r in got} == {("p", "1.py"), ("p", "2.py"), ("p", "a.py"), ("q", "a.py")}
    assert got[2][2] in ("1", "2") and sorted((r.path, r.content) for r in before.collect()) == [("a.py", "0"), ("a.py", "0")]


def test_late_commits_beside_a_compaction(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.save(files(spark, [("p", "a.py", "old"), ("p", "b.py", "old"), ("q", "c.py", "x")]))
    seen = store.live()
    store.save(files(spark, [("p", "a.py", "new"), ("p", "d.py", "new")]))
    # a compaction that had listed the commits before the second upload, and one more that had too
    for _ in range(2):
        now, own = time.time_ns() // 1000, f"c{time.time_ns()}"
        store._write(store._rows(seen), own)
        store._commit(own, now, added=True, compacted=True, replaces=[c.id for c in seen])
        assert held(store) == [("p", "a.py", "new"), ("p", "b.py", "old"), ("p", "d.py", "new"), ("q", "c.py", "x")]
    store.compact()
    assert len(store.live()) == 1 and held(store, project="p") == [("p", "a.py", "new"), ("p", "b.py", "old"), ("p", "d.py", "new")]
    assert store.vacuum() == 0 and store.vacuum(-1) == 4 and len(store.commits()) == 1 and len(held(store)) == 4
    store.save(files(spark, [("p", "b.py", "newest")]))
    assert held(store, project="p")[1] == ("p", "b.py", "newest")
    assert "PushedFilters: [IsNotNull(project_id), EqualTo(project_id,p)]" in store.load("p")._jdf.queryExecution().toString()


def test_retention_replacement_and_times(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    for p in "abc":
        store.save(files(spark, [(p, "x.py", "1"), (p, "y.py", "1")]))
    mark = store.commits()[-1].at
    assert {r.project_id: r.keep for r in store.retain(2).collect()} == {"a": False, "b": True, "c": True}
    store.save(files(spark, [("b", "x.py", "2")]), replace=True)
    assert held(store) == [("b", "x.py", "2"), ("c", "x.py", "1"), ("c", "y.py", "1")] and len(held(store, as_of=mark)) == 6
    store.compact()
    store.save(files(spark, [("a", "z.py", "3")]))
    assert store.delete("c") and not store.delete("c") and not store.delete("none")
    assert held(store) == [("a", "z.py", "3"), ("b", "x.py", "2")]
    assert {(r.project_id, r.files, r.bytes) for r in store.projects().collect()} == {("a", 1, 1), ("b", 1, 1)}
    with pytest.raises(ValueError, match="no project id"):
        store.delete("")


def test_odd_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.save(files(spark, [(None, "a.py", "x"), ("p", None, "x"), ("p", "a.py", None), ("p", "a.py", "last"), ("p/..", "é b.py", "")]))
    store.save(files(spark, []))
    assert held(store) == [("p", "a.py", "last"), ("p/..", "é b.py", "")]
