"""The interval join of cursors and functions against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import symbols

FN = "project_id string, file_ord long, path string, name string, line int, end_line int, fn_ord int"
POINT = "project_id string, file_ord long, line int, symbol string"


@pytest.mark.parametrize("longest", [6, 90, 3000])
def test_against_a_plain_search(spark, longest):
    rng = random.Random(longest)
    fns, points = [], []
    for file in range(6):
        for k in range(rng.choice([0, 1, 25])):
            a = rng.randint(1, longest)
            fns.append(("p", file, "x", f"f{rng.randint(0, 9)}", a, a + rng.randint(-1, longest), k))
        points += [("p", file, rng.randint(0, 2 * longest), rng.choice(["f1", "f2", None, "none"])) for _ in range(40)]
    points.append(("q", 1, 5, "f1"))

    def plain(p, file, line, symbol):
        own = [f for f in fns if f[:2] == (p, file)]
        around = max(((f[4], f[6], f[3]) for f in own if f[4] <= line <= f[5]), default=None)
        return (around or min(((f[4], f[6], f[3]) for f in own if f[3] == symbol), default=(None,) * 3))[2]

    found = symbols.enclosing(spark.createDataFrame([*points, points[0]], POINT), spark.createDataFrame(fns, FN)).collect()
    assert sorted(map(tuple, found), key=str) == sorted({(*p, plain(*p)) for p in points}, key=str)


def test_blocks_cover_each_line_once(spark):
    rows = [(a, b) for a in (1, 7, 8, 9, 63, 64, 500) for b in (a, a + 1, a + 7, a + 64, a + 4000)] + [(1, 8**9), (5, 4)]
    for r in spark.createDataFrame(rows, "a long, b long").select("a", "b", symbols._blocks(F.col("a"), F.col("b")).alias("x")).collect():
        at = r.a
        for lo, hi in sorted((n * 8**k, (n + 1) * 8**k) for k, n in r.x):
            assert lo == at
            at = hi
        assert at == r.b + 1 or r.b < r.a and not r.x


def test_a_file_of_many_functions_and_cursors(spark):
    """A hundred thousand of either in one file: each cursor meets one block of each size at most."""
    n = 100_000
    fns = spark.range(n).select(F.lit("p").alias("project_id"), F.lit(0).cast("long").alias("file_ord"), F.lit("x").alias("path"), F.format_string("f%d", "id").alias("name"), (F.col("id") * 4 + 1).cast("int").alias("line"), (F.col("id") * 4 + 3).cast("int").alias("end_line"), F.col("id").cast("int").alias("fn_ord"))
    whole = spark.createDataFrame([("p", 0, "x", "whole", 1, 4 * n, n)], FN)
    points = spark.range(n).select(F.lit("p").alias("project_id"), F.lit(0).cast("long").alias("file_ord"), (F.col("id") * 4 + F.col("id") % 4 + 1).cast("int").alias("line"), F.lit("none").alias("symbol"))
    # of two functions on line 1 the later one counts
    good = F.when((F.col("line") % 4 == 0) | (F.col("line") == 1), "whole").otherwise(F.format_string("f%d", F.floor((F.col("line") - 1) / 4)))
    found = symbols.enclosing(points, fns.unionByName(whole))
    assert found.count() == n and found.where(F.col("function") != good).count() == 0
