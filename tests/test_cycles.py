"""Cycles as joins against the plain search, and the flags that graphs carry."""

import random

import plain_cycles
import pytest
from pyspark.sql import functions as F

from lodestone.operators import cycles, graph
from lodestone.operators.stepwise import Steps
from lodestone.plans.project import Project
from lodestone.sources import files as source


def made(spark, graphs):
    """Named edges of numbered graphs; names sort as numbers do."""
    rows = [(p, f"n{a:04d}", f"n{b:04d}") for p, pairs in graphs.items() for a, b in pairs]
    return spark.createDataFrame(rows, "project_id string, src string, dst string")


def project(spark, texts):
    return source.inline(spark, "p", [{"filename": n, "content": c} for n, c in texts.items()])


def named(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r.cycle_id):
        out.setdefault(r.project_id, []).append([int(n[1:]) for n in r.nodes])
        assert r.length == len(r.nodes) and r.cycle_id == len(out[r.project_id])
    return out


@pytest.mark.parametrize("most", [1, 20])
def test_cycles_against_the_plain_search(spark, most):
    rng = random.Random(most)
    graphs = {}
    for k in range(60 if most > 1 else 12):
        n = rng.randint(2, 9)
        graphs[f"p{k}"] = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 22))]
    graphs[None] = [(1, 2), (2, 1), (3, 4)]
    graphs["ring"] = [(k, (k + 1) % 70) for k in range(70)]
    graphs["chord"] = [*((k, (k * 5 + 3) % 32) for k in range(32)), (0, 30), (30, 4)]
    graphs["two ways"] = [(0, 1), (1, 2), (2, 3), (3, 0), (1, 4), (4, 5), (5, 3), (1, 3), (6, 0), (3, 7)]
    graphs["chain"] = [(k, k + 1) for k in range(40)]
    expected = {p: found for p, pairs in graphs.items() if (found := plain_cycles.shortest_cycles(pairs, most))}
    edges = made(spark, graphs).unionByName(spark.createDataFrame([("p1", None, "n0001"), ("p1", "n0001", None)], "project_id string, src string, dst string"))
    assert named(graph.cycles(edges, most)) == expected


def test_strong_edges_and_chains(spark):
    graphs = {"p": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (5, 6), (7, 0)]}
    steps = Steps(spark, "t")
    strong = cycles.strong_edges(made(spark, graphs), steps)
    assert {(r.component, r.src, r.dst) for r in strong.collect()} == {("n0000", f"n000{a}", f"n000{b}") for a, b in graphs["p"][:3]} | {("n0003", f"n000{a}", f"n000{b}") for a, b in graphs["p"][4:7]}
    ways = cycles.contracted(strong, steps)
    assert {(r.a, r.b, tuple(r.inner)) for r in ways.collect()} == {("n0000", "n0000", ("n0001", "n0002")), ("n0003", "n0003", ("n0004", "n0005"))}
    steps.drop()


def test_no_edges(spark):
    assert graph.cycles(made(spark, {"p": [(1, 1)]})).count() == 0
    assert graph.cycles(made(spark, {"p": [(1, 2)]}).limit(0)).count() == 0


def test_a_project_of_many_edges_is_in_many_tasks(spark):
    """Rings of three in one project: no task of a join or a group sees more than its share of the edges."""
    n = 30_000
    edges = spark.range(n).select(F.lit("p").alias("project_id"), F.format_string("n%06d", "id").alias("src"), F.format_string("n%06d", F.when(F.col("id") % 3 == 2, F.col("id") - 2).otherwise(F.col("id") + 1)).alias("dst"))
    found = graph.cycles(edges, 20).collect()
    assert [r.nodes for r in found] == [[f"n{3 * k + j:06d}" for j in range(3)] for k in range(20)]


def test_flags_of_nodes_and_edges(spark):
    texts = {"a.py": "import b", "b.py": "import c\nimport a", "c.py": "import a", "d.py": "import a"}
    p = Project(project(spark, texts))
    out = p.graph("circular")
    assert {r.path: (r.in_cycle, list(r.cycles)) for r in out["nodes"].collect()} == {"a.py": (True, [1, 2]), "b.py": (True, [1, 2]), "c.py": (True, [2]), "d.py": (False, [])}
    assert {(r.src, r.dst) for r in out["edges"].where("is_cycle").collect()} == {("a.py", "b.py"), ("b.py", "a.py"), ("b.py", "c.py"), ("c.py", "a.py")} and out["edges"].count() == 5
    drawn = out["diagram"].first().diagram
    assert "a_py -.-> b_py" in drawn and "d_py --> a_py" in drawn and "style c_py" in drawn and "style d_py" not in drawn and "OK[" not in drawn
    p.release()
    p = Project(project(spark, {"a.py": "import b", "b.py": "x = 1"}))
    assert "OK[" in p.graph("circular")["diagram"].first().diagram
    p.release()


def test_a_long_chain_of_rings_takes_few_steps(spark):
    m = 150
    number = lambda k: 0 if k == 3 * m - 1 else k + 1
    pairs = [(k, k - 2 if k % 3 == 2 else k + 1) for k in range(3 * m)] + [(k, k + 3) for k in range(0, 3 * m - 3, 3)] + [(k + 1, k) for k in range(0, 3 * m, 9)]
    steps = Steps(spark, "t")
    strong = cycles.strong_edges(made(spark, {"p": [(number(a), number(b)) for a, b in pairs]}), steps)
    assert strong.count() == 3 * m + len(range(0, 3 * m, 9)) and strong.select("component").distinct().count() == m
    assert steps.n < 60  # the least name at the chain's end once went one ring a round
    steps.drop()
