"""Project roll-ups: totals, distributions, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, text
from .parse import CLASS_SMELLS, FUNCTION_SMELLS, KEYS


def totals(parsed: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))).cast("long")
    return parsed.groupBy("project_id").agg(F.count("*").alias("files"), n("functions").alias("functions"), n("classes").alias("classes"), n("imports").alias("imports"))


def with_unused(totals: DataFrame, unused: DataFrame) -> DataFrame:
    """Totals with the number of unused imports."""
    return totals.join(unused.groupBy("project_id").agg(F.count("*").alias("unused_imports")), "project_id", "left").fillna(0, ["unused_imports"])


def big_o_bars(distribution: DataFrame) -> DataFrame:
    """A project's labels from best to worst, unknown ones first, with a bar in percent of its longest."""
    most = F.max("functions").over(Window.partitionBy("project_id"))
    return distribution.withColumns({"rank": labels.big_o_order(F.col("big_o")), "bar": F.round(100 * F.col("functions") / most).cast("long"), "colour": labels.big_o_colour(F.col("big_o"))}).orderBy("project_id", "rank", "big_o")


def languages_by_lines(distribution: DataFrame) -> DataFrame:
    return distribution.orderBy("project_id", F.desc("loc"), "language")


def big_o_distribution(fns: DataFrame) -> DataFrame:
    return fns.groupBy("project_id", F.coalesce("big_o", F.lit("?")).alias("big_o")).agg(F.count("*").alias("functions"))


def language_distribution(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files, line feeds and functions by language, with the share of all lines."""
    sizes = files.select(*KEYS[:2], text.line_feeds(F.coalesce("content", F.lit(""))).alias("loc"))
    joined = parsed.select(*KEYS[:2], "language", F.coalesce(F.size("functions"), F.lit(0)).alias("n")).join(sizes, KEYS[:2])
    out = joined.groupBy("project_id", "language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum(F.greatest("n", F.lit(0))).cast("long").alias("functions"))
    share = F.col("loc") / F.greatest(F.sum("loc").over(Window.partitionBy("project_id")), F.lit(1))
    return out.withColumn("percent", F.round(100 * share, 1))


def complexity_summary(fns: DataFrame) -> DataFrame:
    return fns.groupBy("project_id").agg(F.round(F.avg("complexity"), 2).alias("avg_cc"), F.max("loc").alias("max_loc"))


def top_complex(fns: DataFrame, n: int = 10) -> DataFrame:
    return fns.select(*KEYS, "fn_ord", "name", "line", "complexity", "big_o").orderBy(F.desc("complexity"), "file_ord", "fn_ord").limit(n)


def severity_counts(findings: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    out = findings.groupBy("project_id").agg(n("High").alias("high"), n("Medium").alias("medium"), n("Low").alias("low"))
    total = F.greatest(F.col("high") + F.col("medium") + F.col("low"), F.lit(1))
    return out.withColumns({f"{c}_percent": F.round(100 * F.col(c) / total, 0).cast("long") for c in ("high", "medium", "low")})


def security_score(high, medium, low):
    return F.greatest(F.lit(0), 100 - 15 * high - 5 * medium - low).cast("long")


def quality_score(structural, naming, definitions):
    d = F.greatest(F.lit(1), definitions)
    penalty = F.least(F.lit(100), F.round(structural / d * 300 + naming / d * 100))
    return F.greatest(F.lit(0), 100 - penalty).cast("long")


def complexity_score(avg_cc):
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(100 - F.greatest(F.lit(0), avg_cc - 5) * 8))).cast("long")


def architecture_score(cycles, coupling, files):
    return (100 - F.least(F.lit(100), 15 * cycles + F.round(coupling / F.greatest(F.lit(1), files) * 100))).cast("long")


def health_counts(parsed: DataFrame) -> DataFrame:
    """What the scores need of a project's files, in one aggregation over the nested rows."""
    some = lambda c: F.coalesce(F.col(c), F.array())
    size = lambda c: F.size(some(c))
    bad = lambda c, rule: F.size(F.filter(some(c), rule))
    own = parsed.select(
        "project_id",
        size("functions").alias("functions"),
        size("classes").alias("classes"),
        F.aggregate(some("functions"), F.lit(0), lambda a, f: a + F.coalesce(f["complexity"], F.lit(0))).alias("complexity"),
        (sum((bad("functions", rule) for _, rule, _ in FUNCTION_SMELLS), F.lit(0)) + sum((bad("classes", rule) for _, rule, _ in CLASS_SMELLS), F.lit(0))).alias("structural"),
    )
    n = lambda c: F.sum(c).alias(c)
    return own.groupBy("project_id").agg(F.count("*").alias("files"), *map(n, ("functions", "classes", "complexity", "structural")))


def health(parsed: DataFrame, findings: DataFrame, naming: DataFrame, coupling: DataFrame, cycles: DataFrame) -> DataFrame:
    """The four scores of each project: one pass over its files, and a row a project of its findings, names and its graph's smells."""
    count = lambda df, name: df.groupBy("project_id").agg(F.count("*").alias(name))
    out = health_counts(parsed)
    for part in (severity_counts(findings).select("project_id", "high", "medium", "low"), count(naming, "naming"), count(coupling, "coupling"), count(cycles, "cycles")):
        out = out.join(part, "project_id", "left")
    out = out.fillna(0, ["high", "medium", "low", "naming"])
    coupling_n, cycles_n = F.coalesce("coupling", F.lit(0)), F.coalesce("cycles", F.lit(0))
    mean = F.when(F.col("functions") > 0, F.round(F.col("complexity") / F.col("functions"), 2)).otherwise(0.0)
    return out.select(
        "project_id",
        security_score(F.col("high"), F.col("medium"), F.col("low")).alias("security"),
        quality_score(F.col("structural"), F.col("naming"), F.col("functions") + F.col("classes")).alias("quality"),
        complexity_score(mean).alias("complexity"),
        architecture_score(cycles_n, coupling_n, F.col("files")).alias("architecture"),
    )


def file_stats(parsed: DataFrame, fns: DataFrame, unused: DataFrame) -> DataFrame:
    """What a tree shows beside a file."""
    per = fns.groupBy(*KEYS).agg(F.count("*").alias("functions"), F.round(F.avg("complexity"), 1).alias("avg_cc"), F.count_if(labels.is_hot(F.col("big_o"), True)).alias("hot_paths"))
    dead = unused.groupBy(*KEYS).agg(F.count("*").alias("dead"))
    out = parsed.select(*KEYS, F.greatest(F.coalesce(F.size("imports"), F.lit(0)), F.lit(0)).alias("imports")).join(per, KEYS, "left").join(dead, KEYS, "left")
    return out.fillna(0, ["functions", "hot_paths", "dead"]).fillna(0.0, ["avg_cc"])


def merged_findings(findings: DataFrame, structural: DataFrame, naming: DataFrame, most: int | None = None) -> DataFrame:
    """Security and smells as one list, worst first; `most` cuts it."""
    a = findings.select("project_id", "path", F.lit("security").alias("family"), F.col("cwe").alias("kind"), "line", "severity")
    rest = [s.select("project_id", "path", F.lit(f).alias("family"), "kind", "line", labels.smell_severity(F.col("kind")).alias("severity")) for s, f in ((structural, "structural"), (naming, "naming"))]
    out = a.unionByName(rest[0]).unionByName(rest[1]).withColumn("rank", labels.mapped(F.col("severity"), labels.SEVERITY_RANK, 9))
    return out if most is None else out.orderBy("rank", "path", "line", "kind").limit(most)


def findings_by_kind(findings: DataFrame, structural: DataFrame, naming: DataFrame, architecture: DataFrame) -> DataFrame:
    """The four families as a report shows them: findings by severity, smells by their kinds' order."""
    a = findings.select("project_id", F.lit("security").alias("family"), F.lit(0).alias("part"), F.col("cwe").alias("kind"), F.col("path").alias("name"), "line", labels.mapped(F.col("severity"), labels.SEVERITY_RANK, 9).alias("rank"))
    for k, (rows, family) in enumerate(((structural, "structural"), (naming, "naming"), (architecture, "architecture")), 1):
        a = a.unionByName(rows.select("project_id", F.lit(family).alias("family"), F.lit(k).alias("part"), "kind", "name", "line", labels.kind_rank(F.col("kind")).alias("rank")))
    return a.orderBy("project_id", "part", "rank", "name", "line").drop("part")
