"""Graphs over files and functions: import resolution, degrees, hubs, coupling, cycles, call graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, text
from .cycles import simple_cycles
from .parse import KEYS

#: More internal imports than this are high coupling; used by as many and unstable beyond the share.
HIGH_EFFERENT, UNSTABLE_USERS, UNSTABLE_SHARE = 15, 3, 0.5
HUBS, HUB_DEGREE, MOST_CYCLES = 5, 2, 20


def candidates(module: Column, path: Column) -> Column:
    """The paths that an import may mean, in order of preference: the importer's folder, then none."""
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    relative = F.regexp_replace(module, "^[./]+", "")
    last = F.element_at(F.split(module, "/"), -1)
    base = F.when(module.startswith("."), F.element_at(F.split(relative, "/"), -1)).otherwise(F.element_at(F.split(last, r"\."), -1))

    def files(stem: Column, index: bool = True) -> list[Column]:
        plain = [F.concat(stem, F.lit(s)) for s in (".py", ".ts", ".js")]
        return plain + ([F.concat(stem, F.lit(s)) for s in ("/index.ts", "/index.js")] if index else [])

    none = F.array().cast("array<string>")
    near = F.when(folder != "", F.array(*files(F.concat(folder, F.lit("/"), base)))).otherwise(none)
    given = F.when((folder != "") & module.startswith("."), F.array(*files(F.concat(folder, F.lit("/"), relative), False))).otherwise(none)
    return F.array_distinct(F.concat(near, given, F.array(*files(base))))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """`project_id`, `src`, `dst`, `via`, `line`: of each import the first candidate that is another file of the project; of equal edges the first import's.

    The candidates are at most thirteen a row, the join is on the exact path, and both
    choices are a min of a struct, so they combine before the shuffle.
    """
    tried = imports.select("project_id", F.col("file_ord").alias("src_ord"), F.col("path").alias("src"), "import_ord", F.col("module").alias("via"), "line", F.posexplode(candidates(F.col("module"), F.col("path"))).alias("k", "dst"))
    known = files.select("project_id", F.col("path").alias("dst")).distinct()
    found = tried.where(F.col("src") != F.col("dst")).join(known, ["project_id", "dst"])
    first = found.groupBy("project_id", "src", "src_ord", "import_ord").agg(F.min(F.struct("k", "dst", "via", "line")).alias("x"))
    edges = first.groupBy("project_id", "src", F.col("x.dst").alias("dst")).agg(F.min(F.struct("src_ord", "import_ord", F.col("x.via").alias("via"), F.col("x.line").alias("line"))).alias("y"))
    return edges.select("project_id", "src", "dst", "y.via", "y.line")


def degrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree of every file, centrality, instability and the hub flag."""
    incoming = edges.groupBy("project_id", F.col("dst").alias("path")).agg(F.count("*").alias("in_degree"))
    outgoing = edges.groupBy("project_id", F.col("src").alias("path")).agg(F.count("*").alias("out_degree"))
    size = files.groupBy("project_id").agg(F.count("*").alias("n"))
    nodes = files.select(*KEYS).join(incoming, ["project_id", "path"], "left").join(outgoing, ["project_id", "path"], "left").fillna(0, ["in_degree", "out_degree"]).join(size, "project_id")
    both = F.col("in_degree") + F.col("out_degree")
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("in_degree"), "file_ord"))
    # only nodes that could be hubs are ranked: fewer than all land in a project's window
    hubs = nodes.where(F.col("in_degree") >= HUB_DEGREE).withColumn("rank", rank).where(F.col("rank") <= HUBS).select("project_id", "path", F.lit(True).alias("is_hub"))
    out = nodes.select(
        *KEYS,
        "in_degree",
        "out_degree",
        F.when(F.col("n") > 1, F.round(both / (F.col("n") - 1), 3)).otherwise(F.lit(0.0)).alias("centrality"),
        F.when(both > 0, F.col("out_degree") / both).otherwise(F.lit(0.0)).alias("instability"),
    )
    return out.join(hubs, ["project_id", "path"], "left").withColumn("is_hub", F.coalesce("is_hub", F.lit(False)))


def entry_points(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that no other imports; `isolated`: that import none either."""
    targets = edges.select("project_id", F.col("dst").alias("path")).distinct()
    sources = edges.select("project_id", F.col("src").alias("path")).distinct().withColumn("imports", F.lit(True))
    return files.select(*KEYS).join(targets, ["project_id", "path"], "left_anti").join(sources, ["project_id", "path"], "left").select(*KEYS, F.col("imports").isNull().alias("isolated"))


def coupling_smells(nodes: DataFrame) -> DataFrame:
    high = nodes.where(F.col("out_degree") > HIGH_EFFERENT).select("project_id", F.lit("high_efferent_coupling").alias("kind"), F.col("path").alias("name"), F.lit(0).alias("line"), F.format_string("%d internal imports (> 15)", "out_degree").alias("message"))
    bad = (F.col("in_degree") >= UNSTABLE_USERS) & (F.col("instability") > UNSTABLE_SHARE)
    unstable = nodes.where(bad).select("project_id", F.lit("unstable_dependency").alias("kind"), F.col("path").alias("name"), F.lit(0).alias("line"), F.format_string("%d files depend on it, it on %d: instability %.2f", "in_degree", "out_degree", "instability").alias("message"))
    return high.unionByName(unstable)


def cycles(edges: DataFrame, most: int = MOST_CYCLES) -> DataFrame:
    """Simple cycles, shortest first, then by their nodes from the least one; up to `most` a project. Runs at once, step by step."""
    return simple_cycles(edges, most)


def cycle_summary(found: DataFrame) -> DataFrame:
    """Of each project the cycles and the files in any."""
    return found.select("project_id", "cycle_id", F.explode("nodes").alias("path")).groupBy("project_id").agg(F.countDistinct("cycle_id").alias("cycles"), F.countDistinct("path").alias("files"))


def max_in_degree(nodes: DataFrame) -> DataFrame:
    """Of each project the most imports of one file; 0 without edges."""
    return nodes.groupBy("project_id").agg(F.coalesce(F.max("in_degree"), F.lit(0)).alias("max_in_degree"))


def cycle_smells(found: DataFrame) -> DataFrame:
    name = F.concat(F.array_join("nodes", " → "), F.lit(" → "), F.element_at("nodes", 1))
    return found.select("project_id", F.lit("circular_dependency").alias("kind"), name.alias("name"), F.lit(0).alias("line"), F.format_string("%d files import one another in a circle", "length").alias("message"))


def cycle_members(found: DataFrame) -> DataFrame:
    return found.select("project_id", F.explode("nodes").alias("path")).distinct()


def cycle_edges(found: DataFrame) -> DataFrame:
    """The edges on any of the cycles, each once."""
    following = F.concat(F.slice("nodes", 2, 1 << 30), F.slice("nodes", 1, 1))
    return found.select("project_id", F.explode(F.arrays_zip(F.col("nodes").alias("src"), following.alias("dst"))).alias("x")).select("project_id", "x.src", "x.dst").distinct()


def with_cycle_flags(nodes: DataFrame, edges: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with `in_cycle` and the numbers of their `cycles`, and edges with `is_cycle`."""
    own = found.select("project_id", "cycle_id", F.explode("nodes").alias("path")).groupBy("project_id", "path").agg(F.sort_array(F.collect_list("cycle_id")).alias("cycles"))
    nodes = nodes.join(own, ["project_id", "path"], "left").withColumn("in_cycle", F.col("cycles").isNotNull()).withColumn("cycles", F.coalesce("cycles", F.array().cast("array<int>")))
    flagged = edges.join(cycle_edges(found).withColumn("is_cycle", F.lit(True)), ["project_id", "src", "dst"], "left")
    return nodes, flagged.withColumn("is_cycle", F.coalesce("is_cycle", F.lit(False)))


def module_cycles(imports: DataFrame, most: int = 5) -> DataFrame:
    """A file's own cycles of modules: edges from the first to the last part of each dotted import."""
    parts = F.split("module", r"\.")
    own = imports.where(F.size(parts) > 1).select(F.concat_ws("#", "project_id", "file_ord").alias("project_id"), F.element_at(parts, 1).alias("src"), F.element_at(parts, -1).alias("dst"))
    return cycles(own, most)


def call_graph(fns: DataFrame) -> DataFrame:
    """Call edges inside files, with the file of the callee: the project's last definition of the name, else the caller's own."""
    from .parse import file_calls

    last = fns.groupBy("project_id", F.col("name").alias("callee")).agg(F.max_by("path", F.struct("file_ord", "fn_ord")).alias("callee_path"))
    return file_calls(fns).join(last, ["project_id", "callee"], "left").select("project_id", "file_ord", "path", "caller", "callee", F.coalesce("callee_path", "path").alias("callee_path"))


def active_functions(fns: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions on a call edge; all of them if a project has none."""
    ends = calls.select("project_id", F.explode(F.array("caller", "callee")).alias("name")).distinct()
    without = fns.select("project_id").distinct().join(ends.select("project_id").distinct(), "project_id", "left_anti")
    rest = fns.join(without, "project_id", "left_semi").select("project_id", "name").distinct()
    return ends.unionByName(rest)


def heatmap(fns: DataFrame) -> DataFrame:
    """Each function with its bands and sort key: ascending `heat`, then falling complexity."""
    cc, big_o = labels.cc_band(F.col("complexity")), labels.big_o_band(F.col("big_o"))
    cc_rank = F.when(cc == "critical", 0).when(cc.isin("high", "medium"), 1).otherwise(3)
    big_o_rank = F.when(big_o == "expensive", 0).when(big_o == "moderate", 2).otherwise(3)
    return fns.select(*KEYS, "fn_ord", "name", "line", "complexity", "big_o", cc.alias("cc_level"), labels.mapped(cc, labels.CC_COLOURS).alias("colour"), big_o.alias("big_o_level"), labels.big_o_colour(F.col("big_o")).alias("big_o_colour"), (cc_rank + big_o_rank).alias("heat"))


def ordered_heatmap(rows: DataFrame) -> DataFrame:
    """Hottest first: falling urgency, then falling complexity, then as they stand."""
    return rows.orderBy("project_id", "heat", F.desc("complexity"), "file_ord", "fn_ord")


def call_nodes(fns: DataFrame, active: DataFrame) -> DataFrame:
    """The functions of a call graph with their colours; `hot`: of an expensive label."""
    big_o = labels.big_o_band(F.col("big_o"))
    first = fns.join(active, ["project_id", "name"], "left_semi").groupBy("project_id", "name").agg(F.min(F.struct("file_ord", "fn_ord", "path", "line", "complexity", "big_o")).alias("x")).select("project_id", "name", "x.*")
    return first.withColumns({"level": big_o, "colour": labels.big_o_colour(F.col("big_o")), "hot": big_o == "expensive"})


def heatmap_summary(rows: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(c).alias
    return rows.groupBy("project_id").agg(
        F.count("*").alias("total"),
        F.round(F.avg("complexity"), 2).alias("avg_cc"),
        F.count_if(F.col("cc_level").isin("critical", "high")).alias("hot"),
        F.count_if(F.col("big_o_level") == "expensive").alias("expensive"),
        *(count(F.col("cc_level") == level)(level) for level in ("low", "medium", "high", "critical")),
    )


def with_short_names(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"label": text.short_name(F.col("path")), "node": text.safe_id(F.col("path"))})
