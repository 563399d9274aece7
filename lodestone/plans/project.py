"""The analyses that a caller asks for by name. Each parses its files once and keeps the facts while it works on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import dataflow, graph, lint, logs, ml, naming, parse, render, rollup, symbols, tree
from ..sources import files

GRAPHS = {"import": "imports between files", "call": "calls between functions", "circular": "import cycles", "centrality": "degrees and hubs", "heatmap": "complexity of functions"}

GRAPH_FACTS = ["functions", "imports"]


class Project:
    """Lazy tables of one set of source files. Call `release` when done."""

    def __init__(self, files: DataFrame, facts: list[str] | None = None):
        self.files = files
        self.parsed = parse.parse_files(files, facts).persist()

    def release(self) -> None:
        self.parsed.unpersist()

    @property
    def functions(self) -> DataFrame:
        return parse.with_recurrences(parse.functions(self.parsed))

    @property
    def edges(self) -> DataFrame:
        return graph.import_edges(parse.imports(self.parsed), self.files)

    def report(self) -> dict[str, DataFrame]:
        """The project report: totals, distributions, findings, smells, cycles, scores."""
        fns, edges = self.functions, self.edges.persist()
        nodes = graph.degrees(self.files, edges)
        cycles, coupling = graph.cycles(edges), graph.coupling_smells(nodes)
        findings, structural, names = dataflow.findings(self.parsed), parse.structural_smells(self.parsed), naming.naming_smells(self.parsed)
        return {
            "totals": rollup.with_unused(rollup.totals(self.parsed), parse.unused_imports(self.parsed)),
            "big_o": rollup.big_o_bars(rollup.big_o_distribution(fns)),
            "languages": rollup.languages_by_lines(rollup.language_distribution(self.files, self.parsed)),
            "top": rollup.top_complex(fns),
            "hints": parse.ordered_hints(parse.wasm_hints(fns, self.files)),
            "unused_imports": parse.unused_imports(self.parsed),
            "unused_modules": parse.unused_modules(self.parsed),
            "by_kind": rollup.findings_by_kind(findings, structural, names, coupling.unionByName(graph.cycle_smells(cycles))),
            "findings": rollup.merged_findings(findings, structural, names),
            "architecture": coupling.unionByName(graph.cycle_smells(cycles)),
            "health": rollup.health(self.parsed, findings, names, coupling, cycles),
            "metrics": parse.metrics(self.files, self.parsed),
        }

    def graph(self, kind: str) -> dict[str, DataFrame]:
        """Nodes, edges and a diagram of one of GRAPHS; files of blanks alone have no part."""
        if kind not in GRAPHS:
            raise ValueError(f"{kind!r} is none of {sorted(GRAPHS)}")
        if kind == "call":
            edges = graph.call_graph(self.functions)
            return {"nodes": graph.call_nodes(self.functions, graph.active_functions(self.functions, edges)), "edges": edges, "diagram": render.call_diagram(edges)}
        if kind == "heatmap":
            rows = graph.heatmap(self.functions)
            return {"nodes": graph.ordered_heatmap(rows), "edges": rows.limit(0), "diagram": render.heatmap_diagram(rows), "summary": graph.heatmap_summary(rows)}
        edges = self.edges
        nodes = graph.degrees(self.files, edges)
        out = {"nodes": graph.with_short_names(nodes), "edges": edges, "diagram": render.edges_diagram(nodes, edges), "entries": graph.entry_points(self.files, edges), "most": graph.max_in_degree(nodes)}
        if kind == "circular":
            found = graph.cycles(edges)
            flagged, marked = graph.with_cycle_flags(out["nodes"], edges, found)
            out |= {"nodes": flagged, "edges": marked, "diagram": render.cycle_diagram(flagged, marked), "cycles": found, "members": graph.cycle_members(found), "affected": graph.cycle_summary(found)}
        return out

    def lint(self) -> dict[str, DataFrame]:
        issues = lint.python_lint(self.files, self.parsed).unionByName(lint.script_lint(self.files))
        return {"issues": issues, "cards": lint.issue_cards(issues), "markers": lint.markers(issues), "locations": lint.by_location(issues), "summary": lint.issue_summary(issues)}

    def inspect_ml(self) -> dict[str, DataFrame]:
        found, stages = ml.libraries(parse.imports(self.parsed)), ml.pipeline(self.files)
        issues, models = ml.issues(self.files, found), ml.models(self.files)
        return {"libraries": found, "pipeline": ml.ordered_pipeline(stages), "models": models, "metrics": ml.metrics(self.files), "issues": issues, "score": ml.score(self.files, stages, issues), "suggestions": ml.suggestions(stages, issues, self.files), "diagram": render.chain_diagram(stages, models)}

    def symbols(self) -> dict[str, DataFrame]:
        return {"symbols": symbols.symbols(self.parsed), "references": symbols.references(self.parsed), "completions": symbols.completions(self.parsed), "cards": symbols.hover_cards(self.functions, dataflow.findings(self.parsed))}

    def tree(self) -> DataFrame:
        stats = rollup.file_stats(self.parsed, self.functions, parse.unused_imports(self.parsed))
        return tree.ordered_tree(tree.tree_with_stats(tree.tree(self.files), stats))


def stored(spark: SparkSession, table_path: str, project: str, kind: str) -> dict[str, DataFrame]:
    """A graph of a project that is in the store, with the list of its files and its tree."""
    own = Project(files.load(spark, table_path, project), GRAPH_FACTS)
    return own.graph(kind) | {"files": own.files.select("file_ord", "path").orderBy("path"), "tree": tree.ordered_tree(tree.tree(own.files))}


def analyse_logs(texts: DataFrame) -> dict[str, DataFrame]:
    rows = logs.log_lines(texts)
    return {"problems": logs.problems(rows), "counts": logs.level_counts(rows), "errors": logs.error_lines(rows), "warnings": logs.warning_lines(rows), "error_numbers": logs.error_numbers(rows)}
