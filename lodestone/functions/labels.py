"""Bands, ranks and complexity labels as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels' order from worst to best, and those that count as hot.
BIG_O_WORST_FIRST = ["O(2^n)", "O(n³)", "O(n²)", "O(n log n)", "O(n)", "O(log n)", "O(1)"]
HOT = ["O(n²)", "O(n³)", "O(2^n)"]
EFFICIENT, MODERATE = ["O(1)", "O(log n)"], ["O(n)", "O(n log n)"]
CC_COLOURS = {"low": "#00f5a0", "medium": "#ffb627", "high": "#ff8a00", "critical": "#ff3366"}
BIG_O_COLOURS = {"O(1)": "#00f5a0", "O(log n)": "#8ef5c0", "O(n)": "#ffb627", "O(n log n)": "#ff8a00", "O(n²)": "#ff3366", "O(n³)": "#ff3366", "O(2^n)": "#ff3366"}
BIG_O_ELSE = "#4a5880"
SEVERITY_RANK = {"High": 0, "Medium": 1, "Low": 2}
HIGH_SMELLS, MEDIUM_SMELLS = ["god_object", "shadowed_name", "circular_dependency"], ["large_class", "inconsistent_casing", "unstable_dependency"]
KIND_ORDER = [
    ["god_object", "large_class", "deep_nesting", "long_function", "excessive_parameters"],
    ["shadowed_name", "inconsistent_casing", "single_letter_name"],
    ["circular_dependency", "unstable_dependency", "high_efferent_coupling"],
]
MARKER_SEVERITY = {"error": 8, "warning": 4, "info": 2, "hint": 1}
NUMERIC_NAMES = ["sort", "search", "compute", "calc", "matrix", "multiply", "fft", "transform", "encode", "decode", "hash", "compress", "convolve"]


def band(value: Column, edges: list[tuple[int, str]], rest: str) -> Column:
    """The name of the first edge that the value does not pass."""
    first, *more = edges
    start = F.when(value <= first[0], first[1])
    return reduce(lambda c, e: c.when(value <= e[0], e[1]), more, start).otherwise(rest)


def mapped(key: Column, values: dict, default=None) -> Column:
    items = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.create_map(*items)[key], F.lit(default))


def cc_band(cc: Column) -> Column:
    return band(cc, [(5, "low"), (10, "medium"), (20, "high")], "critical")


def cc_rank(cc: Column) -> Column:
    """A to F; a complexity of 0 is out of range and falls to F."""
    return F.when(cc < 1, "F").otherwise(band(cc, [(5, "A"), (10, "B"), (20, "C"), (30, "D"), (40, "E")], "F"))


def cc_label(cc: Column) -> Column:
    return band(cc, [(4, "simple"), (7, "moderate"), (10, "complex")], "very complex")


def big_o_band(big_o: Column) -> Column:
    return F.when(big_o.isin(EFFICIENT), "efficient").when(big_o.isin(MODERATE), "moderate").otherwise("expensive")


def is_hot(big_o: Column, quartic: bool = False) -> Column:
    return big_o.isin([*HOT, "O(n^4)"] if quartic else HOT)


def worst_big_o(labels: Column) -> Column:
    """The worst known label of an array; unknown ones only if there is nothing else; O(1) if empty."""
    known = F.filter(F.array(*map(F.lit, BIG_O_WORST_FIRST)), lambda x: F.array_contains(labels, x))
    return F.coalesce(F.get(known, F.lit(0)), F.get(labels, F.lit(0)), F.lit("O(1)"))


def health_tier(score: Column) -> Column:
    return F.when(score >= 80, "ok").when(score >= 50, "warn").otherwise("err")


def mi_band(mi: Column) -> Column:
    return F.when(mi > 70, "ok").when(mi > 40, "warn").otherwise("err")


def lint_score_band(score: Column) -> Column:
    return F.when(score >= 8, "ok").when(score >= 5, "warn").otherwise("err")


def issue_count_band(n: Column) -> Column:
    return F.when(n > 20, "err").when(n > 5, "warn").otherwise("ok")


def smell_severity(kind: Column) -> Column:
    """By kind of smell."""
    return F.when(kind.isin(HIGH_SMELLS), "High").when(kind.isin(MEDIUM_SMELLS), "Medium").otherwise("Low")


def kind_rank(kind: Column) -> Column:
    """The order of kinds within their family."""
    return mapped(kind, {k: n for family in KIND_ORDER for n, k in enumerate(family)}, 99)


def big_o_colour(big_o: Column) -> Column:
    return mapped(big_o, BIG_O_COLOURS, BIG_O_ELSE)


def big_o_order(big_o: Column) -> Column:
    """From the best label to the worst; unknown ones come first."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, reversed(BIG_O_WORST_FIRST))), big_o), F.lit(0)) - 1, F.lit(-1))


def big_o(depth: Column, recursive: Column, split: Column) -> Column:
    """Ordered rules on loop depth, recursion and halving."""
    return (
        F.when((depth == 0) & ~recursive, "O(1)")
        .when((depth == 1) & split, "O(log n)")
        .when((depth == 1) & recursive, "O(n log n)")
        .when(depth == 1, "O(n)")
        .when(depth == 2, "O(n²)")
        .when(depth == 3, "O(n³)")
        .when(depth >= 4, F.concat(F.lit("O(n^"), depth.cast("string"), F.lit(")")))
        .when(recursive & ~split, "O(2^n)")
        .otherwise("O(n)")
    )


def big_o_light(loops: Column, recursive: Column, halves: Column) -> Column:
    """The editor's quick rule: number of loops, not depth."""
    return F.when(recursive, "O(2^n)").when(loops >= 3, "O(n³)").when(loops == 2, "O(n²)").when((loops == 1) & halves, "O(log n)").when(loops == 1, "O(n)").otherwise("O(1)")


def theta_omega(label: Column, early: Column) -> tuple[Column, Column]:
    inner = F.substring(label, 2, 1000)
    theta = F.when(early, F.concat(F.lit("varies between Ω(1) and O"), inner)).otherwise(F.concat(F.lit("Θ"), inner))
    return theta, F.when(early, "Ω(1)").otherwise(F.concat(F.lit("Ω"), inner))


def degree_of(label: Column) -> Column:
    """The polynomial degree of a label; null for logarithms and exponentials."""
    power = F.regexp_extract(label, r"^O\(n\^(\d+)\)$", 1)
    return F.when(label == "O(1)", 0).when(label.isin("O(n)", "O(n log n)"), 1).when(label == "O(n²)", 2).when(label == "O(n³)", 3).when(power != "", power.cast("int"))


def exponent_label(e: Column) -> Column:
    whole = F.abs(e - F.round(e)) < 1e-6
    k = F.round(e).cast("int")
    return F.when(whole & (k == 0), "1").when(whole & (k == 1), "n").when(whole, F.concat(F.lit("n^"), k.cast("string"))).otherwise(F.format_string("n^%.3f", e))


def master_theorem(a: Column, c: Column) -> tuple[Column, Column]:
    """For T(n) = a T(n/2) + n^c: the recurrence and the inside of its tight bound."""
    work = F.when(c == 0, "Θ(1)").when(c == 1, "Θ(n)").otherwise(F.concat(F.lit("Θ(n^"), c.cast("string"), F.lit(")")))
    recurrence = F.concat(F.lit("T(n) = "), a.cast("string"), F.lit("T(n/2) + "), work)
    power = F.log2(a.cast("double"))
    tie = F.when(c == 0, "log n").otherwise(F.concat(exponent_label(c.cast("double")), F.lit(" log n")))
    inside = F.when(F.abs(c - power) < 1e-9, tie).when(c < power, exponent_label(power)).otherwise(exponent_label(c.cast("double")))
    return recurrence, inside


def space(growth: Column, recursive: Column, split: Column) -> Column:
    return F.when(growth >= 2, "O(n²)").when(growth == 1, "O(n)").when(recursive & split, "O(log n)").when(recursive, "O(n)").otherwise("O(1)")


def maintainability(volume: Column, cc: Column, sloc: Column, comment_ratio: Column) -> Column:
    """0 to 100 in two decimals; null without source lines or volume."""
    raw = 171 - 5.2 * F.ln(volume) - 0.23 * cc - 16.2 * F.ln(sloc) + 50 * F.sin(F.sqrt(2.4 * comment_ratio))
    return F.when((sloc > 0) & (volume > 0), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100 / 171)), 2))


def halstead(h: Column) -> dict[str, Column]:
    """Derived measures of a struct of the four counts."""
    n1, n2, t1, t2 = (h[x].cast("double") for x in ("distinct_operators", "distinct_operands", "total_operators", "total_operands"))
    vocabulary, length = n1 + n2, t1 + t2
    volume = F.when(vocabulary == 0, 0.0).otherwise(length * F.log2(vocabulary))
    difficulty = F.when(n2 == 0, 0.0).otherwise(n1 / 2 * t2 / n2)
    return {"vocabulary": vocabulary.cast("long"), "length": length.cast("long"), "volume": volume, "difficulty": difficulty, "effort": difficulty * volume}


def is_numeric_name(name: Column) -> Column:
    return F.lower(name).rlike("|".join(NUMERIC_NAMES))


def wasm_priority(label: Column, cc: Column, loc: Column, name: Column) -> Column:
    return F.when(is_hot(label), 3).otherwise(0) + F.when(cc >= 5, 2).otherwise(0) + F.when(loc >= 30, 1).otherwise(0) + F.when(is_numeric_name(name), 2).otherwise(0)


def speedup(label: Column, cc: Column, language: Column) -> Column:
    """What a hint promises, by the language that a function is in."""
    # Fixed values
    return F.when(language.isin("c", "cpp"), "2-10x vs JavaScript").when(language.isin("javascript", "typescript"), "3-20x for numeric work").otherwise(_python_speedup(label, cc))


def _python_speedup(label: Column, cc: Column) -> Column:
    return F.when(label.isin("O(n³)", "O(2^n)"), "10-100x").when(label == "O(n²)", "5-30x").when(cc >= 10, "2-10x").otherwise("1.5-3x")
