"""Naming smells as rows of names and scopes: one-letter variables, mixed casing, names that hide outer ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .parse import KEYS
from .stepwise import Steps

#: The facts of a parse that `naming_smells` needs.
FACTS = ["bindings", "scopes"]
# Names that casing does not count for; examples shown of each style.
CASING_IGNORED, EXAMPLES = ("self", "cls"), 3


def casing(name: Column) -> Column:
    """snake_case, camelCase, or null for names that tell of neither."""
    core = F.regexp_replace(name, "^_+|_+$", "")
    told = ~name.startswith("__") & (F.length(name) > 1) & (core != "")
    snake = F.when(core == F.lower(core), "snake_case")
    camel = F.when(F.substring(name, 1, 1).rlike(r"^\p{javaLowerCase}") & (name != F.lower(name)), "camelCase")
    return F.when(told, F.when(core.contains("_"), snake).otherwise(camel))


def single_letters(bindings: DataFrame) -> DataFrame:
    """One-letter names that are assigned, each once a line, but for those that a loop or comprehension on that line binds."""
    one = bindings.where((F.col("role") == "assign") & F.col("name").rlike(r"^\p{IsAlphabetic}$"))
    loops = bindings.where("role = 'loop'").select(*KEYS[:2], "name", "line").distinct()
    first = one.join(loops, [*KEYS[:2], "name", "line"], "left_anti").groupBy(*KEYS, "name", "line").agg(F.min("ord").alias("ord"))
    return first.select(*KEYS, F.lit("single_letter_name").alias("kind"), "name", "line", F.format_string("one-letter variable '%s' outside a loop or comprehension", "name").alias("message"), F.lit(0).alias("family"), "ord")


def mixed_casing(parsed: DataFrame) -> DataFrame:
    """Files that have names of both styles, with the first of each. Bindings are in source order and a file is a row, so nothing is shuffled."""
    named = F.transform(F.filter("bindings", lambda b: (b["role"] == "named") & ~b["name"].isin(*CASING_IGNORED)), lambda b: b["name"])
    styled = F.transform(F.array_distinct(named), lambda name: F.struct(name.alias("name"), casing(name).alias("style")))
    few = lambda style: F.slice(F.transform(F.filter("styled", lambda x: x["style"] == style), lambda x: x["name"]), 1, EXAMPLES)
    both = parsed.select(*KEYS, styled.alias("styled")).select(*KEYS, few("snake_case").alias("snake"), few("camelCase").alias("camel")).where((F.size("snake") > 0) & (F.size("camel") > 0))
    message = F.format_string("snake_case (%s) beside camelCase (%s)", F.array_join("snake", ", "), F.array_join("camel", ", "))
    return both.select(*KEYS, F.lit("inconsistent_casing").alias("kind"), F.lit("file").alias("name"), F.lit(1).alias("line"), message.alias("message"), F.lit(1).alias("family"), F.lit(0).alias("ord"))


def shadowed(parsed: DataFrame) -> DataFrame:
    """Functions that bind a name of a scope around them, with the first such name.

    The scopes inside a scope have the numbers from its own to its `last`, so of the scopes that
    bind a name, one before reaches as far as this one just if it is around it. Only names that
    a file binds twice become rows.
    """
    bound = F.array_sort(F.flatten(F.transform("scopes", lambda s: s["names"])))
    again = F.array_distinct(F.array_compact(F.zip_with(bound, F.slice(bound, 2, 1 << 30), lambda a, b: F.when(a == b, a))))
    scopes = parsed.select(*KEYS, again.alias("again"), "scopes").where(F.size("again") > 0).select(*KEYS, "again", F.explode("scopes").alias("x"))
    names = scopes.select(*KEYS, "x.id", "x.last", "x.name", "x.line", F.explode(F.array_intersect("x.names", "again")).alias("bound"))
    before = Window.partitionBy(*KEYS[:2], "bound").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    hidden = names.withColumn("reach", F.max("last").over(before)).where("reach >= id")
    rows = hidden.groupBy(*KEYS, "id", "name", "line").agg(F.min("bound").alias("bound"))
    return rows.select(*KEYS, F.lit("shadowed_name").alias("kind"), "name", "line", F.format_string("'%s' hides a name of an outer scope", "bound").alias("message"), F.lit(2).alias("family"), F.col("id").alias("ord"))


def naming_smells(parsed: DataFrame) -> DataFrame:
    """Keys, `language`, `smell_ord`, `kind`, `name`, `line`, `message` of each smell, by line. Runs at once, step by step; needs FACTS."""
    steps, kept = Steps(parsed.sparkSession, "naming"), Steps(parsed.sparkSession, "naming-found")
    # the files are parsed once
    parsed = steps.keep(parsed.where("language = 'python'").select(*KEYS, *FACTS))
    bindings = parsed.select(*KEYS, F.explode("bindings").alias("x")).select(*KEYS, "x.*")
    rows = single_letters(bindings).unionByName(mixed_casing(parsed)).unionByName(shadowed(parsed))
    order = Window.partitionBy(*KEYS).orderBy("line", "family", "ord")
    result = kept.keep(rows.select(*KEYS, F.lit("python").alias("language"), (F.row_number().over(order) - 1).alias("smell_ord"), "kind", "name", "line", "message"))
    steps.drop()
    return result
