"""Patterns and rules as rows: tables of them are tried over files, and a row more is a pattern more.

A text is read once for its words. A pattern that can only match where one of certain whole
words stands is tried in no other text, so that the work for a text grows with the patterns
that its words bring up, not with all of the table. Nothing is shuffled: the table of patterns
goes to the tasks as one value, for which MOST bounds its rows; a larger table is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .parse import KEYS

MOST = 10_000
# `values`: patterns whose first group is a number; `attributes`: what a hit carries.
PATTERN = "kind string, ord int, name string, pattern string, words array<string>, values array<string>, attributes map<string, string>"
# `words` as in PATTERN. All that is given must hold: one of the libraries or modules; every pattern of
# `has` and none of `lacks`; between `at_least` and `at_most` matches of `counted`; `first` before `second` in code.
RULE = (
    "ord int, rule string, severity string, category string, words array<string>, libraries array<string>, modules array<string>, "
    "has array<string>, lacks array<string>, counted string, at_least int, at_most int, first string, second string"
)
_GROUPS = re.compile(r"(?<!\\)[(\[]")
_WHOLE = re.compile(r"(?:(?<!\\)\\b|\\\.|(?<= ))([A-Za-z_]\w*)(?=\\b|\\\.(?![*?{])|\\\((?![*?{])|\\s\*\\\(|\\s(?![*?{])| (?![*?{]))")


def key_words(pattern: str) -> list[str] | None:
    """Whole words, in lower case, one of which stands in every text that the pattern matches; None where that is not plain to see.

    Each alternative gives its longest word with a certain end on both sides: `\\b`, a full stop, a parenthesis or a blank.
    """
    bare = pattern.removeprefix("(?i)")
    if _GROUPS.search(bare):
        return None
    found = [sorted(_WHOLE.findall(part), key=lambda w: (-len(w), w)) for part in bare.split("|")]
    return sorted({own[0].lower() for own in found}) if all(found) else None


def _one_value(rows: DataFrame, fields: list[str]) -> Column:
    """All rows as one array, and all their words: a scalar subquery."""
    many = F.raise_error(F.concat(F.lit(f"more than {MOST} patterns: "), F.count("*").cast("string")))
    known = F.array_distinct(F.flatten(F.collect_list(F.coalesce("words", F.array().cast("array<string>")))))
    return rows.agg(F.when(F.count("*") <= MOST, F.struct(F.collect_list(F.struct(*fields)).alias("rows"), known.alias("words"))).otherwise(many).alias("x")).scalar()


def _with_candidates(files: DataFrame, rows: DataFrame, fields: list[str], **more: Column) -> DataFrame:
    """Files with `tried`, the rows without words and those with a word of the text, and with `more` columns.

    What lambdas ask of a text is made by a generator of one row: as a column it would be put into the lambdas and made again for each pattern.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"\w+"), F.lit(0)))
    held = files.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("every", _one_value(rows, fields))
    once = F.struct(F.array_intersect("every.words", words).alias("held"), *[c.alias(n) for n, c in more.items()])
    held = held.select("*", F.explode(F.array(once)).alias("once"))
    own = F.filter("every.rows", lambda p: p.words.isNull() | F.arrays_overlap(p.words, "once.held"))
    return held.select(*files.columns, own.alias("tried"), *[F.col("once")[n].alias(n) for n in more])


def scan(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """A row for each file and pattern that matches: `kind`, `ord`, `name`, `line` of the first match, `count`, the first `value`, `attributes`.

    Null contents are empty texts; rows of a null pattern match nothing; equal rows of patterns give equal rows of hits.
    """
    c = F.col("content")

    def hit(p: Column) -> Column:
        numbers = F.transform(p["values"], lambda v: F.nullif(F.call_function("regexp_extract", c, v, F.lit(1)), F.lit("")).cast("double"))
        return F.struct(
            p.kind.alias("kind"), p.ord.alias("ord"), p["name"].alias("name"), text.first_line_of(c, p.pattern).alias("line"), text.matches(c, p.pattern).alias("count"),
            F.get(F.filter(numbers, lambda x: x.isNotNull()), F.lit(0)).alias("value"), p.attributes.alias("attributes"),
        )

    rows = _with_candidates(files.select(*KEYS, "content"), patterns.where("pattern is not null"), ["kind", "ord", "name", "pattern", "words", "values", "attributes"])
    return rows.select(*KEYS, F.explode(F.transform(F.filter("tried", lambda p: F.rlike(c, p.pattern)), hit)).alias("x")).select(*KEYS, "x.*")


def violations(files: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for each file and rule that it breaks: `rule_ord`, `rule`, `severity`, `category`. `files` carry `libraries` and `modules` (arrays, null: none)."""
    c, none = F.col("content"), F.array().cast("array<string>")
    code = F.array_join(F.filter(text.py_lines(c), lambda x: ~text.strip(x).rlike("^(?:import |from )")), "\n")
    before = lambda p: F.length(F.get(F.split(F.col("code"), p, 2), F.lit(0)))

    def broken(r: Column) -> Column:
        libraries, modules = F.coalesce(r.libraries, none), F.coalesce(r.modules, none)
        uses = (F.size(libraries) + F.size(modules) == 0) | F.arrays_overlap(libraries, "libraries") | F.exists(modules, lambda m: F.col("modules").contains(m))
        n = F.coalesce(text.matches(c, r.counted), F.lit(0))
        counted = r.counted.isNull() | ((n >= F.coalesce(r.at_least, F.lit(1))) & (n <= F.coalesce(r.at_most, n)))
        ordered = r["first"].isNull() | (F.rlike("code", r["first"]) & F.rlike("code", r.second) & (before(r["first"]) < before(r.second)))
        return uses & F.forall(F.coalesce(r.has, none), lambda p: F.rlike(c, p)) & counted & ordered & ~F.exists(F.coalesce(r.lacks, none), lambda p: F.rlike(c, p))

    rows = files.select(*KEYS, "content", F.coalesce("libraries", none).alias("libraries"), F.lower(F.array_join(F.coalesce("modules", none), " ")).alias("modules"))
    fields = [f.strip().split(" ")[0] for f in RULE.split(", ")]
    rows = _with_candidates(rows, rules, fields, code=code)
    out = F.transform(F.filter("tried", broken), lambda r: F.struct(r.ord.alias("rule_ord"), r.rule.alias("rule"), r.severity.alias("severity"), r.category.alias("category")))
    return rows.select(*KEYS, F.explode(out).alias("x")).select(*KEYS, "x.*")
