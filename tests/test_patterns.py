"""Patterns and rules as rows: the words that a pattern needs, own rows, odd tables, and every pattern against a plain search."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone import schemas
from lodestone.operators import ml, parse, patterns


@pytest.mark.parametrize(
    ("pattern", "words"),
    [
        (r"\bfit\s*\(|\bmodel\.fit\b", ["fit", "model"]), (r"SimpleImputer", None), (r"\bdropna\b|SimpleImputer", None), (r"(?i)\bAUC\b|\broc_auc_score\b", ["auc", "roc_auc_score"]),
        (r"\bcdef\s|cimport\b", None), (r"\bcdef\s", ["cdef"]), (r"\bfit\s*x", None), (r"\bfit\.?x", None), (r"\bic\s*\(|from icecream import", ["ic", "icecream"]), (r"(a|b)\bc\b", None), (r"[a]\bc\b", None), (r"\\bfit\b", None),
    ],
)
def test_words_of_a_pattern(pattern, words):
    assert patterns.key_words(pattern) == words


PIECES = ["fit", "predict", "model", ".", " ", "(", "_", "x", "\n", "Adam", "optim", "=", "3", "loss", "lr", "é", "("]
TRIED = [p for _, p in ml.STAGES] + [f"(?i){p}" for p in ml.METRICS.values()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_no_match_without_a_word(text):
    own = set(re.findall(r"[A-Za-z0-9_]+", text.lower()))
    for p in TRIED:
        words = patterns.key_words(p)
        assert words is None or own & set(words) or not re.search(p, text)


def files(spark, contents):
    return spark.createDataFrame([("p", k, f"{k}.py", c) for k, c in enumerate(contents)], schemas.SOURCE_FILE)


def test_scan_against_plain_search(spark):
    contents = ["", None, "\n\nmodel.fit(a)\nFIT (b)\nlr = 0.5\nlr = 7", "optim.Adam(x) Adam", "x = 1", "SimpleImputers\r\nfillna", "import plotly.x\nnlp  = spacy", "epochs: 12\n" * 3]
    got = {(r.file_ord, r.kind, r.name): (r.line, r["count"]) for r in patterns.scan(files(spark, contents), ml.pattern_rows(spark)).collect()}
    kinds = [("stage", n, p) for n, p in ml.STAGES] + [("metric", n, f"(?i){p}") for n, p in ml.METRICS.items()] + [("model", n, rf"\b{n}\b") for n in ml.MODELS]
    kinds += [("library", n, rf"\b{n}\b") for n in ml.NAMES] + [("notebook", n, p) for n, p in ml.NOTEBOOKS.items()]
    expected = {}
    for k, c in enumerate(contents):
        for kind, name, p in kinds:
            found = list(re.finditer(p, c or ""))
            if found:
                expected[k, kind, name] = (c[: found[0].start()].count("\n") + 1, len(found))
    assert got == expected and {k for k, *_ in got} == {2, 3, 5, 6, 7}
    values = {(r.file_ord, r.metric): r.value for r in ml.metrics(files(spark, contents)).collect()}
    assert values[2, "learning_rate"] == 0.5 and values[7, "epochs"] == 12.0


def test_own_rows(spark):
    own = spark.createDataFrame(
        [("own", 0, "todo", r"\bTODO\b", ["todo"], None, {"team": "a"}), ("own", 1, "any", "T.D", None, None, None), ("own", 2, "none", None, None, None, None), ("own", 1, "any", "T.D", None, None, None)], patterns.PATTERN
    )
    f = files(spark, ["x\n# TODO y", "TODOS", None, "todo"])
    rows = patterns.scan(f, own).collect()
    assert sorted((r.file_ord, r.name, r.line) for r in rows) == [(0, "any", 2), (0, "any", 2), (0, "todo", 2), (1, "any", 1), (1, "any", 1)]
    assert [r.attributes for r in rows if r.name == "todo"] == [{"team": "a"}]
    assert patterns.scan(f, own.where("false")).count() == 0 and patterns.scan(f.where("false"), own).count() == 0
    every = ml.pattern_rows(spark, "stage").unionByName(own)
    assert {r.kind for r in patterns.scan(files(spark, ["TODO fit(x)"]), every).collect()} == {"stage", "own"}


def test_a_text_is_tried_where_its_words_stand(spark):
    rows = patterns._with_candidates(files(spark, ["x = 1", "predict_proba(x)"]), ml.pattern_rows(spark, "stage"), ["name", "words"]).collect()
    tried = {r.file_ord: {p["name"] for p in r.tried} for r in rows}
    always = {n for n, p in ml.STAGES if patterns.key_words(p) is None}
    assert tried[0] == always and tried[1] == always | {"prediccion"} and len(always) < 8


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(patterns, "MOST", 3)
    with pytest.raises(Exception, match="more than 3 patterns"):
        patterns.scan(files(spark, ["a"]), ml.pattern_rows(spark, "stage")).collect()


def test_own_rules(spark):
    row = dict.fromkeys([f.strip().split(" ")[0] for f in patterns.RULE.split(", ")])
    rules = [
        row | {"ord": 0, "rule": "two_prints", "counted": "print", "at_least": 2, "at_most": 2},
        row | {"ord": 1, "rule": "pandas_only", "libraries": ["Pandas"], "lacks": ["polars"]},
        row | {"ord": 2, "rule": "a_before_b", "first": "a", "second": "b"},
    ]
    table = spark.createDataFrame([tuple(r.values()) for r in rules], patterns.RULE)
    f = files(spark, ["print\nprint", "print", "import pandas as pd\nx", "import pandas\nb = a", "a b", None])
    found = ml.libraries(parse.imports(parse.parse_files(f, ["imports"])))
    assert sorted((r.file_ord, r.rule) for r in ml.issues(f, found, table).collect()) == [(0, "two_prints"), (2, "pandas_only"), (3, "pandas_only"), (4, "a_before_b")]
