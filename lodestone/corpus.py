"""Programs generated from the star-schema tables: each row's numbers are written into source text, so SQL can say what the analysis must find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(df: DataFrame, key: str, path: Column, content: Column, project: Column | None = None) -> DataFrame:
    return df.select((F.lit("p") if project is None else project).alias("project_id"), F.col(key).cast("long").alias("file_ord"), path.alias("path"), content.alias("content"))


def numbered(prefix: str, key: str, suffix: str = ".py") -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(suffix))


def lines(*parts: Column | str) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])), "\n")


def _nested(n: Column, opener: str, innermost: str) -> Column:
    """`n` blocks inside one another, then a statement."""
    heads = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.repeat(F.lit("    "), k), F.lit(opener)))
    inner = F.concat(F.repeat(F.lit("    "), n + 1), F.lit(innermost))
    return F.array_join(F.when(n > 0, F.concat(heads, F.array(inner))).otherwise(F.array(inner)), "\n")


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function for each part, with p_size % 5 nested loops."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_size") % 5
    return files(p, "p_partkey", numbered("loops/f_", "p_partkey"), lines(F.concat(F.lit("def f_"), F.col("p_partkey").cast("string"), F.lit("(rows):")), _nested(n, "for item in rows:", "total = 1"), "    return rows"))


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function for each part, with p_size % 7 ifs, each with a two-part condition if the key is even."""
    p = table(spark, sf_dir, "part")
    one = F.when(F.col("p_partkey") % 2 == 0, "    if first and second:\n        total = 1").otherwise("    if first:\n        total = 1")
    body = F.array_join(F.array_repeat(one, (F.col("p_size") % 7).cast("int")), "\n")
    return files(p, "p_partkey", numbered("branches/f_", "p_partkey"), lines(F.concat(F.lit("def f_"), F.col("p_partkey").cast("string"), F.lit("(first, second):")), F.nullif(body, F.lit("")), "    return first"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function for each part, of p_size * 2 lines of body and p_size % 9 parameters."""
    p = table(spark, sf_dir, "part")
    args = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") % 9), lambda k: F.concat(F.lit("arg_"), k.cast("string"))), ", ")
    args = F.when(F.col("p_size") % 9 > 0, args).otherwise("")
    body = F.array_join(F.array_repeat(F.lit("    total = 1"), (F.col("p_size") * 2).cast("int")), "\n")
    return files(p, "p_partkey", numbered("sizes/f_", "p_partkey"), lines(F.concat(F.lit("def f_"), F.col("p_partkey").cast("string"), F.lit("("), args, F.lit("):")), body))


def nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function for each part, with p_size % 7 blocks inside one another; recursion if the key is divisible by 3; a halving if by 2."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("f_"), F.col("p_partkey").cast("string"))
    recursion = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("    return "), name, F.lit("(size - 1)"))).otherwise("    return size")
    halving = F.when(F.col("p_partkey") % 2 == 0, "    half = size // 2")
    return files(p, "p_partkey", numbered("nesting/f_", "p_partkey"), lines(F.concat(F.lit("def "), name, F.lit("(size):")), halving, _nested(F.col("p_size") % 7, "if size:", "total = 1"), recursion))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each supplier k of n: it imports k * 7 % n and k * k % n, and os."""
    s = table(spark, sf_dir, "supplier")
    n = s.agg(F.count("*").alias("n"))
    one = s.crossJoin(F.broadcast(n))  # one row
    k = F.col("s_suppkey")
    line = lambda m: F.concat(F.lit("import m_"), m.cast("string"))
    return files(one, "s_suppkey", numbered("m_", "s_suppkey"), lines("import os", line(k * 7 % F.col("n")), line(k * k % F.col("n"))))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules by threes: each imports the next, the last of a complete three the first; key 5 modulo 30 a chord besides."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    following = F.when(k % 3 == 2, k - 2).otherwise(k + 1)
    chord = F.when(k % 30 == 5, F.concat(F.lit("import r_"), (k - 1).cast("string")))
    block = F.concat(F.lit("b"), F.floor(k / 30).cast("string"))
    return files(s, "s_suppkey", numbered("r_", "s_suppkey"), lines(F.concat(F.lit("import r_"), following.cast("string")), chord), block)


def unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each supplier: json is used if the key is even, path if it is divisible by 3."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return files(s, "s_suppkey", numbered("u_", "s_suppkey"), lines("import json", "from os import path", F.when(k % 2 == 0, "data = json.loads('1')"), F.when(k % 3 == 0, "place = path.join('a', 'b')")))


def risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function for each part: by key modulo 6 an SQL, command, path or pickle finding, or a safe form."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 6
    body = (
        F.when(k == 0, "    name = request.args.get('name')\n    cursor.execute('select ' + name)")
        .when(k == 1, "    command = input()\n    os.system(command)")
        .when(k == 2, "    name = sys.argv[1]\n    open('data/' + name)")
        .when(k == 3, "    pickle.loads(blob)")
        .when(k == 4, "    name = request.args.get('name')\n    cursor.execute('select ?', (name,))")
        .otherwise("    name = input()\n    name = 'fixed'\n    os.system(name)")
    )
    return files(p, "p_partkey", numbered("risky/f_", "p_partkey"), lines(F.concat(F.lit("def f_"), F.col("p_partkey").cast("string"), F.lit("(blob, cursor):")), body))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assignment for each supplier: a telling name if the key is even, a placeholder if it is divisible by 3."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    name = F.when(k % 2 == 0, "db_password").otherwise("greeting")
    value = F.when(k % 3 == 0, "changeme").otherwise(F.concat(F.lit("value"), k.cast("string")))
    return files(s, "s_suppkey", numbered("s_", "s_suppkey"), F.concat(name, F.lit(' = "'), value, F.lit('"')))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part, by key modulo 3 Python, TypeScript or C, of p_size % 4 + 1 functions."""
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey") % 3, (F.col("p_size") % 4 + 1).cast("int")
    each = lambda f: F.array_join(F.transform(F.sequence(F.lit(1), n), f), "\n")
    num = lambda i: i.cast("string")
    py = each(lambda i: F.concat(F.lit("def f_"), num(i), F.lit("(x):\n    return x\n")))
    ts = each(lambda i: F.concat(F.lit("export function f_"), num(i), F.lit("(x) {\n  if (x) { return x; }\n}\n")))
    c = each(lambda i: F.concat(F.lit("int f_"), num(i), F.lit("(int x) {\n  return x;\n}\n")))
    suffix = F.when(k == 0, ".py").when(k == 1, ".ts").otherwise(".c")
    return files(p, "p_partkey", F.concat(F.lit("src/f_"), F.col("p_partkey").cast("string"), suffix), F.when(k == 0, py).when(k == 1, ts).otherwise(c))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for each part, with p_size methods and as many attributes; a subclass if the key is even."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_size")
    methods = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("    def run_"), i.cast("string"), F.lit("(self):\n        self.value_"), i.cast("string"), F.lit(" = 1"))), "\n")
    return files(p, "p_partkey", numbered("classes/c_", "p_partkey"), lines("class Base:", methods, F.when(F.col("p_partkey") % 2 == 0, "class Child(Base):\n    pass")))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each supplier: a one-letter name if the key is even; two casings if it is divisible by 3; a shadowed name if by 5."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return files(
        s, "s_suppkey", numbered("n_", "s_suppkey"),
        lines("total_count = 1", F.when(k % 2 == 0, "q = 2"), F.when(k % 3 == 0, "otherCount = 3"), "for i in range(3):\n    total_count = i", F.when(k % 5 == 0, "def inner():\n    total_count = 4\n    return total_count")),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each supplier: main calls helper; helper calls leaf if the key is even; leaf calls print."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    inner = F.when(k % 2 == 0, "    return leaf(x)").otherwise("    return x")
    return files(s, "s_suppkey", numbered("c_", "s_suppkey"), lines("def main(x):\n    return helper(x) + helper(x)", F.concat(F.lit("def helper(x):\n"), inner), "def leaf(x):\n    print(x)\n    return x"), F.concat(F.lit("p"), k.cast("string")))


def recursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divide-and-conquer functions for each part: p_size % 4 + 1 calls on halves, with or without a linear merge."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("f_"), F.col("p_partkey").cast("string"))
    call = F.concat(F.lit("    part = "), name, F.lit("(rows[:half])"))
    body = F.array_join(F.array_repeat(call, (F.col("p_size") % 4 + 1).cast("int")), "\n")
    merge = F.when(F.col("p_partkey") % 2 == 0, "    merge(rows)")
    return files(p, "p_partkey", numbered("rec/f_", "p_partkey"), lines("def merge(rows):\n    for row in rows:\n        total = row", F.concat(F.lit("def "), name, F.lit("(rows):\n    half = len(rows) // 2")), body, merge, "    return rows"))


def notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each supplier: reads, splits with a seed if the key is even, fits, and evaluates if it is divisible by 3."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    split = F.when(k % 2 == 0, "a, b = train_test_split(rows, random_state=1)").otherwise("a, b = train_test_split(rows)")
    return files(
        s, "s_suppkey", numbered("ml_", "s_suppkey"),
        lines("import pandas as pd", "from sklearn.linear_model import LogisticRegression", "rows = pd.read_csv('x.csv')", split, "model = LogisticRegression()", "model.fit(a, b)", F.when(k % 3 == 0, "accuracy_score(a, b)\naccuracy = 0.5")),
    )


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TypeScript file for each supplier with lint hits by key."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return files(
        s, "s_suppkey", numbered("t_", "s_suppkey", ".ts"),
        lines("import { a } from './lib/tools'", "const run = (x) => { return a(x) }", F.when(k % 2 == 0, "console.log(run(1))"), F.when(k % 3 == 0, "var old = 1"), F.when(k % 5 == 0, "if (old == 2) { debugger }"), F.when(k % 7 == 0, F.concat(F.lit("// "), F.repeat(F.lit("x"), 130)))),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log line for each event, with a level by its type, in a log for each user modulo 10; lines ordered by event."""
    e = table(spark, sf_dir, "events")
    word = F.when(F.col("event_type") == "error", "ERROR failed").when(F.col("event_type") == "purchase", "WARN slow").when(F.col("event_type") == "signup", "INFO joined").otherwise("seen")
    return e.select(F.concat(F.lit("log"), (F.col("user_id") % 10).cast("string")).alias("name"), "event_id", "ts", F.concat(word, F.lit(" "), F.col("event_id").cast("string")).alias("line"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe for each event: the url is the user's, errors are down, purchases are 500, the rest 200."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("url"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("ms"), F.when(F.col("event_type") == "purchase", 500).when(F.col("event_type") != "error", 200).alias("code"), F.when(F.col("event_type") == "error", "timeout").alias("error"))


def coupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules by twenties: the first imports the others of its twenty, and is imported by the next four."""
    s = table(spark, sf_dir, "supplier")
    k, i = F.col("s_suppkey"), F.col("s_suppkey") % 20
    others = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(19)), lambda j: F.concat(F.lit("import k_"), (k + j).cast("string"))), "\n")
    content = F.when(i == 0, others).when(i <= 4, F.concat(F.lit("import k_"), (k - i).cast("string"))).otherwise("x_1 = 1")
    return files(s, "s_suppkey", numbered("k_", "s_suppkey"), content, F.concat(F.lit("t"), F.floor(k / 20).cast("string")))


def unhealthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules by tens, for every supplier one with what lowers each score: a pickle if the key is divisible by 7, rings of imports by threes,
    (key modulo 4) * 4 ifs, six parameters if the key is divisible by 5, a one-letter name if it is even."""
    s = table(spark, sf_dir, "supplier")
    k, i = F.col("s_suppkey"), F.col("s_suppkey") % 10
    following = F.when(i % 3 == 2, k - 2).otherwise(k + 1)
    args = F.when(k % 5 == 0, "first, second, third, fourth, fifth, sixth").otherwise("first")
    ifs = F.array_join(F.array_repeat(F.lit("    if first:\n        total = 1"), (k % 4 * 4).cast("int")), "\n")
    return files(
        s, "s_suppkey", numbered("h_", "s_suppkey"),
        lines(F.concat(F.lit("import h_"), following.cast("string")), F.when(k % 2 == 0, "q = 2"), F.concat(F.lit("def f_"), k.cast("string"), F.lit("("), args, F.lit("):")), F.when(k % 7 == 0, "    pickle.loads(first)"), F.nullif(ifs, F.lit("")), "    return first"),
        F.concat(F.lit("h"), F.floor(k / 10).cast("string")),
    )


# A line for each stage of a pipeline that tells of it alone.
STAGE_LINES = [
    "pd.read_csv('a')", "dropna", "get_dummies", "MinMaxScaler", "KFold", "PCA", "nn.Linear", "AdamW", "DataLoader", "loss.backward()", "TensorBoard", "predict_proba (a)",
    "confusion_matrix", "torch.save", "plt.show", "px.bar", "cv2.resize", "scipy.stats", "ic (a)", "pl.DataFrame", "lgb.train", "nlp = spacy", "cdef a",
]


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each supplier that holds the line of stage key modulo 23, on line key modulo 3 + 1, twice."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    own = F.get(F.array(*map(F.lit, STAGE_LINES)), (k % len(STAGE_LINES)).cast("int"))
    return files(s, "s_suppkey", numbered("ml_", "s_suppkey"), F.concat(F.repeat(F.lit("\n"), (k % 3).cast("int")), own, F.lit("\n"), own))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TypeScript file for each supplier: a function, a class, an interface and a type by its key, a call of the function, imports; one of them unused if the key is even."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    of = lambda a, b="": F.concat(F.lit(a), k, F.lit(b))
    return files(
        s, "s_suppkey", numbered("ts_", "s_suppkey", ".ts"),
        lines("import { a } from './lib/tools'", of("export function run_", "(x) { return x }"), of("class Box_", " extends Base { }"), of("export interface Like_", " { }"), of("type Of_", " = string"), of("run_", "(1)"), F.when(F.col("s_suppkey") % 2 == 1, "tools.open()")),
    )


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each supplier that does not parse and has the word of its key modulo 3 on two lines."""
    s = table(spark, sf_dir, "supplier")
    word = F.concat(F.lit("word_"), (F.col("s_suppkey") % 3).cast("string"))
    return files(s, "s_suppkey", numbered("b_", "s_suppkey"), F.concat(word, F.lit(" = (\n    "), word, F.lit(", ")))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file for each supplier, which breaks on line 2 if the key is divisible by 3."""
    s = table(spark, sf_dir, "supplier")
    return files(s, "s_suppkey", numbered("j_", "s_suppkey", ".json"), F.when(F.col("s_suppkey") % 3 == 0, '{"a": 1,\n"b" 2}').otherwise('{"a": 1}'))


def documented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each supplier: a text of key % 5 + 2 lines, key % 4 comments, key % 3 blank lines and key % 7 + 1 assignments."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    several = lambda text, n: F.array_repeat(F.lit(text), n.cast("int"))
    return files(
        s, "s_suppkey", numbered("d_", "s_suppkey"),
        F.array_join(F.concat(F.array(F.lit('"""Says')), several("what # it", k % 5), F.array(F.lit('is for."""')), several("  # a note", k % 4), several("  ", k % 3), several("total = total + 1", k % 7 + 1)), "\n"),
    )


def nested_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part: p_size functions inside one another; the first binds a name, and the last one too if the key is even."""
    p = table(spark, sf_dir, "part")
    head = lambda i: F.concat(F.repeat(F.lit(" "), i - 1), F.lit("def level_"), i.cast("string"), F.lit("(argument_"), i.cast("string"), F.lit("):"))
    body = lambda i: F.concat(F.repeat(F.lit(" "), i), F.when((i == 1) | ((i == F.col("p_size")) & (F.col("p_partkey") % 2 == 0)), "total = 1").otherwise("pass"))
    return files(p, "p_partkey", numbered("scopes/s_", "p_partkey"), F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.array(head(i), body(i)))), "\n"))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function for each part: input() goes through p_size names into a command; if the key is divisible by 3 one of them is set to a text first."""
    p = table(spark, sf_dir, "part")
    n, name = F.col("p_size"), lambda i: F.concat(F.lit("x_"), i.cast("string"))
    steps = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("    "), name(i), F.lit(" = "), F.when((i == 1) & (F.col("p_partkey") % 3 == 0), "'fixed'").when(F.col("p_partkey") % 2 == 0, F.concat(name(i - 1), F.lit(" + '.'"))).otherwise(name(i - 1))))
    return files(p, "p_partkey", numbered("chains/f_", "p_partkey"), F.array_join(F.concat(F.array(F.lit("def run():"), F.lit("    x_0 = input()")), steps, F.array(F.concat(F.lit("    os.system("), name(n), F.lit(")")))), "\n"))


def one_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers' modules in one project: rings of seven by key, a chord in every third ring, and an import of the next ring's first module."""
    s = table(spark, sf_dir, "supplier")
    k, i = F.col("s_suppkey"), F.col("s_suppkey") % 7
    line = lambda x: F.concat(F.lit("import o_"), x.cast("string"))
    return files(s, "s_suppkey", numbered("o_", "s_suppkey"), lines(line(F.when(i == 6, k - 6).otherwise(k + 1)), F.when((i == 3) & (F.floor(k / 7) % 3 == 0), line(k - 3)), F.when(i == 0, line(k + 7))))


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part that calls the function of number p_size modulo 25 on line p_partkey modulo 4 + 1, twice, and sets that of the key modulo 25 once."""
    p = table(spark, sf_dir, "part")
    term = lambda n, tail: F.concat(F.lit("term_"), (n % 25).cast("string"), tail)
    call = term(F.col("p_size"), F.lit("(1)"))
    return files(p, "p_partkey", numbered("words/w_", "p_partkey"), F.concat(F.repeat(F.lit("\n"), (F.col("p_partkey") % 4).cast("int")), call, F.lit("\n"), call, F.lit("\n"), term(F.col("p_partkey"), F.concat(F.lit(" = "), F.col("p_size").cast("string")))))


def nation_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of patterns for each nation: calls of the function of its number, and numbers that are set to it."""
    number = F.col("n_nationkey").cast("string")
    word = F.concat(F.lit("term_"), number)
    row = lambda kind, pattern, values: F.struct(
        F.lit(kind).alias("kind"), F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("name"), pattern.alias("pattern"), F.array(word).alias("words"), values.alias("values"),
        F.create_map(F.lit("region"), F.col("n_regionkey").cast("string")).alias("attributes"),
    )
    called = F.concat(F.lit(r"\b"), word, F.lit(r"\s*\("))
    set_to = F.concat(F.lit(r"\b"), word, F.lit(r"\s*="))
    value = F.array(F.concat(set_to, F.lit(r"\s*(\d+)")))
    both = F.array(row("call", called, F.lit(None).cast("array<string>")), row("set", set_to, value))
    return table(spark, sf_dir, "nation").select(F.explode(both).alias("x")).select("x.*")


def native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of `loops`; the file names a .wasm module if the key is divisible by 4, and Cython's cdef if by 3."""
    k = F.col("file_ord")
    return loops(spark, sf_dir).withColumn("content", F.concat_ws("\n", F.col("content"), F.when(k % 4 == 0, "MODULE = 'lib.wasm'"), F.when(k % 3 == 0, "# cdef int x")))


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of notes for each supplier that names libraries and notebook environments by its key, whole words and parts of words."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return files(s, "s_suppkey", numbered("notes_", "s_suppkey", ".html"), lines(F.when(k % 2 == 0, "we use numpy, torchvision"), F.when(k % 3 == 0, "polars(x)"), F.when(k % 4 == 0, "loadPyodide()"), F.when(k % 5 == 0, "IMPORT a STARBOARD b"), "end"))
