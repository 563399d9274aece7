"""Findings by joins over statement rows, against the same rules statement by statement."""

import random

import plain_taint

from lodestone.operators import dataflow, parse
from lodestone.operators.stepwise import Steps
from lodestone.sources import files as source

NAMES = ["a", "b", "c", "d"]
SOURCES = ["input()", "sys.argv[1]", "os.environ['K']", "os.getenv('K')", "request.args.get('q')", "request.form['q']", "self.request.headers", "request.get_json()", "os.environ.get('K')", "raw_input()", "form.get('x')", "args.get('x')", "f().args.get('x')"]
CALLS = ["cur.execute({})", "execute({})", "f().executemany({}, 1)", "os.system({})", "os.popen({})", "subprocess.run({}, shell=True)", "subprocess.run({})", "sub.call({}, shell=True)", "open({})", "x.open({})", "os.path.join({}, {})", "os.path.join('d', {}, {})", "pickle.loads({})", "yaml.load({})", "yaml.load({}, Loader=yaml.SafeLoader)", "yaml.load({}, Loader=yaml.Loader)", "marshal.loads()", "print({})"]


def expression(rng, depth=0):
    kind = rng.random()
    if kind < 0.35:
        return rng.choice(NAMES)
    if kind < 0.5:
        return rng.choice(SOURCES)
    if kind < 0.65 or depth > 2:
        return rng.choice(["'t'", "1", "g(a)", "x.y", "a[0]", "[a]", "a if b else c"])
    one, other = expression(rng, depth + 1), expression(rng, depth + 1)
    return rng.choice([f"({one} + {other})", f"('%s' % {one})", f"'{{}}{{}}'.format({one}, k={other})", f"(f'{{{rng.choice(NAMES)}}}-{{{rng.choice(NAMES)}}}')"])


def program(rng):
    out = []
    for k in range(rng.randint(1, 3)):
        out.append(f"{'async ' if rng.random() < 0.2 else ''}def f{k}(a, cur):")
        for _ in range(rng.randint(1, 14)):
            pad = "    " * rng.choice([1, 1, 1, 2])
            if pad == "        ":
                out.append("    if a:")
            kind = rng.random()
            if kind < 0.6:
                target = rng.choice([*NAMES, "a = b", "a, b", "x.y", "c[0]"])
                out.append(f"{pad}{target} = {expression(rng)}")
            else:
                call = rng.choice(CALLS)
                out.append(pad + call.format(*(expression(rng) for _ in range(call.count("{}")))))
        if rng.random() < 0.3:
            out.append("    def inner():\n        a = input()\n        os.system(a)")
    out += [rng.choice(["api_key = 'abc'", "pwd: str = '<x>'", "DB_PASSWORD = other = 'z'", "name = 'n'", "secret = ''"]) for _ in range(2)]
    return "\n".join(out) + "\n"


def rows(spark, texts):
    files = source.inline(spark, "p", [{"filename": f"f{k}.py", "content": t} for k, t in enumerate(texts)])
    out = {}
    for r in sorted(dataflow.findings(parse.parse_files(files, dataflow.FACTS)).collect(), key=lambda r: (r.path, r.finding_ord)):
        out.setdefault(r.path, []).append({c: r[c] for c in ("cwe", "category", "severity", "confidence", "source", "sink", "line", "function")})
    return out


def test_against_plain(spark):
    rng = random.Random(2)
    texts = [program(rng) for _ in range(250)]
    expected = {f"f{k}.py": found for k, t in enumerate(texts) if (found := plain_taint.findings(t))}
    assert len(expected) > 100 and {x["cwe"] for f in expected.values() for x in f} == {"CWE-89", "CWE-78", "CWE-22", "CWE-502", "CWE-798"}
    assert rows(spark, texts) == expected


def test_long_chains_settle_in_few_rounds(spark, monkeypatch):
    """A value that goes through two hundred names, one that grows by literals, and one that never was from outside."""
    n = 200
    alias = "\n".join(["    x0 = input()", *(f"    x{k} = x{k - 1}" for k in range(1, n)), f"    os.system(x{n - 1})"])
    grown = "\n".join(["    q = request.args['q']", *("    q = q + ' and ' + y" for _ in range(n)), "    cur.execute(q)"])
    clean = "\n".join(["    x0 = 'a'", *(f"    x{k} = x{k - 1} + z" for k in range(1, n)), f"    os.system(x{n - 1})"])
    texts = [f"def f(cur, y, z):\n{body}\n" for body in (alias, grown, clean)]
    kept, keep = [], Steps.keep
    monkeypatch.setattr(Steps, "keep", lambda self, df: kept.append(1) or keep(self, df))
    got = rows(spark, texts)
    assert got == {f"f{k}.py": found for k, t in enumerate(texts) if (found := plain_taint.findings(t))} and set(got) == {"f0.py", "f1.py"}
    assert len(kept) < 30


def test_nothing_to_find(spark):
    assert rows(spark, ["", "def f(:", "x = 1"]) == {} and rows(spark, []) == {}


def test_a_chain_of_names_is_settled_in_one_round(spark):
    n = 40
    text = "def run(cur):\n  x0 = input()\n" + "".join(f"  x{k + 1} = x{k}{' + t' if k == 20 else ''}\n" for k in range(n)) + f"  cur.execute(x{n})\n  cur.execute(x20)\n  x3 = 'fixed'\n  cur.execute(x3)\n"
    parsed = parse.parse_files(source.inline(spark, "p", [{"filename": "a.py", "content": text}]), dataflow.FACTS)
    steps = Steps(spark, "t")
    assert dataflow.tainted(parsed, steps).count() == 1  # what only passes a name on is no row of its own
    assert steps.n == 1
    steps.drop()
    assert [(r.cwe, r.source, r.line) for r in dataflow.findings(parsed).collect()] == [("CWE-89", "stdin (input())", n + 3)]
