"""The prefix trie, vector codes and token counts: odd tables, and results against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import piece_counts, prefix_trie, queries, vector_codes
from test_llm_operators import SF, compare

NAMES = ("conv", "depth", "name", "digest", "bytes", "size", "id", "label_error", "code", "n_tokens", "n_bytes", "__text", "__own_0")


def clashing(df):
    return df.withColumns({c: F.lit("own") for c in NAMES})


# -- prefix trie ----------------------------------------------------------------


def plain_trie(rows, openings):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    conv = dict(own)
    if openings:
        for c, v in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            conv[c] = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + v[h:]
    members, children, leaves, saved = {}, {}, {}, {}
    for c, v in conv.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = sum(saved[x] for x in below) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    ends = {k: ",".join(map(str, sorted(c for c in m if len(conv[c]) == len(k)))) for k, m in members.items()}
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items())


def trie(df, openings):
    return sorted(tuple(-1 if x is None else x for x in r) for r in prefix_trie.prefix_trie(clashing(df), openings=openings).collect())


@pytest.mark.parametrize("openings", [True, False])
def test_trie_against_plain(spark, openings, monkeypatch):
    """Nulls in every column, ties, repeated rows, turnless conversations, negative ids, copies of long conversations over many spans."""
    monkeypatch.setattr(prefix_trie, "SPAN", 3)
    rng = random.Random(openings)
    rows = [(c, rng.choice([None, t, t, t]), rng.choice(["user", "bot", None]), rng.choice(["x", "é", None, "ab"])) for c in [*range(-12, 40, 2), 7, 101] for t in range(rng.choice([1, 2, 5, 9, 14]))]
    rows += rows[:7] + [(None, 1, "user", "x"), (300, 1, "ab", "c"), (301, 1, "a", "bc"), (302, 1, "ab", "c")]
    rows += [(c, t, "user", f"long {t}") for c in (200, 205, 210) for t in range(37 if c < 210 else 41)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie(df, openings) == plain_trie(rows, openings)


def test_trie_of_little(spark):
    df = spark.createDataFrame([(5, 1, "u", "x")], "conv_id long, turn int, role string, text string")
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0 and prefix_trie.prefix_trie(df.withColumn("conv_id", F.lit(None).cast("long"))).count() == 0
    assert trie(df, False) == plain_trie([(5, 1, "u", "x")], False)
    # its base is absent and its own turns are fewer than are to be replaced: a root alone
    h = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert trie(df.withColumn("conv_id", F.lit(h).cast("long")), True) == plain_trie([(h, 1, "u", "x")], True) == [(h, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(h).encode()).hexdigest())]


def test_trie_hot_turn(spark):
    """A third of all conversations are copies."""
    df = spark.range(900).select(F.col("id").alias("conv_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("turn"), F.lit("u").alias("role"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    assert trie(df, False) == plain_trie([tuple(r) for r in df.collect()], False)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_vector_codes"])
def test_against_sql(spark, name, monkeypatch, tmp_path):
    import duckdb

    con = duckdb.connect
    monkeypatch.setattr(duckdb, "connect", lambda: con().execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'"))
    assert compare(spark, name)


# -- vector codes -----------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = sorted((r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    v = np.clip(np.floor(4096 * np.array([r[1] for r in rows], np.float64)), -(2**27) + 0, 2**27).astype(np.int64) if rows else np.zeros((0, 8), np.int64)
    n, d = v.shape
    cut = [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]
    books, code, error = v[:entries].copy(), np.zeros((n, parts), int), np.zeros(n, np.int64)
    for k in range(rounds + 1):
        error[:] = 0
        for p, (a, b) in enumerate(cut):
            far = ((v[:, None, a:b] - books[None, :, a:b]) ** 2).sum(2)
            code[:, p] = far.argmin(1)
            error += far.min(1)
        if k < rounds:
            for p, (a, b) in enumerate(cut):
                for e in range(len(books)):
                    own = code[:, p] == e
                    if own.any():
                        books[e, a:b] = v[own, a:b].sum(0) // own.sum()
    digest = hashlib.sha256(",".join(str(x) for a, b in cut for e in range(len(books)) for x in books[e, a:b]).encode()).hexdigest()
    totals = {}
    for r, e in zip(rows, error.tolist(), strict=True):
        totals[r[2]] = totals.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{x:02x}" for x in c), e, totals[r[2]], digest) for r, c, e in zip(rows, code.tolist(), error.tolist(), strict=True)), key=str)


def codes(df, **more):
    return sorted((tuple(r) for r in vector_codes.compress(clashing(df), **more).collect()), key=str)


@pytest.mark.parametrize("kind", ["random", "ties", "groups", "large"])
def test_codes_against_plain(spark, kind, monkeypatch):
    """Bounds that fail and that hold, equal distances everywhere, empty entries, blocks of a few rows."""
    monkeypatch.setattr(vector_codes, "BLOCK_BYTES", 8 * 16 * 37)
    rng = np.random.default_rng(3)
    v = {"random": rng.normal(size=(700, 16)), "ties": rng.integers(-1, 2, (700, 16)) / 4096, "groups": rng.normal(size=(700, 16)) * 0.01 + rng.integers(0, 5, (700, 1)), "large": rng.normal(size=(700, 16)) * 3000}[kind]
    rows = [(k if k % 50 else None, x, int(k) % 4 or None) for k, x in zip(rng.permutation(700).tolist(), v.astype(np.float32).tolist(), strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    scanned = []
    assert codes(df, scanned=scanned) == plain_codes(rows)
    if kind == "groups":
        assert scanned[0] == 700 * 8 and scanned[-1] < 700 * 8 / 4


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(4, [0.5] * 12, 1), (4, [0.5] * 12, 1), (3, [-0.1] * 12, None), (9, None, 1), (8, [], 1), (7, [nan] * 12, 1), (6, [inf] + [0.0] * 11, 1), (5, [None] + [0.0] * 11, 1), (None, [0.25] * 12, None), (1, [0.0] * 12, 2), (2, [1.0] * 11, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert codes(df) == plain_codes(rows) and len(codes(df)) == 5
    assert codes(df.limit(0)) == [] and codes(df.where("vec_id = 9")) == []
    one = codes(df.where("vec_id = 1"))
    assert one[0][1:4] == ("00" * 8, 0, 0)


def test_codes_hot_label(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT", 3)
    df = spark.range(300).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.nullif(F.concat(F.lit("l"), (F.col("id") % 10).cast("string")), F.lit("l7"))).alias("label"), F.lit("00").alias("code"), (F.col("id") + 1).alias("error"))
    sums = {}
    for r in df.collect():
        sums[r.label] = sums.get(r.label, 0) + r.error
    got = vector_codes.with_label_totals(df).collect()
    assert len(got) == 300 and all(r.label_error == sums[r.label] for r in got)


def test_bounds_never_skip_a_nearer_entry():
    """Moves of every size, entries that are equal, entries half-way between."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        spread = int(rng.integers(1, 40))
        points, books = rng.integers(-spread, spread, (200, 3)), rng.integers(-spread, spread, (6, 3))
        code, upper, lower, moved = np.zeros(200, np.uint8), np.zeros(200), np.zeros(200), None
        for _ in range(8):
            vector_codes.assign(points, books, code, upper, lower, moved)
            assert (code == vector_codes.squares(points, books).argmin(1)).all()
            new = books + rng.integers(-2, 3, books.shape) * int(rng.integers(0, 3))
            moved, books = np.sqrt(((new - books) ** 2).sum(1).astype(float)) * (1 + vector_codes.SLACK), new


# -- token counts -------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.pieces())


@pytest.fixture(scope="module")
def machine():
    return piece_counts.transducer(queries.pieces())


def same(machine, library, texts):
    expected = [len(x) for x in library.encode(texts, num_threads=1)]
    got = machine.count(texts)
    assert got == expected, next((t[:80], a, b) for t, a, b in zip(texts, got, expected, strict=True) if a != b)


def test_counts_of_every_code_point(machine, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(machine, library, points)
    same(machine, library, [f"a{c}b" for c in points])


@pytest.mark.parametrize("letters", ["abc ", " \nab", "etaoin shrdlu", "0123456789abcdef", "a", " ", "▁ a", "日本あ語 a", "(){};=. \t", "éàüß нае"])
def test_counts_of_random_texts(machine, library, letters):
    rng = random.Random(letters)
    same(machine, library, ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 60, 700]))) for _ in range(400)])
    same(machine, library, ["".join(rng.choice(machine.letters) for _ in range(60)) for _ in range(200)])


def test_counts_of_long_texts(machine, library, monkeypatch):
    """Windows and chunks that end inside long runs; states that a guess misses; what was compiled is forgotten in between."""
    monkeypatch.setattr(piece_counts, "WINDOW", 900)
    monkeypatch.setattr(piece_counts, "CHUNK", 40)
    monkeypatch.setattr(piece_counts, "BEFORE", 3)
    rng = random.Random(1)
    texts = ["".join(rng.choice("etaoinsh") for _ in range(4000)), "a" * 5000, "ab" * 1500, " " * 3001, "word " * 900, "=" * 2000]
    same(machine, library, texts)
    monkeypatch.setattr(piece_counts, "STATES", 0)
    same(machine, library, texts)


def test_maps_that_fit():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        constant, came, left = rng.random(n) < 0.2, rng.integers(0, 2, n), rng.integers(0, 2, n)
        expected = [True] * n
        for j in range(1, n):
            expected[j] = bool(constant[j]) or (expected[j - 1] and left[j - 1] == came[j])
        assert piece_counts.fitting(constant, came, left).tolist() == expected


def test_counts_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op13_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id]))
        assert tuple(r)[1:] == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_counts_of_odd_rows(spark, library):
    texts = [None, "", " ", "<s> </s> <unk>", "x", "x", "word " * 30_000, "\x00", "é" * 5000]
    df = clashing(spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    made = piece_counts.count_tokens(df, queries.pieces(), carry=["doc_id", *NAMES], limit=3)
    for r in made.collect():
        t = texts[r.doc_id or 0] or ""
        n = len(library.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit, r.digest) == (len(t.encode()), n, n > 3, "own")
    assert made.count() == len(texts) and piece_counts.count_tokens(df.limit(0), queries.pieces()).count() == 0
