"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; results against plain versions."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, components, decontam, hmm, hnsw, minhash, quality, queries, spans, suffix, token_store, toxicity
from lodestone.llm.common import work_dir

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
PASSAGE = " ".join(f"shared{k}" for k in range(60)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns that have the names of outputs."""
    rows = [(1, "A plain text. With two sentences. And three of them, at last, to be sure of it all."), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, f"Before it.\n{PASSAGE}\nAfter it."), (7, f"Something else.\n{PASSAGE}\nAnd an end."), (None, "no id"), (9, "x"), (9, "x"), (10, f"Before it.\n{PASSAGE}\nAfter it.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("own") for c in ("ids", "score", "kept", "n_words", "component_id", "lang")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_bpe_edges(spark, odd, empty):
    made = {r.doc_id: r for r in bpe.encode_decode(odd, queries.vocabulary(), carry=["doc_id", "ids", "lang"]).collect()}
    assert all(len(made[k].ids) == 0 and made[k].decoded == "" for k in (2, 3, 4)) and len(made[5].ids) == 4 * 30_000 and made[1].lang == "own"
    assert bpe.encode_decode(empty, queries.vocabulary(), carry=["doc_id"]).count() == 0
    pairs = bpe.decode_ids(bpe.encode_decode(odd, queries.vocabulary(), carry=["doc_id"]).withColumnRenamed("decoded", "before"), queries.vocabulary(), carry=["before"])
    assert all(r.before == r.decoded for r in pairs.collect())


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op9_bpe(spark, SF).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("shuffled", [False, True])
def test_token_store(spark, odd, empty, shuffled):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    docs = docs.repartition(3, "lang") if shuffled else docs
    files = token_store.write_store(docs, work_dir(spark, "t"), queries.vocabulary())
    rows = sorted(token_store.read_store(files, 1000).collect(), key=lambda r: r.start)
    start = 0
    for r, t in zip(rows, texts, strict=True):
        ids = np.array([*library.encode(t.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (t.doc_id, start, len(ids), ids.tobytes())
        start += len(ids)
    if shuffled:
        made = sorted(token_store.read_store(token_store.write_store(odd, work_dir(spark, "t"), queries.vocabulary())).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in made] == [None, 1, 2, 3, 4, 5, 6, 7, 9, 9, 10] and made[2].n_tokens == 1
        assert token_store.read_store(token_store.write_store(empty, work_dir(spark, "t"), queries.vocabulary())).count() == 0


def test_decontamination_edges(spark, odd, empty):
    bench = spark.createDataFrame([("q2", PASSAGE), ("q1", "no id"), (None, "x"), ("q3", None), ("q2", PASSAGE)], "item_id string, text string")
    one = {(r.doc_id, tuple(r["items"]), len(r.hit_words)) for r in decontam.contamination(odd, bench, carry=["doc_id", "n_words"]).collect()}
    many = {(r.doc_id, tuple(r["items"]), len(r.hit_words)) for r in decontam.contamination(odd, bench, carry=["doc_id", "n_words"], shard_bytes=600).collect()}
    assert one == many and (6, ("q2",), 60) in one and (None, ("q1",), 2) in one and (9, (), 0) in one
    assert decontam.contamination(odd, bench.limit(0), carry=["doc_id"]).agg(F.max(F.size("hit_words"))).first()[0] == 0
    assert decontam.contamination(empty, bench, carry=["doc_id"]).count() == 0
    marked = decontam.with_spans(decontam.contamination(odd, bench, carry=["doc_id", "text"]), carry=["doc_id", "text"])
    row = marked.where("doc_id = 6").first()
    assert row.text[row.spans[0].start : row.spans[0].end] == PASSAGE[:-1]


def compare(spark, name, path=SF):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    result = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    expected = sorted(tuple(str(r[k]) for k in np.argsort(names)) for r in result.fetchall())
    got = queries.QUERIES[name](spark, path)
    return sorted(tuple(str(r[c]) for c in sorted(got.columns)) for r in got.collect()) == expected


@pytest.mark.parametrize("name", ["op1_hnsw", "op2_suffix_array", "op4_decontamination", "op7_minhash"])
def test_against_sql(spark, name):
    assert compare(spark, name)


def test_decontamination_against_sql_with_null_ids(spark, odd, tmp_path):
    import corpus_pipeline

    odd.select("doc_id", "text").where("doc_id <> 9").write.parquet(f"{tmp_path}/raw")
    docs = spark.read.parquet(f"{tmp_path}/raw")
    docs.coalesce(1).toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, PASSAGE), (None, "plain text"), (3, "two sentences"), (4, None)], "item_id long, text string").toPandas().astype({"item_id": "Int64"}).to_parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().to_parquet(f"{tmp_path}/embeddings.parquet")
    assert compare(spark, "op4_decontamination", str(tmp_path))
    assert not {1, 6, 7, 10} & {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()}


def test_minhash_large_buckets(spark, monkeypatch):
    """Every bucket is a large one, and blocks are small."""
    monkeypatch.setattr(minhash, "SMALL", 1)
    monkeypatch.setattr(minhash, "COMPARED", 3)
    assert compare(spark, "op7_minhash")


def test_minhash_edges(spark, odd, empty):
    found = minhash.near_duplicates(odd, shingle=2).collect()
    rows = {r.doc_id: r for r in found}
    assert [(r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id == 9] == [(1, 9, True)] * 2
    assert (rows[10].component_id, rows[10].kept, rows[6].kept) == (6, False, True) and rows[2].n_shingles == 0 and rows[2].kept and None not in rows
    assert rows[7].component_id == 6 and rows[5].n_shingles == 1
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 1), (200, 300)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[101] == 100 and got[300] == 200 and len(got) == 65
    assert components.components(edges.limit(0)).count() == 0


def test_components_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK_LINKS", 40)
    rng = np.random.default_rng(5)
    path = rng.permutation(np.arange(-300, 300))
    links = [*zip(path[1:].tolist(), path[:-1].tolist(), strict=True), *((5000, k) for k in range(1000, 1200)), *((2000, k) for k in range(2001, 2200)), *(rng.integers(3000, 3400, (250, 2)).tolist())]
    parent = {}

    def least(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = least(a), least(b)
            parent[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame([links[k] for k in rng.permutation(len(links))], "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, least(x)) for x in parent)


def test_components_take_few_tasks(spark):
    """Every task of a small graph costs shuffle files and bookkeeping, however few its rows are."""
    edges = spark.createDataFrame([(k // 4 * 4, k) for k in range(2000)] + [(k, k + 4) for k in range(0, 400, 4)], "a long, b long").repartition(8)
    before, context = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    context.setJobGroup("components", "")
    try:
        found = components.components(edges).groupBy("component").count().collect()
        status = context.statusTracker()
        stages = {s for j in status.getJobIdsForGroup("components") for s in status.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i)
    finally:
        context._jsc.clearJobGroup()
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r["component"]: r["count"] for r in found} == {0: 404} | {k: 4 for k in range(404, 2000, 4)}
    assert tasks < 2000


def test_suffix_edges(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 1 << 10)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 1 << 10)
    rows = {(r.doc_id, r.n_bytes): r for r in suffix.remove_repeats(odd, carry=["lang", "kept"]).collect()}
    by = {d: r for (d, _), r in rows.items()}
    assert by[10].n_removed == by[10].n_bytes and bytes(by[10].kept) == b"" and by[6].n_removed == 0 and by[5].n_removed == 0
    assert by[7].n_spans == 1 and b"shared3 " not in bytes(by[7].kept) and bytes(by[7].kept).startswith(b"Something else") and by[2].n_bytes == 0 and by[None].n_removed == 0
    assert suffix.remove_repeats(empty).count() == 0


def test_suffix_query(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 40 << 10)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 90 << 10)
    docs = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    first = {}
    for d, t in docs:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], d)
    got = {r.doc_id: r for r in queries.op2_suffix_array(spark, SF).collect()}
    for d, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())


def test_span_edges(spark, odd, empty):
    by = {r.doc_id: r for r in spans.remove_repeats(odd, carry=["kept", "lang"]).collect()}
    assert by[7].kept_text == "Something else.\nAnd an end." and by[6].n_removed == 0 and by[2].kept_text == "" and by[10].kept_text == "" and by[None].kept_text == "no id"
    assert spans.remove_repeats(empty).count() == 0


def plain_pieces(text):
    """What the module's docstring says, word by word: (offset, words, whether a sentence starts)."""
    import re

    import xxhash

    def scatter(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    found = list(re.finditer(r"\S+", text))
    words = [m[0] for m in found]
    hashes = [xxhash.xxh3_64_intdigest(w.encode()) for w in words]
    pieces, sentence = [], []
    for k, m in enumerate(found):
        sentence.append(k)
        gap = text[m.end() : found[k + 1].start()] if k + 1 < len(found) else None
        if gap is None or "\n" in gap or m[0][-1] in ".!?":
            place = {j: scatter((hashes[j] + hashes[j - 1] * 0x9E3779B97F4A7C15) % 2**64) | 1 for j in sentence[1:]}
            cuts = {sentence[-1]}
            for at in range(1, len(sentence) - 7):
                window = sentence[at : at + 8]
                least = min(place[j] for j in window)
                cuts |= {j for j in window if place[j] == least}
            own = []
            for j in sentence:
                own.append(j)
                if j in cuts:
                    pieces.append((found[own[0]].start() if pieces else 0, [words[i] for i in own], own[0] == sentence[0]))
                    own = []
            sentence = []
    return pieces


def plain_spans(pieces):
    """First and last pieces of all spans, in order."""
    n, out = len(pieces), set()
    size = lambda a, b: sum(len(p[1]) for p in pieces[a : b + 1])
    for i in range(n):
        out |= {(i, j) for j in [next((j for j in range(i, n) if size(i, j) >= 25), None)] if j is not None}
        out |= {(j, i) for j in [next((j for j in range(i, -1, -1) if size(j, i) >= 25), None)] if j is not None}
    opens = [k for k, p in enumerate(pieces) if p[2]] + [n]
    out |= {(opens[k], opens[k + 3] - 1) for k in range(len(opens) - 3)}
    return sorted(out)


def test_span_query_against_plain(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK_BYTES", 40 << 10)
    monkeypatch.setattr(spans, "BUCKET_BYTES", 90 << 10)
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    seen, expected = set(), {}
    for d, t in docs:
        pieces, gone = plain_pieces(t), set()
        for a, b in plain_spans(pieces):
            key = tuple(w for p in pieces[a : b + 1] for w in p[1])
            if key in seen:
                gone |= set(range(a, b + 1))
            seen.add(key)
        at = [*(p[0] for p in pieces), len(t)] if pieces else [0, len(t)]
        expected[d] = "".join(t[a:b] for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if k not in gone)
    assert {r.doc_id: r.kept_text for r in queries.op8_sentence_spans(spark, SF).collect()} == expected


@pytest.mark.parametrize(("name", "label", "cut"), [("op3_quality", "quality", 0.3), ("op5_toxicity", "toxic", 0.5)])
def test_classifiers_held_out(spark, name, label, cut):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= cut) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r[label] for r in held]) > 0.9


def test_classifier_edges(spark, odd, empty):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        for docs, own in ((odd, labels), (odd, labels.limit(0)), (empty, labels)):
            scored = module.score(docs, module.fit(docs, own, label), carry=["doc_id", "score"])
            assert all(0 <= r.score <= 1 for r in scored.collect()) and scored.count() == docs.count()


def test_toxicity_finds_copies_of_examples_of_rare_terms(spark):
    """No term is in two examples, so none is tied to the label."""
    docs = spark.createDataFrame([(k, " ".join(f"{chr(97 + k)}{chr(97 + j)}x" for j in range(8))) for k in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model, carry=["doc_id"]).collect()}
    for k in range(12):
        if zlib.crc32(str(k).encode()) % 5:
            assert (rows[k].score >= 0.5) == (k % 2 == 1) and rows[k].evidence == [str(k)] * (k % 2) and len(rows[k].terms) == 5


def test_language_model_query(spark, monkeypatch):
    import math
    import re
    from collections import Counter

    monkeypatch.setattr(hmm, "BLOCK_BYTES", 60 << 10)
    monkeypatch.setattr(hmm, "BUCKET_BYTES", 90 << 10)
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    tokens = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lower)), "\n"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    c = Counter(w for d, t in tokens.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in t)
    n, v = sum(c.values()), len(c)
    rows = queries.op10_hmm(spark, SF).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        t = tokens[r.doc_id]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in c for w in t), n, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_edges(spark, odd, empty):
    rows = {r.doc_id: r for r in hmm.score(odd, hmm.train(odd), F.col("doc_id") != 9).collect()}
    assert rows[2].n_tokens == 1 and rows[3].n_known == 1 and rows[9].n_known == 1
    assert hmm.score(empty, hmm.train(empty), F.lit(True)).count() == 0


def test_embedding_edges(spark):
    nan, a, b = float("nan"), [1.0, 0.0, 0.0], [0.99, 0.01, 0.0]
    rows = [(1, a), (2, a), (3, b), (4, None), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]), (7, [1.0, None, 0.0]), (8, [1.0, 0.0]), (9, [0.0, 1.0, 0.0]), (None, a), (10, [float("inf"), 0.0, 0.0]), (11, [2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"n_links": F.lit("own"), "node": F.lit(1)})
    again = hnsw.near_duplicates(df.unionByName(df.where("vec_id = 1"))).collect()
    assert sorted((r.n_links, r.component_id) for r in again if r.vec_id == 1) == [(4, 1), (4, 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 11: (3, 1, False), **{k: (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10)}}
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = work_dir(spark, name)
        stage(spark, held, SF).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns and after.count() <= held.count()
        if name == "minhash":
            found = minhash.near_duplicates(held)
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in found.where("kept").collect()}
        if name == "decontamination":
            assert decontam.contamination(after, spark.read.parquet(f"{SF}/benchmark.parquet"), carry=["doc_id"]).where(F.size("hit_words") > 0).count() == 0
        if name == "suffix_array":
            assert after.where("length(text) <> n_chars").count() == 0
        held = after
    last = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.STAGES[-1][1](spark, held, SF).collect()}
    assert last == {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, SF).collect()} and len(last) > 100


def test_pipeline_of_odd_tables(spark, odd, tmp_path):
    """Nulls, repeated rows, long and empty texts, and columns that have the names of the stages' outputs."""
    import corpus_pipeline

    toxic = "vile hateful slur " * 9
    named = {c: F.lit(f"own {c}") for c in ("score", "evidence", "terms", "kept", "cut", "n_words", "items", "hit_words", "n_bytes", "n_removed", "n_spans", "n_tokens", "decoded", "label", "a.b", "__text")}
    more = spark.createDataFrame([(20 + k, toxic + str(k)) for k in range(12)] + [(60 + k, f"calm words about {k} gardens and rivers") for k in range(40)] + [(50, "lead " + PASSAGE + " " + " ".join(f"other{k}" for k in range(120))), (51, "one two three four five six seven eight nine ten eleven")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more).withColumns(named)
    spark.createDataFrame([(k, 1, 1) for k in range(20, 32)] + [(k, 1, 0) for k in (*range(12), *range(60, 100))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q", "two three four five six seven eight nine ten eleven")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [held.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, str(tmp_path))
        assert held.columns == docs.columns
        path = work_dir(spark, "odd")
        held.write.parquet(path)
        held = spark.read.parquet(path)
        rows = held.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in named)
        sizes.append(len(rows))
    by = {r.doc_id: r.text for r in held.collect()}
    assert not set(range(20, 32)) & set(by) and 51 not in by and by[None] == "no id" and by[2] is None and by[3] == "" and by[5] == LONG
    assert "shared3 " in by[6] and 7 not in by and 10 not in by and "shared3 " not in by[50] and "other3 " in by[50] and sum(r.doc_id == 9 for r in held.collect()) == 2
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert last.count() == sizes[-1] and set(last.columns) == {*docs.columns, "ids"} - {"text"}
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_toxicity_query_against_plain(spark):
    """Every cosine by dicts, every neighbour by sorting."""
    import math
    from collections import Counter

    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in text}

    def terms(x):
        raw = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in x.lower().encode())
        out = Counter()
        for w, n in Counter(raw.split()).items():
            whole = w.decode("utf-8", "ignore")
            for t in (w, *(b"^" + whole[:k].encode() for k in (4, 5, 6) if len(whole) > k)):
                out[t] += n
        return out

    own = {d: terms(text[d]) for d in label}
    size, positive = len(own), sum(label.values())
    n = Counter(t for c in own.values() for t in c)
    p = Counter(t for d, c in own.items() if label[d] for t in c)

    def weight(t):
        a, b = p[t], n[t] - p[t]
        table = [(a, n[t], positive), (b, n[t], size - positive), (positive - a, size - n[t], positive), (size - positive - b, size - n[t], size - positive)]
        ratio = max(0.0, 2 * sum(o * math.log(o * size / (r * s)) for o, r, s in table if o))
        return (math.log((size + 1) / (n[t] + 1)) + 1) * (1 + ratio) / (1 + ratio + 25)

    def unit(c):
        v = {t: (1 + math.log(k)) * weight(t) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {d: unit(c) for d, c in own.items() if c}
    share = positive / size
    blank = [label[d] for d, c in own.items() if not c]
    for r in queries.op5_toxicity(spark, SF).collect():
        q = terms(text[r.doc_id])
        if not q:
            assert r.score == pytest.approx((sum(blank) + share) / (len(blank) + 1))
            continue
        q = unit(q)
        near = sorted(((sum(x * v[t] for t, x in q.items() if t in v), d) for d, v in vectors.items()), key=lambda z: (-z[0], z[1]))[:15]
        near = [(c, d) for c, d in near if c > 0]
        votes = sum(c * c for c, _ in near)
        assert r.score == pytest.approx((sum(c * c * label[d] for c, d in near) + 0.5 * share) / (votes + 0.5), abs=1e-6)


def test_language_model_scores_against_plain(spark, monkeypatch):
    """The forward recursion token by token over the trained tables."""
    import math
    from collections import Counter

    from lodestone.llm.common import crc_mod5

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 40")
    model = hmm.train(docs.where(crc_mod5("doc_id") != 1))
    # buckets of parts of classes
    monkeypatch.setattr(hmm, "WHOLE", 16)
    monkeypatch.setattr(hmm, "BUCKET_BYTES", 8 << 10)
    hasher = hmm.Hasher()
    tokens = {r.doc_id: hasher(r.text or "").tolist() for r in docs.collect()}
    classes = {t: int(hmm.class_of(np.array([t], np.uint64))[0]) for own in tokens.values() for t in own}
    count = Counter(t for d, own in tokens.items() if zlib.crc32(str(d).encode()) % 5 != 1 for t in own)
    total, kinds = Counter(), Counter()
    for t, n in count.items():
        total[classes[t]] += n
        kinds[classes[t]] += 1
    for r in hmm.score(docs, model, crc_mod5("doc_id") != 1).collect():
        score, state = 0.0, None
        for t in tokens[r.doc_id]:
            c = classes[t]
            before = model.start if state is None else [sum(state[j] * model.move[j, k] for j in range(hmm.STATES)) for k in range(hmm.STATES)]
            state = [before[k] * model.emit[c, k] for k in range(hmm.STATES)]
            scale = sum(state)
            state = [s / scale for s in state]
            score += math.log10(scale) + math.log10((count[t] + 0.5) / (total[c] + 0.5 * (kinds[c] + 1)))
        assert r.score == pytest.approx(score, rel=1e-9)
