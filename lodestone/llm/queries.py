"""The queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, hmm, hnsw, minhash, piece_counts, prefix_trie, quality, spans, suffix, token_store, toxicity, vector_codes
from .common import crc_mod5, read, work_dir


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=2, percent=80)


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode_decode(read(spark, sf_dir, "documents"), vocabulary(), carry=["doc_id"])
    return made.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(read(spark, sf_dir, "embeddings"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffix.remove_repeats(read(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, carry=["doc_id"]).select(
        "doc_id", (crc_mod5("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), carry=["doc_id"], nameless=True)
    return made.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=["doc_id"]).select(
        "doc_id", (crc_mod5("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "terms"
    )


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_store.write_store(read(spark, sf_dir, "documents"), work_dir(spark, "tokens"), vocabulary())
    return token_store.read_store(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod5("doc_id") == 1
    model = hmm.train(docs.where(~held_out))
    return hmm.score(docs, model, ~held_out).withColumn("held_out", held_out)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"), openings=True)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.count_tokens(read(spark, sf_dir, "documents"), pieces(), carry=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hnsw": op1_hnsw,
    "op2_suffix_array": op2_suffix_array,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_token_store": op6_token_store,
    "op7_minhash": op7_minhash,
    "op8_sentence_spans": op8_sentence_spans,
    "op9_bpe": op9_bpe,
    "op10_hmm": op10_hmm,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_counts": op13_token_counts,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS4 = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_SEQ7 = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

#: crc32 of the decimal conv_id: a table of bytes by eight shifts each, then a step a digit.
_CRC11 = """(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t)"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """One step of assignment and of means for each round, written out."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT id, p, e, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v JOIN c{k} c USING (p)),
a{k} AS MATERIALIZED (SELECT id, p, min(d) AS d, arg_min(e, d * {entries} + e) AS e FROM d{k} GROUP BY id, p)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT p, e, j, sum(x) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS x, unnest(range(len(x))) AS j FROM a{k} JOIN v USING (id, p)) GROUP BY ALL),
m{k} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM s{k} GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (p, e))""")
    return f"""
WITH w AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT id, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM w, range({parts}) r(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY id) - 1 AS e, x FROM v WHERE id IN (SELECT id FROM w ORDER BY id LIMIT {entries})),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM c{rounds}),
o AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id)
SELECT id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM o JOIN w USING (id), h
"""


ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": f"""
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(x ORDER BY k) AS x FROM o GROUP BY c),
h AS (SELECT c, x, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda y: ascii(y)::BIGINT)), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) % 9 AS h FROM l, {_CRC11}),
r AS (SELECT h.c, coalesce(b.x[1 : h.h], []) || h.x[h.h + 1 :] AS x FROM h LEFT JOIN l b ON b.c = h.c - h.c % 5),
p AS (SELECT c, d, x[1 : d] AS key, len(x) AS n FROM (SELECT c, x, unnest(range(len(x) + 1)) AS d FROM r)),
g AS (SELECT d, key, min(c) AS id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM p GROUP BY d, key),
u AS (SELECT g.*, q.id AS up FROM g LEFT JOIN g q ON q.d = g.d - 1 AND q.key = g.key[1 : g.d - 1]),
k AS (SELECT u.*, coalesce(m.n, 0) AS n_children FROM u LEFT JOIN (SELECT d - 1 AS d, up AS id, count(*) AS n FROM u WHERE d > 0 GROUP BY ALL) m USING (d, id)),
s AS (SELECT a.d, a.key, count(*) FILTER (k.n_children = 0) AS n_leaves, sum((k.n_convs - 1) * strlen(coalesce(k.key[k.d].t, '')))::BIGINT AS saved FROM k JOIN p a ON a.c = k.id AND a.d <= k.d GROUP BY a.d, a.key)
SELECT k.id AS conv_id, k.d AS depth, k.up AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved AS saved_tokens, k.ends AS ends_sha256 FROM k JOIN s USING (d, key)
""",
    "op12_vector_codes": _codes_sql(),
    "op1_hnsw": """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
                     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node WHERE r.seen < l.b)
SELECT d.vec_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_links, m.c AS component_id, m.c = d.vec_id AS kept
FROM embeddings d JOIN (SELECT node, min(seen) AS c FROM r GROUP BY node) m ON m.node = d.vec_id
LEFT JOIN (SELECT a, count(*) AS c FROM l GROUP BY a) n ON n.a = d.vec_id
""",
    "op7_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SEQ7} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
             ELSE list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT g.b, r.seen FROM r JOIN g ON g.a = r.node WHERE r.seen < g.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = s.doc_id AS kept
FROM s JOIN (SELECT node, min(seen) AS c FROM r GROUP BY node) m ON m.node = s.doc_id
""",
    "op2_suffix_array": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT doc_id, p, b[p + 1 : p + 50] AS s FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 49)) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s HAVING count(*) > 1),
x AS (SELECT doc_id, p, lag(p) OVER w AS o, lead(p) OVER w AS n FROM (SELECT g.doc_id, p FROM g JOIN f USING (s) WHERE m < doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
t AS (SELECT doc_id, sum(least(50, coalesce(n - p, 50))) AS removed, count(*) FILTER (n IS NULL OR n - p > 50) AS spans,
             list(p ORDER BY p) FILTER (o IS NULL OR p - o > 50) AS starts, list(p + 50 ORDER BY p) FILTER (n IS NULL OR n - p > 50) AS ends FROM x GROUP BY 1),
k AS (SELECT doc_id, string_agg(hex(b[a + 1 : e]), '' ORDER BY a) AS h FROM (SELECT d.doc_id, b, unnest([0] || ends) AS a, unnest(starts || [octet_length(b)]) AS e FROM d JOIN t USING (doc_id)) WHERE e > a GROUP BY 1)
SELECT d.doc_id, octet_length(b) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN removed IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
""",
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS4} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS4} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, n, i, item FROM dw JOIN bw USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
