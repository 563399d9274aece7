"""MinHash near-deduplication by fast similarity sketching.

A set's elements are thrown into the sketch's bins, round after round with a new
hash, until every bin is filled; after as many rounds as there are bins, round
t + b throws all elements into bin b, so that each is filled for certain. A bin keeps
its least (round, hash). The fraction of equal bins is concentrated about the Jaccard
similarity as with as many independent hashes. Bands of bins give candidates, which
are confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Kept
from .common import LOWER, TEXT, checkpointed, map_texts, quoted
from .components import components

#: Words of a shingle, and the least similarity of a link in percent.
SHINGLE, PERCENT = 5, 80
#: A pair of similarity 0.8 shares no band with a probability of (1 - 0.8**4)**32 < 5e-8.
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Sets in a block of those compared with one another.
COMPARED = 1024
#: Sets in a band's bucket up to which each pair is a candidate at once.
SMALL = 16
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles: runs of `size` words; the whole sequence if there are fewer."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, Kept(lambda words: [xxhash.xxh64_intdigest(w) for w in words])

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known.having(set(words))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(words))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = mix((out + _A) ^ h[k : len(h) - size + 1 + k])
        return np.unique(out)


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The least (round, hash) of each bin for a set of one element or more."""
    n, at = len(elements), 0
    out = np.full(bins, np.uint64(2**64 - 1))
    while at < bins:
        rounds = np.arange(at, min(bins, at + max(1, 700 // n)), dtype=np.uint64)
        h = mix(elements[None, :] ^ mix((rounds + np.uint64(1)) * _A)[:, None])
        value = (rounds[:, None] << np.uint64(48)) | (h >> np.uint64(16))
        np.minimum.at(out, (h % np.uint64(bins)).astype(np.int64).ravel(), value.ravel())
        at += len(rounds)
        if (out < np.uint64(2**64 - 1)).all():
            return out
    for b in np.flatnonzero(out == np.uint64(2**64 - 1)).tolist():
        r = np.array([bins + b], np.uint64)
        out[b] = ((r << np.uint64(48)) | (mix(elements ^ mix((r + np.uint64(1)) * _A)) >> np.uint64(16))).min()
    return out


def bands(drawn: np.ndarray) -> np.ndarray:
    """A hash for each band, with the band's number in it."""
    rows = drawn.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _A
    for k in range(ROWS):
        h = mix((h + _A) ^ rows[:, k])
    return h.view(np.int64)


def _features(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def make():
        shingles = Shingler(shingle)

        def work(texts):
            sets = [shingles(x) for x in texts]
            return [
                [len(s) for s in sets],
                [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                [bands(sketch(s)) if len(s) else None for s in sets],
            ]

        return work

    return map_texts(docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")), make, "n_shingles long, set_key binary, bands array<long>", "text", ["doc_id"])


def _confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """The pairs `a`, `b` whose full sets are similar enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def make():
        shingles = Shingler(shingle)
        return lambda texts: [[shingles(x).tobytes() for x in texts]]

    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).join(wanted, "doc_id", "left_semi")
    # a null id is in no pair; of rows of one id, which is defined as one document, the first by text counts
    sets = map_texts(texts, make, "elements binary", "text", ["doc_id"]).groupBy("doc_id").agg(F.min("elements").alias("elements"))
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), "a")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _rest(large: DataFrame, joined: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """Links `a`, `b` that join the components of classes in large buckets.

    Classes that large buckets connect, linked or not, are a group. In each group the
    classes outside of its main component are compared with all of its classes: both
    are dealt into blocks, and a task compares one block with another by an inverted
    index. So pairs are looked at in a task and never made as rows, and no task holds
    more than two blocks.
    """
    groups = components(large.select(F.col("least.rep").alias("a"), F.col("rep").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    members = groups.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", "family", F.coalesce("component", "rep").alias("component"))
    sizes = members.groupBy("family", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("family").agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("m"))
    main = main.where(F.col("m.n") < F.col("all")).select("family", "all", (F.col("all") - F.col("m.n")).alias("apart"), (-F.col("m.c")).alias("main"))
    split = checkpointed(members.join(main, "family"))

    def make():
        shingles = Shingler(shingle)
        return lambda texts: [[shingles(x).tobytes() for x in texts]]

    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("rep"), F.col(quoted(text_col)).alias("text")).join(split.select("rep"), "rep", "left_semi")
    sets = map_texts(texts, make, "elements binary", "text", ["rep"]).groupBy("rep").agg(F.min("elements").alias("elements"))
    held = checkpointed(split.join(sets, "rep"))
    left_blocks, right_blocks = (F.ceil(F.col(c) / COMPARED).cast("int") for c in ("apart", "all"))
    mine = lambda blocks: F.pmod(F.xxhash64("rep"), blocks).cast("int")
    to = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    kept = ["family", "rep", "component", "elements"]
    left = held.where(F.col("component") != F.col("main")).select(*kept, mine(left_blocks).alias("i"), to(right_blocks).alias("j"))
    right = held.select(*kept, mine(right_blocks).alias("j"), to(left_blocks).alias("i"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            x = [np.frombuffer(e, np.uint64) for e in left.column("elements").to_pylist()]
            owner = np.repeat(np.arange(len(x)), [len(e) for e in x])
            flat = np.concatenate(x)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            n = np.array([len(e) for e in x])
            ids, parts = left.column("rep").to_pylist(), left.column("component").to_numpy()
            for rep, part, e in zip(right.column("rep").to_pylist(), right.column("component").to_pylist(), right.column("elements").to_pylist(), strict=True):
                y = np.frombuffer(e, np.uint64)
                lo, hi = np.searchsorted(flat, y, "left"), np.searchsorted(flat, y, "right")
                count = hi - lo
                total = int(count.sum())
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
                shared = np.bincount(owner[at], minlength=len(x))
                for k in np.flatnonzero((100 * shared >= percent * (n + len(y) - shared)) & (parts != part)).tolist():
                    a.append(min(ids[k], rep))
                    b.append(max(ids[k], rep))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = ["family", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` and `kept` (the least id of its component) for each row.

    Texts link if 100 * |common shingles| >= `percent` * |all shingles|. Null, empty
    and blank texts have no shingles, link with nothing and are kept. Rows of a null
    id are left out. Each row of a repeated id is returned, of one component and kept
    alike if their texts are the same; where texts of one id differ, their least set
    is what links are confirmed on. An empty table gives an empty result.

    Equal sets are one class, represented by its least id, so a group of copies costs
    one row from there on. In a bucket of up to SMALL classes each pair is a candidate;
    in a larger one each class is compared with the least one first; classes that are
    then outside of the main component of their family are compared with all of it.
    """
    features = checkpointed(_features(docs, id_col, text_col, shingle).where(F.col("doc_id").isNotNull()))
    classes = features.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "bands")).getField("bands").alias("bands"), F.first("n_shingles").alias("n"))
    classes = checkpointed(classes)
    rows = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n")).alias("least")).where(F.col("size") > 1)
    shared = checkpointed(rows.join(sizes, "bucket"))

    def fits(a, b):
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    small = shared.where(F.col("size") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("rep", "n"))).alias("own"))
    ends = small.select(F.posexplode("own").alias("k", "x"), "own").select("x", F.explode(F.slice("own", F.col("k") + 2, SMALL)).alias("y"))
    pairs = ends.where(fits(F.col("x.n"), F.col("y.n"))).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    large = shared.where(F.col("size") > SMALL)
    stars = large.where((F.col("least.rep") != F.col("rep")) & fits(F.col("least.n"), F.col("n"))).select(F.col("least.rep").alias("a"), F.col("rep").alias("b"))
    links = checkpointed(_confirmed(pairs.unionByName(stars).distinct(), docs, id_col, text_col, shingle, percent))
    joined = components(links)

    if not large.isEmpty():
        more = checkpointed(_rest(large, joined, docs, id_col, text_col, shingle, percent))
        if not more.isEmpty():
            joined = components(joined.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))
    roots = joined.select(F.col("node").alias("rep"), "component")
    by_class = classes.select("set_key", "rep").join(roots, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = features.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
