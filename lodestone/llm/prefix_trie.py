"""Conversation prefix trie by prefix-doubling naming.

A node is a distinct sequence of a conversation's first turns; its name is the smallest
conversation that starts with it. Names are made in logarithmic rounds of grouping and
joining:

* turns that several conversations have at the same place get a name, then pairs of
  neighbouring blocks of 1, 2, 4, ... turns, as long as any are shared;
* a prefix of d turns is a row of such blocks, by the binary digits of d: from the largest
  power of two down, each round adds a block to the prefixes that end where it begins.

A block or prefix that only one conversation has needs no row: its name is known. So a
round costs what is shared, and nothing is compared but digests of turns, once, and
numbers. Groups are reduced to their minimum and count before the shuffle. Sums over
subtrees are sums over members: each node counts at the place of its smallest member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, quoted, work_dir

#: Turns of a conversation whose sums one group runs through.
SPAN = 1024
#: The conversations of a block of ids whose first one lends its opening turns, and one more than the turns it may lend.
FAMILY, OPENINGS = 5, 9

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_NOTHING = hashlib.sha256(b"").hexdigest()


class _Tables:
    """Tables in the shared folder, dropped together."""

    def __init__(self, spark):
        self.spark, self.path, self.n = spark, work_dir(spark, "trie"), 0

    def written(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, keep=None) -> DataFrame:
    """Turns in order: `conv`, `at` (0, 1, ...), `digest` of role and text, `bytes` of the text.

    One sort by ranges, so that a long conversation is in several tasks; a turn number
    that many rows of one conversation have is in one, which sorts it on disk.
    """
    keep = keep or _Tables(df.sparkSession).written
    empty = F.lit("")
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("conv"), F.col(quoted(turn_col)).alias("turn"), F.coalesce(F.col(quoted(role_col)).cast("string"), empty).alias("role"), F.coalesce(F.col(quoted(text_col)).cast("string"), empty).alias("text")).where("conv IS NOT NULL")
    place = [F.col("conv").asc(), F.col("turn").asc_nulls_first()]
    # the role's length keeps ("ab", "c") and ("a", "bc") apart
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.repartitionByRange(*place).sortWithinPartitions(*place, "role", "text").select("conv", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0)
            starts = pc.run_end_encode(conv)
            at, before = [], 0
            for value, end in zip(starts.values.to_pylist(), starts.run_ends.to_pylist(), strict=True):
                seen = seen if value == last else 0
                at += range(seen, seen + end - before)
                seen, last, before = seen + end - before, value, end
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(conv), pa.int32()), conv, pa.array(at, pa.int64()), batch.column(1), batch.column(2)], ["part", "conv", "at", "digest", "bytes"])

    made = keep(rows.mapInArrow(run, "part int, conv bigint, at bigint, digest binary, bytes bigint"))
    # a task's first conversation may have begun in tasks before: at most one such row a task
    own = made.groupBy("conv", "part").agg((F.max("at") + 1).alias("n"))
    before = own.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).where("before IS NOT NULL").select("conv", "part", "before")
    return made.join(F.broadcast(before), ["conv", "part"], "left").select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "digest", "bytes")


def with_openings(turns: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with turns of the first one of their family.

    Conversation c gets the first h turns of conversation c - c % FAMILY (all if there
    are fewer, none if it is absent), then its own after its first h, with h = crc32 of
    the decimal c modulo OPENINGS. Gives `conv`, `depth` (from 1), `digest`, `bytes`,
    `size` (turns in all) for each turn, and `conv`, `size` for each conversation.
    """
    own = turns.groupBy("conv").agg((F.max("at") + 1).alias("n"))
    lent = turns.where((F.col("at") < OPENINGS - 1) & (F.col("conv") % FAMILY == 0)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "digest", "bytes"))).alias("lent"))
    convs = own.withColumns({"h": F.crc32(F.encode(F.col("conv").cast("string"), "utf-8")) % OPENINGS, "base": F.col("conv") - F.col("conv") % FAMILY}).join(lent, "base", "left")
    convs = convs.withColumn("k", F.when(F.col("lent").isNull(), F.lit(0)).otherwise(F.least("h", F.size("lent"))).cast("long")).withColumn("size", F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    convs = keep(convs.select("conv", "h", "k", "size", F.slice("lent", F.lit(1), F.col("k").cast("int")).alias("lent")))
    first = convs.select("conv", "size", F.explode("lent").alias("t")).select("conv", (F.col("t.at") + 1).alias("depth"), "t.digest", "t.bytes", "size")
    rest = turns.join(convs.select("conv", "h", "k", "size"), "conv").where("at >= h").select("conv", (F.col("k") + F.col("at") - F.col("h") + 1).alias("depth"), "digest", "bytes", "size")
    return keep(first.unionByName(rest)), convs.select("conv", "size")


def as_they_are(turns: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """The same columns as `with_openings`, of conversations left as they are."""
    turns = keep(turns)
    convs = keep(turns.groupBy("conv").agg((F.max("at") + 1).alias("size")))
    return turns.join(convs, "conv").select("conv", (F.col("at") + 1).alias("depth"), "digest", "bytes", "size"), convs


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys other conversations have too, with the smallest of these as `name`."""
    groups = rows.groupBy(*keys).agg(F.min("conv").alias("name"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(groups, keys)


def shared_prefixes(turns: DataFrame, keep) -> DataFrame:
    """`conv`, `depth`, `name` for every prefix that several conversations have."""
    blocks = [keep(named(turns.select("conv", (F.col("depth") - 1).alias("start"), "digest"), ["start", "digest"]).select("conv", "start", "name"))]
    while True:
        size = 1 << len(blocks)
        within = F.col("start") % size
        halves = blocks[-1].groupBy("conv", (F.col("start") - within).alias("start")).agg(F.max(F.when(within == 0, F.col("name"))).alias("a"), F.max(F.when(within != 0, F.col("name"))).alias("b"))
        level = keep(named(halves.where("a IS NOT NULL AND b IS NOT NULL"), ["start", "a", "b"]).select("conv", "start", "name"))
        if level.isEmpty():
            break
        blocks.append(level)
    known: DataFrame | None = None
    for k in reversed(range(len(blocks))):
        size = 1 << k
        block = blocks[k].where(F.col("start") % (2 * size) == 0)
        made = block.where("start = 0").select("conv", F.lit(size).cast("long").alias("depth"), "name")
        if known is not None:
            longer = known.where(F.col("depth") % (2 * size) == 0).select("conv", F.col("depth").alias("start"), F.col("name").alias("a"))
            longer = named(longer.join(block.select("conv", "start", F.col("name").alias("b")), ["conv", "start"]), ["start", "a", "b"])
            made = made.unionByName(longer.select("conv", (F.col("start") + size).alias("depth"), "name"))
        made = keep(made)
        known = made if known is None else known.unionByName(made)
    return known


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """`depth`, `name`, `ends_sha256` over the ids `conv` of each group, ascending. A group is streamed: a digest's state is all that is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64()), pa.array([state.hexdigest()])], ["depth", "name", "ends_sha256"])

        for batch in batches:
            depth, name, conv = (c.to_pylist() for c in batch.columns)
            a = 0
            while a < len(conv):
                key, b = (depth[a], name[a]), a + 1
                while b < len(conv) and (depth[b], name[b]) == key:
                    b += 1
                text = ",".join(map(str, conv[a:b])).encode()
                if key == held:
                    state.update(b"," + text)
                else:
                    if held is not None:
                        yield row()
                    held, state = key, hashlib.sha256(text)
                a = b
        if held is not None:
            yield row()

    return ends.select("depth", "name", "conv").repartition("depth", "name").sortWithinPartitions("depth", "name", "conv").mapInArrow(run, "depth bigint, name bigint, ends_sha256 string")


def after_sums(rows: DataFrame, values: list[str]) -> DataFrame:
    """Each conversation's values summed from a depth to its end, by `conv` and `depth`.

    Spans of SPAN depths are summed by themselves and then each other, so that a long
    conversation is no single group.
    """
    span = (F.col("depth") / SPAN).cast("long")
    rows = rows.withColumn("span", span)
    inside = Window.partitionBy("conv", "span").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    beyond = Window.partitionBy("conv").orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("conv", "span").agg(*(F.sum(v).alias(v) for v in values))
    whole = whole.select("conv", "span", *(F.sum(v).over(beyond).alias(f"{v}_beyond") for v in values)).where(" OR ".join(f"{v}_beyond <> 0" for v in values))
    summed = rows.withColumns({v: F.sum(v).over(inside) for v in values}).join(whole, ["conv", "span"], "left")
    return summed.withColumns({v: F.col(v) + F.coalesce(f"{v}_beyond", F.lit(0)) for v in values}).drop("span", *(f"{v}_beyond" for v in values))


def prefix_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", openings: bool = False) -> DataFrame:
    """A row for each distinct sequence of first turns (role, text), from the textless root at depth 0.

    `conv_id`: its smallest member; `depth`; `parent_conv_id`: the parent's `conv_id`
    (root: null); `n_convs`: members; `n_children`; `n_leaves`: childless nodes in its
    subtree, itself included; `saved_tokens`: over its subtree, members but one times
    UTF-8 bytes of the last text; `ends_sha256`: of the ids of the members that end here,
    ascending, comma-joined. `openings`: conversations start with turns of their family's
    first one (`with_openings`), before the trie is built.

    Turns are ordered by number, null first, then by role and text; repeated turns are
    turns. Null roles and texts are empty. Rows of a null id belong to no conversation and
    are left out. Turnless conversations are members of the root. An empty table has no
    root and gives no rows. Other columns are left out, whatever their names.
    """
    spark = df.sparkSession
    tables, keep = _Tables(spark), None
    keep = tables.written
    turns, convs = (with_openings if openings else as_they_are)(numbered(df, id_col, turn_col, role_col, text_col, keep), keep)
    root = convs.agg(F.min("conv")).first()[0]
    if root is None:
        return spark.createDataFrame([], NODE)
    prefixes = shared_prefixes(turns, keep)
    ahead = prefixes.select("conv", "depth", "name", F.lit(None).cast("long").alias("parent")).unionByName(prefixes.select("conv", (F.col("depth") + 1).alias("depth"), F.lit(None).cast("long").alias("name"), F.col("name").alias("parent")))
    places = keep(turns.select("conv", "depth", "bytes", "size").join(ahead.groupBy("conv", "depth").agg(F.max("name").alias("name"), F.max("parent").alias("parent")), ["conv", "depth"], "left"))
    shared, alone = places.where("name IS NOT NULL"), places.where("name IS NULL")
    forks = alone.where("parent IS NOT NULL").select("conv", (F.col("depth") - 1).alias("depth"), F.col("parent").alias("name"))

    nodes = shared.groupBy("depth", "name").agg(F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"))
    below = nodes.where("depth > 1").select((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).unionByName(forks.select("depth", "name")).groupBy("depth", "name").agg(F.count("*").alias("n_children"))
    nodes = keep(nodes.join(below, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # what counts at the place of a node's smallest member, and a leaf of one conversation at the last place that it shares
    zero = F.lit(0).cast("long")
    values = nodes.select(F.col("name").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves")).unionByName(forks.select("conv", "depth", zero.alias("saved"), (zero + 1).alias("leaves")))
    values = keep(values.groupBy("conv", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")))
    sums = shared.select("conv", "depth", "name").join(values, ["conv", "depth"], "left").na.fill(0, ["saved", "leaves"])
    sums = after_sums(sums, ["saved", "leaves"]).groupBy("depth", "name").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = digests_of_ends(shared.where("depth = size").select("depth", "name", "conv").unionByName(convs.where("size = 0").select(zero.alias("depth"), F.lit(root).cast("long").alias("name"), "conv")))
    ends = keep(ends)

    above = F.when(F.col("depth") > 1, F.coalesce("parent", F.col("name"))).otherwise(F.lit(root).cast("long"))
    own = nodes.join(sums, ["depth", "name"]).join(ends, ["depth", "name"], "left").select(F.col("name").alias("conv_id"), "depth", above.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))
    last = F.col("depth") == F.col("size")
    single = alone.withColumn("name", F.col("conv")).select(F.col("conv").alias("conv_id"), "depth", above.alias("parent_conv_id"), (zero + 1).alias("n_convs"), (~last).cast("long").alias("n_children"), (zero + 1).alias("n_leaves"), zero.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(_NOTHING)).alias("ends_sha256"))

    def part(rows: DataFrame, **counted) -> DataFrame:
        return rows.select(*(F.lit(counted.get(c, 0)).cast("long").alias(c) if not hasattr(counted.get(c), "alias") else counted[c].alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))

    counts = part(convs, n_convs=1).unionByName(part(nodes.where("depth = 1"), n_children=1)).unionByName(part(alone.where("depth = 1"), n_children=1, n_leaves=1)).unionByName(part(values, n_leaves=F.col("leaves"), saved_tokens=F.col("saved")))
    top = counts.agg(*(F.sum(c).alias(c) for c in counts.columns)).withColumns({"depth": zero, "name": F.lit(root).cast("long")}).join(F.broadcast(ends.where("depth = 0")), ["depth", "name"], "left")
    top = top.select(F.col("name").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.greatest("n_leaves", zero + 1).alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))
    # what remains of the tables in between goes; the result stays
    made = spark.read.schema(NODE).parquet(_result(own.unionByName(single).unionByName(top), work_dir(spark, "trie-nodes")))
    drop_path(spark, tables.path)
    return made


def _result(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path
