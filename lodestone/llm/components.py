"""Connected components by blocks of nodes that contract their links and send one another what changes.

Each block of nodes has the links from its nodes to smaller ones. In a round, which is
one exchange, a block hangs all that its links connect on the least node, tells other
blocks of links between their nodes that it found, and asks where the nodes go that its
own hang on. A node that others hang on is asked for once a block, so a hub costs a row
a block, and the nodes that hang on it are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Links of a block, about; blocks of a small graph, which has 64 links or more in each; links that a task contracts at a time before the first exchange.
BLOCK_LINKS, FEW_BLOCKS, BATCH_LINKS = 1 << 12, 24, 1 << 18
#: Kinds of rows `a`, `b`: a link of the block's own node, one that another block found, an answer (where a node of another block goes), and a question of block `b` for node `a`.
OWN, FOUND, TOLD, ASKED = range(4)


def hung(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, ascending, and the least node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        before = least.copy()
        low = np.minimum(before[x], before[y])
        for end in (x, y, before[x], before[y]):
            np.minimum.at(least, end, low)
        least = least[least]
        if (least == before).all():
            return nodes, nodes[least]


def block_of(nodes: np.ndarray, blocks: int) -> np.ndarray:
    return ((nodes.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks


def answered(me: int, kind: np.ndarray, a: np.ndarray, b: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What block `me` sends on the rows that it got: to which block, kinds, `a` and `b`."""
    link = kind != ASKED
    nodes, least = hung(a[link], b[link])
    home = block_of(nodes, blocks)
    goes, own = least != nodes, home == me
    # a node's block knows already of the link that it told, unless the node goes further
    known, place = np.zeros(len(nodes), bool), np.searchsorted(nodes, a[kind == TOLD])
    known[place[least[place] == b[kind == TOLD]]] = True
    mine, found = np.flatnonzero(goes & own), np.flatnonzero(goes & ~own & ~known)
    ends = np.unique(least[mine])
    ends = ends[block_of(ends, blocks) != me]
    node, asking = a[~link], b[~link]
    place = np.minimum(np.searchsorted(nodes, node), max(0, len(nodes) - 1))
    hit = (nodes[place] == node) & goes[place] if len(nodes) else np.zeros(len(node), bool)
    place, asking = place[hit], asking[hit]
    parts = [
        (home[mine], OWN, nodes[mine], least[mine]),
        (home[found], FOUND, nodes[found], least[found]),
        (asking, TOLD, nodes[place], least[place]),
        (block_of(ends, blocks), ASKED, ends, np.full(len(ends), me)),
    ]
    return tuple(np.concatenate(x) for x in zip(*((to, np.full(len(p), k), p, q) for to, k, p, q in parts), strict=True))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links from each node to the least one that it is connected with, by BATCH_LINKS."""
    held, size = [], 0

    def links():
        nodes, least = hung(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1)))
        goes = least != nodes
        return nodes[goes], least[goes]

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BATCH_LINKS:
            yield links()
            held, size = [], 0
    if size:
        yield links()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for a, b in _contracted(batches):
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """From edges `a`, `b` (long): `node`, `component` (its least node) for every node on an edge.

    Loops, repeated and reversed edges, and edges with a null end do no harm.
    """
    rows = "block int, kind int, a long, b long"
    links = checkpointed(edges.where(F.col("a") != F.col("b")).select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contract, "a long, b long"))
    n = links.count()
    blocks = max(1, min(FEW_BLOCKS, n // 64), -(-n // BLOCK_LINKS))

    def table(to, kind, a, b) -> list[pa.Array]:
        return [pa.array(to, pa.int32()), pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]

    def send(batches):
        for a, b in _contracted(batches):
            yield pa.RecordBatch.from_arrays(table(block_of(a, blocks), np.full(len(a), FOUND), a, b), ["block", "kind", "a", "b"])

    def work(got: pa.Table) -> pa.Table:
        kind, a, b = (got.column(c).to_numpy() for c in ("kind", "a", "b"))
        return pa.table(table(*answered(got.column("block")[0].as_py(), kind, a, b, blocks)), names=["block", "kind", "a", "b"])

    sent, quiet = links.coalesce(blocks).mapInArrow(send, rows), False
    while True:
        # a block's rows are few, so no more tasks than blocks read them
        sent = checkpointed(sent.groupBy("block").applyInArrow(work, rows)).coalesce(blocks)
        news, asked = sent.agg(F.count_if(F.col("kind").isin(FOUND, TOLD)), F.count_if(F.col("kind") == ASKED)).first()
        # nothing changed after what was asked in the last round: all that nodes hang on are least
        if not news and (quiet or not asked):
            break
        quiet = not news
    found = sent.where(F.col("kind") == OWN)
    roots = found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
