"""Embedding near-deduplication by hierarchical navigable small-world graphs, one per shard.

Vectors are dealt over shards by a hash of their id, and each shard's graph is a file
in the shared folder. Every vector is searched in every shard: it descends the levels
to the bottom one; where the beam ends within twice the threshold's angle, as for a member
of a large family, the shard is scanned exactly. The beam that a shard starts
with is doubled until an audit passes: the links that exact products find for some of the
shard's own vectors, and those vectors from probes made at the threshold, must be found; a
shard whose audit fails is scanned exactly, and so are the nodes without in-links in any.
What one end of a link finds counts for both. Candidates are verified by the cosine in
double precision, and links are united to components.

Searches run in lockstep: a batch of queries takes each step together in numpy.
"""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, quoted, work_dir
from .components import components
from .minhash import mix

#: Neighbours of a node on the bottom level and above, candidates on building, first beam.
BOTTOM, UPPER, BUILD_BEAM, FIRST_BEAM = 32, 16, 64, 48
#: Least share of the audit's links and probes to be found; number of vectors that it takes of a shard.
RECALL, PROBES = 0.998, 512
#: Vectors that a task searches in every shard, about; each shard is loaded once a task.
QUERIES = 8192
#: Shards, at least; bytes of vectors in one, at most.
SHARDS, SHARD_BYTES = 4, 64 << 20
#: Queries in lockstep, and nodes that each expands in a step.
LOCKSTEP, EXPAND = 256, 4
#: A wider beam expands this part of it in a step.
PART = 16
#: A beam that ends below this cosine is no part of a family.
UNLIKE = 0.5
#: Room below the threshold for single precision.
SLACK = 1e-4


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def first_of_each(ids: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Marks, in each row, the first of equal ids among the good ones."""
    key = np.where(good, ids, -1 - np.arange(ids.shape[1], dtype=ids.dtype)[None, :])
    order = np.argsort(key, axis=1, kind="stable")
    sorted_ = np.take_along_axis(key, order, 1)
    new = np.ones(ids.shape, bool)
    new[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
    out = np.empty(ids.shape, bool)
    np.put_along_axis(out, order, new, 1)
    return out & good


def search_level(space: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The best `beam` nodes for each query, best first (-1: none), from the `entry` nodes over `links`; `most`: number of nodes in the graph."""
    rows = len(queries)
    ids = np.full((rows, beam), -1, np.int64)
    sims = np.full((rows, beam), -2.0, np.float32)
    done = np.ones((rows, beam), bool)
    width = min(entry.shape[1], beam)
    first = (space[entry] @ queries[:, :, None])[:, :, 0]
    fresh = first_of_each(entry, np.ones(entry.shape, bool))
    first[~fresh] = -2.0
    order = np.argsort(-first, axis=1, kind="stable")[:, :width]
    ids[:, :width] = np.take_along_axis(entry, order, 1)
    sims[:, :width] = np.take_along_axis(first, order, 1)
    done[:, :width] = sims[:, :width] < -1.5
    ids[sims < -1.5] = -1
    live, expand, width = np.arange(rows), max(EXPAND, beam // PART), links.shape[1]
    # 0: not seen, else 1 + the place among a step's candidates
    seen = np.zeros(rows * most, np.uint16 if expand * width < 1 << 16 else np.uint32)
    seen[(np.arange(rows)[:, None] * most + entry).ravel()] = 1
    while live.size:
        # the best nodes of the beam that are not expanded yet stand first in it
        rank = np.argsort(done[live], axis=1, kind="stable")[:, :expand]
        at = ids[live[:, None], rank]
        open_ = ~done[live[:, None], rank]
        done[live[:, None], rank] = True
        near = links[np.where(open_, at, 0)].reshape(len(live), -1)
        r, c = np.nonzero((near >= 0) & np.repeat(open_, width, 1))
        found = near[r, c].astype(np.int64)
        key = live[r] * most + found
        new = np.flatnonzero(seen[key] == 0)
        key, place = key[new], (c[new] + 1).astype(seen.dtype)
        seen[key] = place
        new = new[seen[key] == place]  # one of equal candidates
        found, r = found[new], r[new]
        value = np.einsum("nd,nd->n", space[found], queries[live[r]])
        # what is not better than the beam's end doesn't enter it
        better = np.flatnonzero(value > sims[live[r], -1])
        if better.size:
            found, r, value = found[better], r[better], value[better]
            some, start, number = np.unique(r, return_index=True, return_counts=True)
            row, slot = np.repeat(np.arange(len(some)), number), np.arange(len(r)) - np.repeat(start, number)
            new_ids, new_sims = np.full((len(some), int(number.max())), -1, np.int64), np.full((len(some), int(number.max())), -2.0, np.float32)
            new_ids[row, slot], new_sims[row, slot] = found, value
            to = live[some]
            all_sims, all_ids = np.concatenate([sims[to], new_sims], 1), np.concatenate([ids[to], new_ids], 1)
            all_done = np.concatenate([done[to], new_ids < 0], 1)
            keep = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[to], ids[to], done[to] = (np.take_along_axis(x, keep, 1) for x in (all_sims, all_ids, all_done))
        live = live[~done[live].all(1)]
    return ids, sims


def diverse(space: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first, up to `most`: those nearer to the row's vector than to one chosen before, then the nearest of the rest."""
    rows, n = ids.shape
    own = space[np.maximum(ids, 0)]
    among = own @ own.transpose(0, 2, 1)
    chosen = np.zeros((rows, n), bool)
    good = ids >= 0
    # of each candidate, the nearest chosen one so far
    rival, number = np.full((rows, n), -2.0, np.float32), np.zeros(rows, np.int64)
    for j in range(n):
        new = np.flatnonzero(good[:, j] & (sims[:, j] > rival[:, j]) & (number < most))
        chosen[new, j] = True
        number[new] += 1
        rival[new] = np.maximum(rival[new], among[new, j])
    order = np.argsort(np.where(chosen, 0, np.where(good, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(np.where(good, ids, -1), order, 1)
    if n < most:
        out = np.pad(out, ((0, 0), (0, most - n)), constant_values=-1)
    return out.astype(np.int32)


class Graph:
    """Nodes in falling order of level; level l links the first sizes[l] of them."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, copies: np.ndarray):
        draw = (mix(ids.astype(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(float) / (1 << 53)
        level = np.floor(-np.log(np.maximum(draw, 1e-18)) / np.log(UPPER)).astype(int)
        order = np.lexsort((ids, -level))
        self.ids, self.copies, self.vectors = ids[order], copies[order], vectors[order]
        self.space = unit(self.vectors)
        level = np.sort(level)[::-1]
        top = int(level[0]) if len(level) else 0
        self.sizes = [int((level >= k).sum()) for k in range(top + 1)]
        self.links = [np.full((self.sizes[k], BOTTOM if k == 0 else UPPER), -1, np.int32) for k in range(top + 1)]
        self.beam, self.recall, self.exact = FIRST_BEAM, 1.0, False
        for k in range(top, -1, -1):
            self._build(k)
        self._mark()

    def _mark(self) -> None:
        """`lost`: the nodes that no link of the bottom level leads to."""
        into = np.zeros(len(self.ids), bool)
        into[self.links[0][self.links[0] >= 0]] = True
        self.lost = np.flatnonzero(~into)

    def _build(self, level: int) -> None:
        links, size = self.links[level], self.sizes[level]
        most = links.shape[1]
        done = min(size, 1)
        while done < size:
            new = np.arange(done, min(size, done + min(LOCKSTEP, done)))
            queries = self.space[new]
            entry = self._descend(queries, level + 1)
            entry = np.where(entry < done, entry, 0)
            ids, sims = search_level(self.space, links, queries, entry, min(BUILD_BEAM, max(8, done)), done)
            # nodes of one batch do not see one another in the graph
            own = queries @ queries.T
            np.fill_diagonal(own, -2.0)
            k = min(most, len(new) - 1)
            if k:
                near = np.argsort(-own, axis=1, kind="stable")[:, :k]
                ids, sims = np.concatenate([ids, new[near]], 1), np.concatenate([sims, np.take_along_axis(own, near, 1)], 1)
                order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
                ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            links[new] = diverse(self.space, ids, sims, most)
            self._back(links, new)
            done += len(new)

    def _back(self, links: np.ndarray, new: np.ndarray) -> None:
        """Adds the reverse links; a full node keeps a diverse choice."""
        most = links.shape[1]
        to = links[new].ravel().astype(np.int64)
        of = np.repeat(new, most)
        of, to = of[to >= 0], to[to >= 0]
        # a node of the batch may have the link already
        have = (links[to] == of[:, None]).any(1)
        of, to = of[~have], to[~have]
        # nodes of as many new links are together, so that few candidates are compared where one link is new
        order = np.lexsort((to, np.bincount(to, minlength=len(links))[to]))
        of, to = of[order], to[order]
        start = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
        nodes, count = to[start], np.diff(np.append(start, len(to)))
        for a in range(0, len(nodes), 512):
            u, s, c = nodes[a : a + 512], start[a : a + 512], count[a : a + 512]
            add = np.full((len(u), int(c.max())), -1, np.int64)
            slot = np.arange(add.shape[1])[None, :]
            add[slot < c[:, None]] = of[s[0] : s[-1] + c[-1]]
            ids = np.concatenate([links[u].astype(np.int64), add], 1)
            sims = (self.space[np.maximum(ids, 0)] @ self.space[u][:, :, None])[:, :, 0]
            sims[ids < 0] = -2.0
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * most]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            full = (ids >= 0).sum(1) > most
            links[u[~full]] = ids[~full][:, :most].astype(np.int32) if ids.shape[1] >= most else np.pad(ids[~full], ((0, 0), (0, most - ids.shape[1])), constant_values=-1).astype(np.int32)
            if full.any():
                links[u[full]] = diverse(self.space, ids[full], sims[full], most)

    def _descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """Entry nodes for the level below `to`."""
        entry = np.zeros((len(queries), 1), np.int64)
        for k in range(len(self.sizes) - 1, to - 1, -1):
            ids, _ = search_level(self.space, self.links[k], queries, entry, 8, self.sizes[k])
            entry = np.where(ids[:, :4] >= 0, ids[:, :4], ids[:, :1])
        return entry

    def near(self, queries: np.ndarray, least: float) -> list[np.ndarray]:
        """For each unit vector the nodes of cosine `least` or more; where all of the beam is within twice that angle, and links may lie behind its end, the shard is scanned."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        n = len(self.ids)
        step = max(1, min(LOCKSTEP, (64 << 20) // max(1, n)))
        if self.exact:
            return self._scan(queries, least)
        for a in range(0, len(queries), step):
            part, beam = queries[a : a + step], min(self.beam, n)
            ids, sims = search_level(self.space, self.links[0], part, self._descend(part, 1), beam, n)
            hit = sims >= least
            full = (sims >= min(least, max(UNLIKE, 2 * least**2 - 1))).all(1) & (beam < n)
            for k in np.flatnonzero(~full).tolist():
                out[a + k] = ids[k][hit[k]]
            for k, found in zip(np.flatnonzero(full).tolist(), self._scan(part[full], least), strict=True):
                out[a + k] = found
            if len(self.lost):
                for k, hit in enumerate(queries[a : a + step] @ self.space[self.lost].T >= least, a):
                    out[k] = np.union1d(out[k], self.lost[hit])
        return out

    def _scan(self, queries: np.ndarray, least: float) -> list[np.ndarray]:
        step = max(1, (16 << 20) // max(1, len(self.ids)))
        return [np.flatnonzero(hit) for a in range(0, len(queries), step) for hit in queries[a : a + step] @ self.space.T >= least]

    def audit(self, threshold: float) -> None:
        """Doubles the beam until the links of known vectors, and these from probes of cosine `threshold` to them, are found. If a beam of all nodes does not do, the shard is scanned exactly from then on."""
        n, width = self.space.shape
        if not n:
            return
        rng = np.random.default_rng(11)
        picked = np.sort(rng.permutation(n)[:PROBES])
        own = self.space[picked].astype(np.float64)
        aside = rng.standard_normal(own.shape)
        aside -= (aside * own).sum(1, keepdims=True) * own
        length = np.linalg.norm(aside, axis=1, keepdims=True)
        cosine = min(1.0, threshold + 1e-3)
        probes = (cosine * own + math.sqrt(1 - cosine**2) * aside / np.where(length > 0, length, 1)).astype(np.float32)
        # what is linked for certain, by exact products
        linked = self._scan(self.space[picked], threshold + SLACK)
        total = sum(map(len, linked))
        while True:
            found = self.near(probes, threshold - SLACK)
            probed = sum(p in f for p, f in zip(picked.tolist(), map(set, (x.tolist() for x in found)), strict=True)) / len(picked)
            found = self.near(self.space[picked], threshold - SLACK)
            self.recall = min(probed, sum(np.isin(a, b).sum() for a, b in zip(linked, found, strict=True)) / max(1, total))
            if self.recall >= RECALL or self.exact:
                return
            if self.beam >= n:
                self.exact = True
                continue
            self.beam *= 2

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, copies=self.copies, vectors=self.vectors, sizes=self.sizes, meta=[self.beam, self.recall, self.exact], roots=self.roots, **{f"links{k}": x for k, x in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Graph:
        self = cls.__new__(cls)
        kept = np.load(io.BytesIO(raw))
        self.ids, self.copies, self.vectors, self.roots = kept["ids"], kept["copies"], kept["vectors"], kept["roots"]
        self.sizes = kept["sizes"].tolist()
        self.links = [kept[f"links{k}"] for k in range(len(self.sizes))]
        self.beam, self.recall, self.exact = int(kept["meta"][0]), float(kept["meta"][1]), bool(kept["meta"][2])
        self.space = unit(self.vectors)
        self._mark()
        return self

    def linked(self, vectors: np.ndarray, ids: np.ndarray, threshold: float) -> list[np.ndarray]:
        """For each vector the other nodes linked with it, verified in double precision."""
        found = self.near(unit(vectors), threshold - SLACK)
        wide = vectors.astype(np.float64)
        norms = np.linalg.norm(wide, axis=1)
        out = []
        for k, nodes in enumerate(found):
            nodes = nodes[self.ids[nodes] != ids[k]]
            other = self.vectors[nodes].astype(np.float64)
            cosine = other @ wide[k] / (np.linalg.norm(other, axis=1) * norms[k]) if len(nodes) else np.zeros(0)
            out.append(nodes[cosine >= threshold])
        return out

    def unite(self, threshold: float) -> None:
        """`roots`: of each node the first node that its links inside the shard lead to."""
        parent = np.arange(len(self.ids))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = int(parent[k])
            return k

        for k, nodes in enumerate(self.linked(self.vectors, self.ids, threshold)):
            for j in nodes.tolist():
                a, b = root(k), root(j)
                parent[max(a, b)] = min(a, b)
        self.roots = np.array([root(k) for k in range(len(parent))], np.int64)


def _graph(path: str) -> Graph:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        return Graph.load(f.read())


def both_ends(node: int, copies: int, others: np.ndarray, their_copies: np.ndarray) -> np.ndarray:
    """Rows (end, other end, copies of the other end) of a node's links, for both ends: the other one may not find this one."""
    of = np.full(len(others), node)
    return np.concatenate([np.stack([of, others, their_copies], 1), np.stack([others, of, np.full(len(others), copies)], 1)])


def totals(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and the copies at the other ends of their links, each link once."""
    links = np.unique(links, axis=0)
    node, at = np.unique(links[:, 0], return_inverse=True)
    total = np.zeros(len(node), np.int64)
    np.add.at(total, at, links[:, 2])
    return node, total


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """`vec_id`, `n_links`, `component_id`, `kept` for each row.

    Vectors link if their cosine is `threshold` or more. Null vectors, those of norm 0
    and those with a null or non-finite component link with nothing and are kept;
    vectors of different lengths do not link. Rows of a null id are left out; rows of one
    id are vectors of their own that share the id: each is a row, and links with the others. Equal vectors are one node of the graph with a number of
    copies, so a group of copies makes no pairs. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    folder = work_dir(spark, "hnsw")
    values = F.col(quoted(vector_col)).cast("array<double>")
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    sound = F.coalesce(F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (norm > 0)
    rows = vectors.where(F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.when(sound, F.col(quoted(vector_col))).alias("v"))
    nodes = rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = checkpointed(nodes.withColumn("width", F.size("v")))
    n, size = nodes.agg(F.count("*"), F.coalesce(F.sum("width"), F.lit(0))).first()
    shards = max(SHARDS, math.ceil(4 * size / SHARD_BYTES))
    doubled = dict(nodes.dtypes)["v"] == "array<double>"

    def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64 if doubled else np.float32).reshape(-1, width)

    def build(table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py()
        graph = Graph(matrix(table.column("v"), width), table.column("node").to_numpy(), table.column("copies").to_numpy())
        graph.audit(threshold)
        graph.unite(threshold)
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{at}/_{name}") as f:
            f.write(graph.save())
        fs.move(f"{at}/_{name}", f"{at}/{name}")
        return pa.table({"width": pa.array([width], pa.int32()), "path": [f"{folder}/{name}"], "nodes": pa.array([table.num_rows], pa.int64()), "beam": pa.array([graph.beam], pa.int32()), "recall": [graph.recall]})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)))
    # a row a shard
    built = sorted(dealt.groupBy("width", "shard").applyInArrow(build, "width int, path string, nodes long, beam int, recall double").collect(), key=lambda r: r["path"])
    paths: dict[int, list[str]] = {}
    for r in built:
        paths.setdefault(r["width"], []).append(r["path"])

    def ask(batches):
        held = list(batches)
        if not held:
            return
        # a task's share of the vectors, about QUERIES
        batch = pa.concat_batches(held)
        widths = batch.column(3).to_numpy(zero_copy_only=False)
        for width in np.unique(widths):
            part = batch.filter(pa.array(widths == width))
            ids, copies = part.column(0).to_numpy(), part.column(2).to_numpy()
            own = matrix(part.column(1), int(width))
            ends, pairs = [set() for _ in ids], []
            for path in paths.get(int(width), []):
                graph = _graph(path)
                for k, found in enumerate(graph.linked(own, ids, threshold)):
                    ends[k].update(graph.ids[graph.roots[found]].tolist())
                    if len(found):
                        pairs.append(both_ends(ids[k], copies[k], graph.ids[found], graph.copies[found]))
                # what others reach by a root of this shard, its nodes reach too
                _, mine, here = np.intersect1d(ids, graph.ids, return_indices=True)
                for k, root in zip(mine.tolist(), graph.ids[graph.roots[here]].tolist(), strict=True):
                    ends[k].add(root)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([sorted(e) for e in ends], pa.list_(pa.int64())), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], names)
            found = np.concatenate([np.zeros((0, 3), np.int64), *pairs])
            bucket = (mix(found[:, 0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            rows = [(int(x), found[bucket == x].astype("<i8").tobytes()) for x in np.unique(bucket)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.list_(pa.int64())), pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names)

    def count(table: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 3) for x in table.column("pairs").to_pylist()])
        node, total = totals(found)
        return pa.table({"node": node, "others": total})

    buckets, names = max(1, math.ceil(n / QUERIES)), ["node", "ends", "bucket", "pairs"]
    asked = checkpointed(nodes.select("node", "v", "copies", "width").repartition(buckets, "node").mapInArrow(ask, "node long, ends array<long>, bucket int, pairs binary"))
    others = asked.where(F.col("bucket").isNotNull()).select("bucket", "pairs").groupBy("bucket").applyInArrow(count, "node long, others long")
    asked = asked.where(F.col("node").isNotNull())
    joined = components(asked.select(F.col("node").alias("a"), F.explode("ends").alias("b")))
    of_node = nodes.select("node", "copies").join(others, "node", "left").join(joined, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    by_vector = nodes.select("v", "node").join(of_node, "node").select("v", "n_links", "component")
    out = rows.join(by_vector, "v", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
