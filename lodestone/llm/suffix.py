"""Exact substring deduplication by suffix arrays and longest-previous-factor arrays.

A byte goes if it is covered by a string of `LENGTH` bytes that also starts in a
document of a smaller id. Three steps share one exchange of documents into blocks:

1. Every window of LENGTH bytes is named by the least hash of its grams of GRAM bytes,
   so equal windows have equal names. Consecutive windows of one name are a run. Each
   block sends the names it has, by buckets of names; a bucket answers which of them
   several documents have.
2. Runs of such names are sent to their bucket. There the suffixes of the runs are
   sorted to a depth of LENGTH, and the previous and next places of a smaller document
   in suffix order give the longest previous factor: one of LENGTH is an earlier match.
3. Each block cuts the union of the matches out of its documents.

A name, a text of a run and an answer occur once in a block, however many documents
share them, so a passage that is everywhere costs a row a block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plan_bytes, quoted, release, runs_of_equal

#: Bytes of a match.
LENGTH = 50
#: Input file bytes of a block of documents, and of a bucket of names.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 4 << 20
#: Bytes of a block whose windows are named at a time, and bytes of a bucket's runs whose suffixes are sorted at a time, about.
PIECE_BYTES = 1 << 18
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M[1]
    x = (x ^ (x >> np.uint64(29))) * _M[2]
    return x ^ (x >> np.uint64(32))


class Block:
    """Documents one after the other, in ascending order of ids, then of texts."""

    def __init__(self, ids: list[int], texts: list[bytes], length: int = LENGTH):
        self.length = length
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.order = order
        self.ids = np.array([ids[k] for k in order], np.int64)
        self.ends = np.cumsum([0, *(len(texts[k]) for k in order)])
        self.size = int(self.ends[-1])
        self.raw = np.frombuffer(b"".join([*(texts[k] for k in order), bytes(length + 16)]), np.uint8)

    def _names(self, start: int, stop: int) -> np.ndarray:
        """The least hash of the grams of each window that starts in the range."""
        length = self.length
        gram = max(8, length // 2 // 8 * 8)
        n = stop - start + length - gram
        words = np.ndarray((n + gram,), "<u8", self.raw.data, start, (1,))
        h = words[:n] * _M[0]
        for k, at in enumerate(range(8, gram, 8)):
            h = (h ^ (h >> np.uint64(31))) * _M[1 + k % 3] + words[at : n + at]
        h = _mix(h)
        width, k = length - gram + 1, 1
        while k * 2 <= width:
            h = np.minimum(h[:-k], h[k:])
            k *= 2
        if width > k:
            h = np.minimum(h[: -(width - k)], h[width - k :])
        return h

    def runs(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the documents marked in `use`: names, starts, numbers of windows and documents of the runs."""
        length, empty = self.length, np.zeros(0, np.int64)
        starts = max(0, self.size - length + 1)
        valid, heads = np.zeros(starts, bool), np.zeros(starts, bool)
        for a, b in zip(self.ends[:-1][use].tolist(), (self.ends[1:][use] - length + 1).tolist(), strict=True):
            if a < b:
                valid[a:b] = True
                # a document's first window starts a run even right behind another document's last
                heads[a] = True
        names, places, last = [empty.view(np.uint64)], [empty], np.zeros(1, np.uint64)
        for a in range(0, starts, PIECE_BYTES):
            b = min(starts, a + PIECE_BYTES)
            name = self._names(a, b)
            at = np.flatnonzero(valid[a:b] & (heads[a:b] | (name != np.concatenate([last, name[:-1]]))))
            names.append(name[at])
            places.append(at + a)
            last = name[-1:]
        name, at = np.concatenate(names), np.concatenate(places)
        doc = np.searchsorted(self.ends, at, "right") - 1
        count = np.minimum(np.append(at[1:], starts), self.ends[doc + 1] - length + 1) - at
        return _mix(name + _M[0]), at, count, doc

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.ends, at, "right") - 1]


def _pack(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def names_of(block: Block, use: np.ndarray, buckets: int) -> dict[int, tuple[bytes, bytes]]:
    """For each bucket the block's names (32 bits, ascending) and whether several of its documents have them."""
    name, _, _, doc = block.runs(use)
    bucket = (name % np.uint64(buckets)).astype(np.int64)
    key = bucket << 32 | (name >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((block.ids[doc], key))
    key, ids = key[order], block.ids[doc[order]]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    tail = np.concatenate([head[1:], [len(key)]]) - 1
    own, several = key[head], (ids[head] != ids[tail]) if len(key) else np.zeros(0, bool)
    # a row for each bucket that the block has names of: never more rows than names
    return {b: (_pack(own[s:e] & 0xFFFFFFFF, "<u4"), np.packbits(several[s:e]).tobytes()) for b, s, e in runs_of_equal(own >> 32)}


def repeated(parts: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The names that several documents have, from all blocks' names of a bucket."""
    names = [np.frombuffer(n, "<u4") for n, _ in parts]
    flags = [np.unpackbits(np.frombuffer(f, np.uint8))[: len(n)].astype(bool) for n, (_, f) in zip(names, parts, strict=True)]
    every = np.sort(np.concatenate(names))
    again = every[1:][every[1:] == every[:-1]]
    return np.unique(np.concatenate([again, *(n[f] for n, f in zip(names, flags, strict=True))]))


def runs_of(block: Block, use: np.ndarray, answers: dict[int, np.ndarray], buckets: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]], list[tuple[int, int]]]:
    """The runs of repeated names for each bucket (documents, places, lengths, names, texts), and the matches inside the block.

    Of equal runs those of the block's least document are sent; for the others the
    match is known already.
    """
    name, at, count, _ = block.runs(use)
    bucket, short = (name % np.uint64(buckets)).astype(np.int64), (name >> np.uint64(32)).astype(np.int64)
    key = bucket << 32 | short
    wanted = np.sort(np.concatenate([np.zeros(0, np.int64), *(b << 32 | a.astype(np.int64) for b, a in answers.items())]))
    if not len(wanted) or not len(key):
        return [], []
    place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
    chosen = np.flatnonzero(wanted[place] == key)
    raw = block.raw.data
    bucket, short, docs, starts = bucket[chosen], short[chosen], block.doc_of(at[chosen]), at[chosen]
    ends = starts + count[chosen] + block.length - 1
    # equal texts have one name, and so one bucket
    seen: dict[bytes, int] = {}
    again = np.array([seen.setdefault(bytes(raw[s:e]), d) < d for s, e, d in zip(starts.tolist(), ends.tolist(), docs.tolist(), strict=True)], bool)  # documents ascend
    del seen
    inside = list(zip(starts[again].tolist(), ends[again].tolist(), strict=True))
    sent = np.flatnonzero(~again)
    sent = sent[np.argsort(bucket[sent], kind="stable")]
    out = []
    for b, s, e in runs_of_equal(bucket[sent]):
        own = sent[s:e]
        text = b"".join([raw[x:y] for x, y in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
        out.append((b, docs[own], starts[own], ends[own] - starts[own], short[own], text))
    return out, inside


def _ranked(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    keys = keys[order]
    out = np.zeros(len(keys), np.int32)
    out[order[1:]] = np.cumsum(keys[1:] != keys[:-1], dtype=np.int32)
    return out


def suffix_ranks(raw: np.ndarray, depth: int) -> np.ndarray:
    """Ranks by their first `depth` bytes (8 or more) of all suffixes that have as many, by doubling."""
    rank = _ranked(np.ndarray((len(raw) - 7,), ">u8", raw.data, 0, (1,)).astype(np.uint64))
    have = 8
    while have < depth:
        step = min(have, depth - have)
        keys = rank[: len(rank) - step].astype(np.int64)
        keys <<= 32
        keys |= rank[step:]
        rank = _ranked(keys)
        have += step
    return rank


def common_prefixes(raw: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The common prefix of each suffix with the one before it in `order`, up to `most` bytes; 0 for the first."""
    padded = np.concatenate([raw, np.zeros(most + 8, np.uint8)])
    words = np.ndarray((len(raw) + most,), "<u8", padded.data, 0, (1,))
    out = np.zeros(len(order), np.int32)
    for start in range(1, len(order), PIECE_BYTES):
        same = np.arange(start, min(len(order), start + PIECE_BYTES))
        for at in range(0, most, 8):
            differ = words[order[same] + at] ^ words[order[same - 1] + at]
            # the least byte that differs, in bytes from the first
            low = differ & (~differ + np.uint64(1))
            out[same] += np.where(differ == 0, 8, np.searchsorted(_BYTE_ENDS, low, "right")).astype(np.int32)
            same = same[differ == 0]
    return np.minimum(out, most, out=out)


#: The first bit of each byte but the first.
_BYTE_ENDS = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)


def previous_smaller(doc: np.ndarray, prefix: np.ndarray, least: int) -> np.ndarray:
    """For each place in suffix order the longest common prefix with the nearest place before it that has a smaller document; 0 if there is none, or it is below `least`.

    All places jump together over places of larger or equal documents, a place's jump
    being the one that the place it looks at has made: as in parallel all-nearest-smaller values.
    """
    n = len(doc)
    look, most = np.arange(-1, n - 1, dtype=np.int32), prefix.copy()
    most[:1] = 0
    open_ = np.flatnonzero(most >= least).astype(np.int32)
    while open_.size:
        at = look[open_]
        open_ = open_[(at >= 0) & (doc[np.maximum(at, 0)] >= doc[open_])]
        at = look[open_]
        further = np.minimum(most[open_], most[at])
        look[open_], most[open_] = look[at], further
        open_ = open_[further >= least]
    found = (most >= least) & (look >= 0)
    found[found] = doc[look[found]] < doc[found]
    return np.where(found, most, np.int32(0))


def longest_previous_factors(raw: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For suffixes at the places `at`: the longest prefix, up to `length`, that also starts in a smaller document; shorter ones are 0."""
    # the suffix array; suffixes that agree to the full depth stand in the order of their places
    order = np.argsort(suffix_ranks(raw, length)[at], kind="stable").astype(np.int32)
    prefix, own = common_prefixes(raw, at[order], length), doc[order]
    most = previous_smaller(own, prefix, length)
    after = previous_smaller(own[::-1], np.concatenate([prefix[:1] * 0, prefix[:0:-1]]), length)[::-1]
    np.maximum(most, after, out=most)
    out = np.zeros(len(at), np.int32)
    out[order] = most
    return out


def matches(docs: np.ndarray, lengths: np.ndarray, raw: np.ndarray, length: int) -> np.ndarray:
    """Marks, for windows at every byte of the joined runs, those whose longest previous factor is of `length`."""
    ends = np.cumsum(lengths)
    mark = np.zeros(len(raw) + 1, np.int32)
    np.add.at(mark, ends - lengths, 1)
    np.add.at(mark, ends - length + 1, -1)
    at = np.flatnonzero(np.cumsum(mark, out=mark)[: len(raw)] > 0).astype(np.int32)
    del mark
    out = np.zeros(len(raw), bool)
    if len(at):
        # places, ranks and numbers of documents fit 32 bits: a bucket's texts are one Arrow array
        number = np.unique(docs, return_inverse=True)[1].astype(np.int32)
        doc = np.repeat(number, np.maximum(0, lengths - length + 1))
        out[at] = longest_previous_factors(raw, at, doc, length) >= length
    return out


def pieces_of(names: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Places of runs, in pieces of PIECE_BYTES of text or of one name: runs of different names have no window in common."""
    order = np.argsort(names, kind="stable")
    ends = np.cumsum(sizes[order])
    out, start, begun = [], 0, 0
    for _, s, e in runs_of_equal(names[order]):
        if s > start and ends[e - 1] - begun > PIECE_BYTES:
            out.append(order[start:s])
            start, begun = s, int(ends[s - 1])
    return [*out, order[start:]] if start < len(order) else out


def spans_of(docs: np.ndarray, at: np.ndarray, lengths: np.ndarray, raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matches of runs that stand at `at` in their blocks: which run, and first and last place in its block."""
    hit = matches(docs, lengths, raw, length)
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    # windows of two runs are never adjacent: each run ends with length - 1 bytes where no window starts
    head, tail = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum(lengths)
    run = np.searchsorted(ends, head, "right")
    shift = (at - (ends - lengths))[run]
    return run, head + shift, tail - 1 + length + shift


def cut_out(block: Block, spans: np.ndarray, copies: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Each document's remaining bytes, number of removed bytes and of removed runs; `copies` of a smaller document go whole."""
    n = block.size
    edge = np.zeros(n + 1, np.int32)
    if len(spans):
        np.add.at(edge, spans[:, 0], 1)
        np.add.at(edge, spans[:, 1], -1)
    whole = copies & (np.diff(block.ends) >= block.length)
    np.add.at(edge, block.ends[:-1][whole], 1)
    np.add.at(edge, block.ends[1:][whole], -1)
    gone = np.cumsum(edge, out=edge)[:n] > 0
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    heads = block.ends[:-1]
    inner = heads[heads < n]
    first[inner] = gone[inner]
    # the array of edges has room for the sums before each byte
    edge[0] = 0
    np.cumsum(gone, out=edge[1:])
    total = edge[block.ends].astype(np.int64)
    runs = np.searchsorted(np.flatnonzero(first), block.ends)
    left = block.raw[:n][~gone].tobytes()
    kept = block.ends - total
    return [left[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)], np.diff(total), np.diff(runs)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """`doc_id`, the columns `carry`, `n_bytes`, `n_removed`, `n_spans` and `kept` (binary) for each row.

    With `as_text`, `kept` is a string, from which a character that a cut runs through goes whole.

    Texts are taken as UTF-8 bytes, null as empty; matches never cross documents and
    are judged on the input. Rows of one id are one document's: they do not match one
    another. A row of a null id is not compared and keeps its bytes. An empty table
    gives an empty result. Columns of `carry` that have the name of an output are
    replaced. A worker holds a block or a bucket, and what is computed of PIECE_BYTES of it.
    """
    outputs = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    carry = [c for c in (carry or []) if c not in outputs]
    size = plan_bytes(docs, text_col)
    blocks, buckets = max(1, math.ceil(size / BLOCK_BYTES)), max(1, math.ceil(size / BUCKET_BYTES))
    number = F.col(quoted(id_col)).cast("long")
    raw = F.coalesce(F.col(quoted(text_col)).cast("string").cast("binary"), F.lit(b""))
    block = F.pmod(F.xxhash64(number), F.lit(blocks)).cast("int")
    base = docs.select(number.alias("doc_id"), raw.alias("raw"), block.alias("block"), *(F.col(quoted(c)).alias(f"__{k}") for k, c in enumerate(carry)))
    # of exact copies only the first takes part; by digests, a row a block that has one, however many documents share it
    digests = docs.select(number.alias("doc_id"), F.unhex(F.sha2(raw, 256)).alias("digest"), block.alias("block")).where(F.col("doc_id").isNotNull())
    own = digests.groupBy("digest", "block").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    first = own.groupBy("digest").agg(F.min(F.get("ids", F.lit(0))).alias("first"), F.sum(F.size("ids")).alias("n")).where(F.col("n") > 1)
    copies = own.join(first, "digest").select("block", "digest", F.explode(F.filter("ids", lambda x: x != F.col("first"))).alias("doc_id"))
    copies = copies.groupBy("block").agg(F.collect_list(F.struct("doc_id", "digest")).alias("copies")).select("block", F.lit(None).cast("binary").alias("body"), F.lit(-1).alias("bucket"), F.col("copies.doc_id").alias("copy_ids"), F.col("copies.digest").alias("copy_digests"))

    def opened(left: pa.Table, right: pa.Table) -> tuple[Block, np.ndarray, np.ndarray]:
        """The block, which of its documents are copies, and which take part."""
        import hashlib

        release()  # what the worker's last group has left
        ids, texts = left.column("doc_id").to_pylist(), [x or b"" for x in left.column("raw").to_pylist()]
        block = Block([-(1 << 63) if d is None else d for d in ids], texts, length)
        again: set = set()
        for owners, found in zip(right.column("copy_ids").to_pylist(), right.column("copy_digests").to_pylist(), strict=True):
            again |= set(zip(owners or [], found or [], strict=True))
        owners = {d for d, _ in again}
        copied = np.array([ids[k] in owners and (ids[k], hashlib.sha256(texts[k]).digest()) in again for k in block.order], bool)
        return block, copied, ~copied & (block.ids > -(1 << 63))

    def send_names(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "names": pa.array([], pa.binary()), "several": pa.array([], pa.binary())})
        block, _, use = opened(left, right)
        found = names_of(block, use, buckets)
        here = left.column("block")[0].as_py()
        return pa.table({"bucket": pa.array(list(found), pa.int32()), "block": pa.array([here] * len(found), pa.int32()), "names": pa.array([n for n, _ in found.values()], pa.binary()), "several": pa.array([s for _, s in found.values()], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        parts = list(zip(table.column("names").to_pylist(), table.column("several").to_pylist(), strict=True))
        again = repeated(parts)
        out = []
        for n, _ in parts:
            names = np.frombuffer(n, "<u4")
            k = np.minimum(np.searchsorted(again, names), max(0, len(again) - 1))
            out.append(names[again[k] == names].tobytes() if len(again) else b"")
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "body": pa.array(out, pa.binary())})

    def send_runs(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"bucket": pa.int32(), "block": pa.int32(), "docs": pa.binary(), "at": pa.binary(), "sizes": pa.binary(), "names": pa.binary(), "body": pa.binary()}
        if not left.num_rows:
            return pa.table({c: pa.array([], k) for c, k in kinds.items()})
        block, _, use = opened(left, right)
        answers = {b: np.frombuffer(x, "<u4") for b, x in zip(right.column("bucket").to_pylist(), right.column("body").to_pylist(), strict=True) if x}
        found, inside = runs_of(block, use, answers, buckets)
        here = left.column("block")[0].as_py()
        rows = [(b, here, _pack(d, "<i8"), _pack(s, "<i8"), _pack(n, "<i8"), _pack(w, "<u4"), x) for b, d, s, n, w, x in found]
        if inside:
            rows.append((-1, here, None, None, None, None, _pack(np.array(inside), "<i8")))
        return pa.table({c: pa.array(list(v), k) for (c, k), v in zip(kinds.items(), zip(*rows, strict=True) if rows else [[]] * len(kinds), strict=True)})

    def find(table: pa.Table) -> pa.Table:
        release()
        cols = {c: table.column(c).to_pylist() for c in ("docs", "at", "sizes", "names", "body")}
        owner = np.repeat(table.column("block").to_numpy(), [len(x) // 8 for x in cols["docs"]])
        doc, at, n = (np.frombuffer(b"".join(cols[c]), "<i8") for c in ("docs", "at", "sizes"))
        name = np.frombuffer(b"".join(cols["names"]), "<u4")
        raw = np.frombuffer(b"".join(cols["body"]), np.uint8)
        del cols
        starts, view, spans = np.cumsum(n) - n, raw.data, []
        for own in pieces_of(name, n):
            # equal runs of several blocks: only the least document's take part, the others are matches as they are
            texts = [bytes(view[s : s + k]) for s, k in zip(starts[own].tolist(), n[own].tolist(), strict=True)]
            least: dict[bytes, int] = {}
            for t, d in zip(texts, doc[own].tolist(), strict=True):
                if least.setdefault(t, d) > d:
                    least[t] = d
            known = np.array([least[t] < d for t, d in zip(texts, doc[own].tolist(), strict=True)], bool)
            part, known = own[~known], own[known]
            chosen = np.frombuffer(b"".join([view[s : s + k] for s, k in zip(starts[part].tolist(), n[part].tolist(), strict=True)]), np.uint8)
            run, first, last = spans_of(doc[part], at[part], n[part], chosen, length)
            spans += [(owner[known], at[known], at[known] + n[known]), (owner[part][run], first, last)]
        to, first, last = (np.concatenate(x) for x in zip(*spans, strict=True))
        order = np.argsort(to, kind="stable")
        both = np.stack([first, last], 1)[order]
        found = runs_of_equal(to[order])
        return pa.table({"block": pa.array([b for b, _, _ in found], pa.int32()), "body": pa.array([_pack(both[s:e], "<i8") for _, s, e in found], pa.binary())})

    schema = T.StructType([*T.StructType.fromDDL("doc_id long").fields, *(docs.schema[c] for c in carry), *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary")).fields])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block, copied, _ = opened(left, right)
        spans = np.frombuffer(b"".join(x or b"" for x in right.column("body").to_pylist()), "<i8").reshape(-1, 2)
        kept, removed, runs = cut_out(block, spans, copied)
        if as_text:
            kept = [x.decode("utf-8", "ignore") for x in kept]
        own = left.take(pa.array(block.order, pa.int64()))
        columns = [own.column("doc_id"), *(own.column(f"__{k}") for k in range(len(carry))), pa.array(np.diff(block.ends), pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary())]
        return pa.table(columns, names=schema.names)

    by_block = base.groupBy("block")
    none = [F.lit(None).cast("array<bigint>").alias("copy_ids"), F.lit(None).cast("array<binary>").alias("copy_digests")]
    names = by_block.cogroup(copies.groupBy("block")).applyInArrow(send_names, "bucket int, block int, names binary, several binary")
    answers = names.groupBy("bucket").applyInArrow(answer, "block int, bucket int, body binary")
    asked = copies.unionByName(answers.select("block", "bucket", "body", *none))
    runs = by_block.cogroup(asked.groupBy("block")).applyInArrow(send_runs, "bucket int, block int, docs binary, at binary, sizes binary, names binary, body binary")
    found = runs.where("bucket >= 0").groupBy("bucket").applyInArrow(find, "block int, body binary")
    inside = runs.where("bucket < 0").select("block", "body")
    spans = found.unionByName(inside).select("block", F.lit(0).alias("bucket"), "body", *none)
    return by_block.cogroup(copies.unionByName(spans).groupBy("block")).applyInArrow(finish, schema)
