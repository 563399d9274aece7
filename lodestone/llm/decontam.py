"""Benchmark decontamination by an Aho-Corasick automaton over normalised questions and answers.

The automaton's letters are words and its patterns an item's windows of ten consecutive
words. A text is normalised and scanned once; hits are places of words, which map to
offsets of the original text. The benchmark's items are files in the shared folder, written
by executors: a benchmark of more than `SHARD_BYTES` of text is several automata, which a
worker builds one after the other for each large slice of texts, in the same pass over them.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import lru_cache
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SLICE_BYTES, map_texts, quoted, work_dir

#: Words of a window.
WINDOW = 10
#: UTF-8 bytes of benchmark texts in an automaton, about; and of the texts that it scans at a time where there are several.
SHARD_BYTES, SEVERAL_SLICE = 1 << 20, 64 << 20
#: Bytes to lower-case word bytes or spaces: words are runs of 0-9, a-z and all that is not ASCII.
NORMAL = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in LOWER)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(NORMAL).split()


class Benchmark:
    """An automaton over items: pairs of a name and a text."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        #: numbers of the items' words, from 1 on; every other word is 0
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            own = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            n = min(window, len(own))
            for k in range(len(own) - n + 1 if n else 0):
                found.setdefault(own[k : k + n], set()).add(item)
        self.built = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, own in found.items():
            self.built.add_word(key, (len(key), own))
        self.any = bool(found)
        if self.any:
            self.built.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Indexes of the hit words, and the items with occurring windows."""
        if not words or not self.any:
            return np.zeros(0, np.int64), set()
        line = tuple(map(self.number.get, words, _ZEROS))
        edge, items = None, set()
        for last, (n, own) in self.built.iter(line):
            if edge is None:
                edge = np.zeros(len(words) + 1, np.int64)
            edge[last + 1 - n] += 1
            edge[last + 1] -= 1
            items |= own
        return (np.zeros(0, np.int64) if edge is None else np.flatnonzero(np.cumsum(edge)[:-1])), items


_ZEROS = repeat(0)


@lru_cache(maxsize=1)
def _benchmark(path: str, window: int) -> Benchmark:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        return Benchmark([tuple(x) for x in json.loads(f.read())], window)


def char_spans(text: str, hit_words: list[int]) -> list[tuple[int, int]]:
    """Runs of hit words as character offsets of the original text."""
    raw = text.encode("utf-8", "replace")
    inside = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    hit = np.array(hit_words)
    cut = np.flatnonzero(np.diff(hit) > 1)
    first, last = hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])]
    return list(zip(chars[starts[first]].tolist(), chars[ends[last]].tolist(), strict=True))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    carry: list[str] | None = None,
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    nameless: bool = False,
) -> DataFrame:
    """Adds `n_words`, `hit_words` (indexes from 0) and `items` (sorted strings) to each document.

    A document's word is hit inside any occurrence of `window` consecutive words of
    an item; an item of fewer words, but not none, is one window. Null and empty
    texts have no words; an item of null id is left out, or with `nameless` hits words
    and is a null, the last one, among the items; repeated item rows count once; with an
    empty benchmark nothing is hit. Rows are neither dropped nor merged. No shuffle of
    documents. Columns of `carry` that have the name of an output are replaced. A worker
    holds one automaton; the driver has a row for each.
    """
    folder = work_dir(docs.sparkSession, "benchmark")
    items = benchmark.select(F.col(quoted(item_id)).cast("string").alias("item"), F.col(quoted(item_text)).cast("string").alias("words"))
    items = items.dropna(subset=["words"] if nameless else None)
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))

    def write(table: pa.Table) -> pa.Table:
        rows = sorted(set(zip(table.column("item").to_pylist(), table.column("words").to_pylist(), strict=True)), key=lambda r: (r[0] is None, r[0] or "", r[1]))
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{at}/{name}") as f:
            f.write(json.dumps(rows).encode())
        return pa.table({"path": [f"{folder}/{name}"]})

    # a row for each SHARD_BYTES of benchmark text; equal rows share a shard
    dealt = items.groupBy(F.pmod(F.xxhash64("item", "words"), F.lit(shards)).alias("shard")).applyInArrow(write, "path string")
    paths = sorted(r["path"] for r in dealt.collect())

    def make():
        def work(texts: list[str]):
            words = [words_of(x) for x in texts]
            hits, names = [[] for _ in texts], [set() for _ in texts]
            for path in paths:
                own = _benchmark(path, window)
                for k, w in enumerate(words):
                    hit, items = own.scan(w)
                    if items:
                        hits[k].append(hit)
                        names[k] |= items
            places = [np.unique(np.concatenate(h)) if h else [] for h in hits]
            return [list(map(len, words)), places, [sorted(n, key=lambda x: (x is None, x or "")) for n in names]]

        return work

    return map_texts(docs, make, "n_words bigint, hit_words array<int>, items array<string>", text_col, carry, SLICE_BYTES if len(paths) < 2 else SEVERAL_SLICE)


def with_spans(df: DataFrame, text_col: str = "text", hits_col: str = "hit_words", carry: list[str] | None = None) -> DataFrame:
    """Adds `spans`: the runs of hit words as character offsets [start, end) of the original text."""
    from pyspark.sql import types as T

    carry = [c for c in (carry or []) if c != "spans"]
    schema = T.StructType([*(df.schema[c] for c in carry), *T.StructType.fromDDL("spans array<struct<start:int,end:int>>").fields])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            pairs = zip(b.column(len(carry)).to_pylist(), b.column(len(carry) + 1).to_pylist(), strict=True)
            spans = [[{"start": s, "end": e} for s, e in char_spans(x or "", h)] if h else [] for x, h in pairs]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(carry))), pa.array(spans, kind)], [*carry, "spans"])

    return df.select(*map(quoted, carry), quoted(text_col), quoted(hits_col)).mapInArrow(run, schema)
