"""Token ids of a corpus in binary files, in ascending order of document ids.

A file holds consecutive documents: a header, the documents' boundaries and ids in
Elias-Fano coding, then all token ids one after the other, in 2 bytes where the
vocabulary allows it. There is no 64-bit offset table: a boundary is a select.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import elias_fano
from .bpe import Kept, Splitter, byte_symbols
from .common import TEXT, drop_path, plan_bytes, quoted, text_slices

#: Token ids in a file: it is closed at the first document end beyond.
FILE_IDS = 8 << 20
#: Words that a worker keeps, in each of two generations.
CACHED_WORDS = 400_000
#: Input bytes for each range of document ids, where they have to be dealt anew.
RANGE_BYTES = 24 << 20
#: Documents whose boundaries are selected at a time on reading.
SELECTED = 4096
_MAGIC = b"LSTOK\x00\x00\x01"
#: magic, bytes an id, documents of null id, documents, token ids, least document id, bytes of the two Elias-Fano parts
_HEAD = struct.Struct("<8sIIQQqQQ")
_RUN = "path string, first long, last long, nulls long, docs long, ids long"


class LibraryEncoder:
    """Encodes by the tokenizers library, each distinct word of the pre-tokeniser once, while it is cached."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.splitter = Splitter(spec)
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.symbols = dict(enumerate(byte_symbols()))
        self.known = Kept(self.encode_words, CACHED_WORDS)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """By the library's model, which is what is left of its pipeline for a normalised, pre-tokenised word."""
        tokenize, symbols, added = self.library.model.tokenize, self.symbols, self.splitter.added
        out = []
        for w in words:
            ids = [added[w]] if w in added else [t.id for t in tokenize(w.encode().decode("latin-1").translate(symbols))]
            out.append(np.array(ids, self.kind).tobytes())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.splitter.fits:
            return [self._whole(x).tobytes() for x in texts]
        split = [self.splitter.words_of(x) for x in texts]
        known = self.known.having(set(chain.from_iterable(split)))
        return [b"".join(map(known.__getitem__, s)) for s in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def pack(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A file's bytes; documents in ascending order of ids, null ids first."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum([0, *(len(x) // width for x in ids)])
    bounds, numbers = elias_fano.encode(ends), elias_fano.encode((known - least).astype(np.uint64))
    return b"".join([_HEAD.pack(_MAGIC, width, nulls, len(ids), int(ends[-1]), least, len(bounds), len(numbers)), bounds, numbers, *ids])


class TokenFile:
    """One file: boundaries by select, ids by range."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(at)
        magic, self.width, self.nulls, self.n_docs, self.n_ids, self.least, b, n = _HEAD.unpack(self.file.read(_HEAD.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no token file")
        self.bounds = elias_fano.EliasFano(self.file.read(b))
        self.numbers = elias_fano.EliasFano(self.file.read(n))
        self.at = _HEAD.size + b + n

    def doc_id(self, k: int) -> int | None:
        return None if k < self.nulls else self.least + self.numbers.select(k - self.nulls)

    def ids(self, start: int, end: int) -> np.ndarray:
        self.file.seek(self.at + start * self.width)
        return np.frombuffer(self.file.read((end - start) * self.width), f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        return self.ids(self.bounds.select(k), self.bounds.select(k + 1))

    def close(self) -> None:
        self.file.close()


def _write_file(folder: str, doc_ids: list, ids: list[bytes], width: int) -> dict:
    """Writes under another name first: a task that is lost or runs twice leaves no half file under a final name."""
    import uuid

    order = sorted(range(len(ids)), key=lambda k: (doc_ids[k] is not None, doc_ids[k] or 0, ids[k]))
    doc_ids, ids = [doc_ids[k] for k in order], [ids[k] for k in order]
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    name = f"{uuid.uuid4().hex}.tokens"
    with fs.open_output_stream(f"{at}/_{name}") as f:
        f.write(pack(doc_ids, ids, width))
    fs.move(f"{at}/_{name}", f"{at}/{name}")
    known = [d for d in doc_ids if d is not None]
    return {"path": f"{folder}/{name}", "first": known[0] if known else None, "last": known[-1] if known else None, "nulls": len(ids) - len(known), "docs": len(ids), "ids": sum(map(len, ids)) // width}


def _runs(folder: str, width: int, rows: Iterator[tuple[object, int | None, bytes]]) -> Iterator[dict]:
    """Writes a file whenever the first part of a row changes or FILE_IDS are there."""
    key, doc_ids, ids, held = None, [], [], 0
    for k, doc_id, x in rows:
        if ids and (k != key or held >= FILE_IDS):
            yield _write_file(folder, doc_ids, ids, width)
            doc_ids, ids, held = [], [], 0
        key = k
        doc_ids.append(doc_id)
        ids.append(x)
        held += len(x) // width
    if ids:
        yield _write_file(folder, doc_ids, ids, width)


def _ordered(runs: list) -> list | None:
    """The files in order, or None if their ranges of ids overlap."""
    runs = sorted(runs, key=lambda r: (r["nulls"] == 0, r["first"] is not None, r["first"] or 0, r["last"] or 0))
    if sum(r["nulls"] > 0 for r in runs) > 1:
        return None
    known = [r for r in runs if r["first"] is not None]
    return None if any(a["last"] >= b["first"] for a, b in zip(known, known[1:], strict=False)) else runs


def write_store(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Encodes every whole text, appends `end_id`, writes the files and returns their list.

    The list has a row for each file: `path`, `ord`, `docs`, `ids` and `start` (ids in
    all files before it). Null and empty texts have the end id alone. Documents of a
    null id come first; those of equal ids are ordered by their token ids. An empty
    table gives an empty list. Other columns are not read.

    If the input's files hold ascending, disjoint ranges of document ids, each task
    writes what it reads; else encoded documents are dealt by ranges of ids first. A
    task holds one file's ids.
    """
    spark = docs.sparkSession
    width = encoder(path).width
    end = np.array([end_id], f"<u{width}").tobytes()
    source = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias(TEXT))

    def encoded(batches) -> Iterator[tuple[list, list[bytes]]]:
        for batch in batches:
            for part in text_slices(batch):
                yield part.column(0).to_pylist(), [x + end for x in encoder(path).encode([x or "" for x in part.column(1).to_pylist()])]

    def listed(runs: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("first", "last", "nulls", "docs", "ids"))])
        if rows := list(runs):
            yield pa.RecordBatch.from_pylist(rows, kind)

    def direct(batches):
        yield from listed(_runs(folder, width, ((0, d, x) for ids, made in encoded(batches) for d, x in zip(ids, made, strict=True))))

    ranges = source.select("doc_id", F.input_file_name().alias("file")).groupBy("file").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    overlap = _overlap(ranges)
    runs = None
    if not overlap:
        runs = _ordered(source.mapInArrow(direct, _RUN).collect())
        if runs is None:
            drop_path(spark, folder)
    if runs is None:
        parts = max(1, math.ceil(plan_bytes(source, TEXT) / RANGE_BYTES))
        cuts = source.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
        cuts = np.unique(np.array(cuts, np.int64))

        def dealt(batches):
            for ids, made in encoded(batches):
                part = [0 if d is None else int(k) for d, k in zip(ids, np.searchsorted(cuts, [d or 0 for d in ids], "right"), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(ids, pa.int64()), pa.array(made, pa.binary())], ["part", "doc_id", "ids"])

        def ranged(batches):
            yield from listed(_runs(folder, width, ((p, d, x) for b in batches for p, d, x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))))

        rows = source.mapInArrow(dealt, "part int, doc_id long, ids binary").repartition(len(cuts) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
        runs = sorted(rows.mapInArrow(ranged, _RUN).collect(), key=lambda r: (r["nulls"] == 0, r["first"] is not None, r["first"] or 0, r["last"] or 0))
    start, out = 0, []
    for k, r in enumerate(runs):
        out.append((r["path"], k, r["docs"], r["ids"], start))
        start += r["ids"]
    return spark.createDataFrame(out, "path string, ord long, docs long, ids long, start long")


def _overlap(ranges: DataFrame) -> bool:
    """Whether the ranges of ids of the input's files overlap; true for rows that are in no file."""
    from pyspark.sql import Window

    w = Window.orderBy("first", "last")
    last = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    bad = (F.col("file") == "") | (F.col("nulls") > 0) | (F.col("first") <= last)
    return bool(ranges.select(bad.alias("bad")).agg(F.max("bad")).first()[0])


def read_store(files: DataFrame, slice_ids: int = 1 << 20) -> DataFrame:
    """A row for each document: `doc_id`, `start` (ids of all documents before it), `n_tokens`, `ids` (little-endian unsigned 32-bit).

    Boundaries and document ids come from the select structures, SELECTED at a time.
    """

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file = TokenFile(path)
                for first in range(0, file.n_docs, SELECTED):
                    last = min(file.n_docs, first + SELECTED)
                    bounds, known = file.bounds.selects(first, last + 1), max(0, first - file.nulls)
                    numbers = [None] * max(0, min(last, file.nulls) - first) + (file.numbers.selects(known, max(known, last - file.nulls)) + file.least).tolist()
                    k = 0
                    while k < last - first:
                        to = max(k + 1, int(np.searchsorted(bounds, bounds[k] + slice_ids, "right")) - 1)
                        raw = file.ids(int(bounds[k]), int(bounds[to])).astype("<u4").tobytes()
                        own = (bounds[k : to + 1] - bounds[k]).tolist()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(numbers[k:to], pa.int64()), pa.array(base + bounds[k:to], pa.int64()), pa.array(np.diff(bounds[k : to + 1]), pa.int64()), pa.array([raw[4 * s : 4 * e] for s, e in zip(own, own[1:], strict=False)], pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        k = to
                file.close()

    n = files.count()
    return files.select("path", "start").repartition(max(1, n)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
