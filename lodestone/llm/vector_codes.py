"""Vector code compression: product codebooks by Lloyd's rounds with Hamerly's bounds, in integers.

Vectors become integers and are cut into parts; every part position has a codebook of its
own. A part keeps one upper bound of the distance to its entry and one lower bound of the
distance to any other entry. When entries move, the bounds move with them. Only a part
whose upper bound is not strictly below its lower bound, nor below half the distance from
its entry to the nearest other one, is compared with all entries in whole numbers, where
the lower index wins a tie. So no assignment depends on rounding.

A round is one pass over a table in the shared folder: a row for each block of vectors,
with the integers, codes and bounds, and the block's sums. Only sums of entries and
codebooks, whose size the parameters fix, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, quoted, work_dir

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bytes of integers in a block.
BLOCK_BYTES = 1 << 20
#: A label of more than one row in so many is hot; there are fewer hot labels than this.
HOT = 10_000
#: Bounds are rounded outwards by this share: far above what a sum and a root of doubles lose.
SLACK = 1e-12

_BLOCK = "ids array<bigint>, labels array<string>, vectors binary, codes binary, upper binary, lower binary, sums binary"
_CODES = "id bigint, label string, code string, error bigint"


def usable(vector: str) -> Column:
    """Whether a vector has components, and all are finite numbers."""
    v = F.col(quoted(vector))
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def most(dims: int) -> int:
    """The largest component for which the error of a vector of `dims` components fits a signed 64-bit integer."""
    return 1 << (62 - max(dims - 1, 1).bit_length()) // 2 - 1


def whole(values: np.ndarray, dims: int) -> np.ndarray:
    """floor(SCALE * x); beyond what `most` says, that."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -most(dims), most(dims)).astype(np.int64)


def cuts(dims: int, parts: int) -> list[tuple[int, int]]:
    """Where consecutive parts begin and end; they are equal if `parts` divides `dims`."""
    at = [k * dims // parts for k in range(parts + 1)]
    return list(zip(at, at[1:], strict=False))


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, exact."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for d in range(points.shape[1]):
        out += (points[:, d, None] - entries[None, :, d]) ** 2
    return out


def assign(points: np.ndarray, books: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray | None) -> int:
    """One part position: puts `code`, `upper` and `lower` right for the entries `books`, in place.

    `moved` holds how far each entry has moved since they were right; None: they hold nothing yet.
    Gives the number of parts compared with all entries.
    """
    if moved is None:
        todo = np.arange(len(points))
    else:
        upper += moved[code]
        upper *= 1 + SLACK
        order = np.argsort(-moved, kind="stable")
        # the farthest that an entry other than the part's own has moved
        far = np.where(code == order[0], moved[order[1]], moved[order[0]]) if len(moved) > 1 else 0.0
        lower -= far
        lower -= SLACK * (np.abs(lower) + far)
        between = np.sqrt(squares(books, books).astype(np.float64))
        np.fill_diagonal(between, np.inf)
        reach = np.maximum(lower, (between.min(1) / 2 * (1 - SLACK))[code])
        todo = np.flatnonzero(~(upper < reach))
        if todo.size:
            # the bound becomes the distance itself, then is held against the others once more
            own = np.zeros(todo.size, np.int64)
            for d in range(points.shape[1]):
                own += (points[todo, d] - books[code[todo], d]) ** 2
            upper[todo] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
            todo = todo[~(upper[todo] < reach[todo])]
    for a in range(0, len(todo), 8192):
        at = todo[a : a + 8192]
        far = squares(points[at], books)
        code[at] = far.argmin(1)
        rows = np.arange(len(at))
        upper[at] = np.sqrt(far[rows, code[at]].astype(np.float64)) * (1 + SLACK)
        far[rows, code[at]] = np.iinfo(np.int64).max
        lower[at] = np.sqrt(far.min(1).astype(np.float64)) * (1 - SLACK) if len(books) > 1 else np.inf
    return len(todo)


def gathered(points: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """For each entry the sums of its parts' components and, last, their number. Exact: a block's sums are far below 2**53."""
    # halves of a component each sum exactly in doubles, however large it is
    high, low = points >> 20, points & (1 << 20) - 1
    out = np.zeros((entries, points.shape[1] + 1), np.int64)
    for d in range(points.shape[1]):
        for half, shift in ((high, 20), (low, 0)):
            out[:, d] += np.bincount(code, half[:, d], entries).astype(np.int64) << shift
    out[:, -1] = np.bincount(code, minlength=entries)
    return out


class Books:
    """The codebooks of all part positions after a round, and how far each entry moved in it."""

    def __init__(self, entries: np.ndarray, parts: int, before: Books | None = None):
        self.entries, self.cuts, self.moved = entries, cuts(entries.shape[1], parts), None
        if before is not None:
            self.moved = [np.sqrt(((entries[:, a:b] - before.entries[:, a:b]) ** 2).sum(1).astype(np.float64)) * (1 + SLACK) for a, b in self.cuts]

    def digest(self) -> str:
        numbers = (str(x) for a, b in self.cuts for entry in self.entries[:, a:b].tolist() for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def _blocks(df: DataFrame, dims: int) -> DataFrame:
    """Vectors as rows of blocks, without codes and bounds."""
    size, kind = max(1, BLOCK_BYTES // (8 * dims)), T.StructType.fromDDL(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                vectors = whole(part.column(2).flatten().to_numpy(zero_copy_only=False), dims)
                yield _block(part.column(0), part.column(1), vectors, b"", b"", b"", b"")

    return df.mapInArrow(run, kind)


def _block(ids: pa.Array, labels: pa.Array, vectors: np.ndarray, *others: bytes) -> pa.RecordBatch:
    """A block's row. The integers are as narrow as they can be; the first byte is their size."""
    reach = int(np.abs(vectors).max(initial=0))
    narrow = vectors.astype(np.int16 if reach < 1 << 15 else np.int32)
    held = bytes([narrow.itemsize]) + narrow.tobytes()
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, labels)]
    return pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.binary()) for x in (held, *others))], ["ids", "labels", "vectors", "codes", "upper", "lower", "sums"])


def _vectors(held: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(held, np.dtype(f"i{held[0]}"), offset=1).reshape(-1, dims).astype(np.int64)


def _state(row: dict, n: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shape = (parts, n)
    if not row["codes"]:
        return np.zeros(shape, np.uint8), np.zeros(shape), np.zeros(shape)
    return tuple(np.frombuffer(row[k], t).reshape(shape).copy() for k, t in (("codes", np.uint8), ("upper", np.float64), ("lower", np.float64)))


def _round(blocks: DataFrame, books: Books, parts: int) -> DataFrame:
    """Blocks with codes and bounds for the books, and the sums that the next ones need."""
    dims, entries = books.entries.shape[1], len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("vectors", "codes", "upper", "lower")}
                vectors = _vectors(row["vectors"], dims)
                code, upper, lower = _state(row, len(vectors), parts)
                sums, scanned = [], 0
                for p, (a, b) in enumerate(books.cuts):
                    points = vectors[:, a:b]
                    scanned += assign(points, books.entries[:, a:b], code[p], upper[p], lower[p], books.moved and books.moved[p])
                    sums.append(gathered(points, code[p], entries).ravel())
                sums.append([scanned])
                yield _block(batch.column("ids")[k].values, batch.column("labels")[k].values, vectors, code.tobytes(), upper.tobytes(), lower.tobytes(), np.concatenate(sums).tobytes())

    return blocks.mapInArrow(run, T.StructType.fromDDL(_BLOCK))


def _total(blocks: DataFrame) -> list[int]:
    """The blocks' sums added up: partial sums a task, then as whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                own = np.frombuffer(x.as_py(), np.int64)
                total = own.astype(object) if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(x) for x in total], pa.string())], ["at", "sum"])

    made = blocks.select("sums").mapInArrow(run, "at int, sum string").groupBy("at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    return [int(r["sum"]) for r in sorted(made.collect(), key=lambda r: r["at"])]


def _next(books: Books, total: list[int], parts: int) -> Books:
    """Entries become the floors of their parts' means; an entry without parts stays."""
    entries, at = books.entries.copy(), 0
    for a, b in books.cuts:
        for e in range(len(entries)):
            *sums, n = total[at : at + b - a + 1]
            at += b - a + 1
            if n:
                entries[e, a:b] = [x // n for x in sums]
    return Books(entries, parts, books)


def _coded(blocks: DataFrame, books: Books, parts: int) -> DataFrame:
    """A row for each vector: its code, and its squared distances summed over parts."""
    dims = books.entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                vectors = _vectors(batch.column("vectors")[k].as_py(), dims)
                code = np.frombuffer(batch.column("codes")[k].as_py(), np.uint8).reshape(parts, -1)
                error = np.zeros(len(vectors), np.int64)
                for p, (a, b) in enumerate(books.cuts):
                    for d in range(a, b):
                        error += (vectors[:, d] - books.entries[code[p], d]) ** 2
                text = np.ascontiguousarray(code.T).tobytes().hex()
                codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("labels")[k].values, pa.array(codes, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return blocks.select("ids", "labels", "vectors", "codes").mapInArrow(run, T.StructType.fromDDL(_CODES))


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scanned: list[int] | None = None) -> DataFrame:
    """Codes of vectors: `id_col`, `code`, `error`, `label_error`, `codebooks_sha256`.

    Components become floor(4096 * x). The codebook of a part position starts as that part
    of the `entries` smallest ids' vectors. Each round assigns every part to its nearest
    entry, the lower index of a tie, and replaces each used entry by the floors of its
    parts' means; in the end parts are assigned once more. `code`: the indexes in part
    order, two hex digits each; `error`: squared distances summed over parts;
    `label_error`: errors summed over rows of equal labels, null labels together;
    `codebooks_sha256`: of all final components by part, entry and place, comma-joined.
    `scanned`, if given, gets for each round how many parts were compared with all entries.

    Vectors that are null, empty, hold null or non-finite components, or have another
    number of components than the vector of the smallest id are dropped. Null ids are
    the largest; rows of equal ids start in the order of their vectors, and all are kept. With
    fewer vectors than `entries` there are as many entries. Parts differ by one component
    where `parts` doesn't divide a vector. Components beyond 2**27 for 64 of them (`most`)
    count as that, so that errors fit; a label's sum that doesn't fit is null. An empty
    table gives no rows. Other columns are left out, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: from 1 to 256 entries")
    spark, kind = df.sparkSession, df.schema[id_col].dataType
    held = df.where(usable(vector_col)).select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(label_col)).cast("string").alias("label"), F.col(quoted(vector_col)).cast("array<double>").alias("v"))
    first = [r.v for r in held.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()]
    out = T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL("code string, error bigint, label_error bigint, codebooks_sha256 string").fields])
    if not first:
        return spark.createDataFrame([], out)
    dims = len(first[0])
    held = held.where(F.size("v") == dims)
    start = [r.v for r in held.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    books = Books(whole(np.array(start), dims), parts)
    blocks, before = _blocks(held, dims), None
    for k in range(rounds + 1):
        path = work_dir(spark, f"codes-{k}")
        _round(blocks, books, parts).write.parquet(path)
        blocks = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
        if k < rounds or scanned is not None:
            *total, full = _total(blocks)
            if scanned is not None:
                scanned.append(full)
            if k < rounds:
                books = _next(books, total, parts)
    path = work_dir(spark, "codes")
    _coded(blocks, books, parts).write.parquet(path)
    drop_path(spark, before)
    coded = spark.read.parquet(path)
    rows = with_label_totals(coded)
    return rows.select(F.col("id").cast(kind).alias(id_col), "code", "error", F.col("label_error"), F.lit(books.digest()).alias("codebooks_sha256"))


def with_label_totals(coded: DataFrame) -> DataFrame:
    """Adds `label_error`. Sums of hot labels, fewer than HOT, are sent to all tasks; the rows of others are dealt by label."""
    totals = coded.groupBy("label").agg(F.try_sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n"))
    path = work_dir(coded.sparkSession, "label-sums")
    totals.select("label", F.expr("try_cast(sum AS bigint)").alias("label_error"), "n").write.parquet(path)
    totals = coded.sparkSession.read.parquet(path)
    rows = totals.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(totals.where(F.col("n") * HOT > rows).select(F.col("label").alias("l"), "label_error"))
    cold = totals.where(F.col("n") * HOT <= rows).select(F.col("label").alias("l"), "label_error")
    same = F.col("label").eqNullSafe(F.col("l"))
    rest = coded.join(hot.select("l"), same, "left_anti")
    return coded.join(hot, same).unionByName(rest.join(cold, same)).drop("l")
