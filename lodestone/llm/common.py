"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a worker takes up at a time.
SLICE_BYTES = 4 << 20
#: Bytes of rows in a batch that Spark sends to a worker, about.
BATCH_BYTES = 4 << 20

TEXT = "__text"
#: For bytes.translate: A-Z to a-z, everything else as it is.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = "file://" + os.path.join(tempfile.gettempdir(), "lodestone-checkpoints")
        spark.conf.set("spark.checkpoint.dir", given)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def plan_bytes(df: DataFrame, text_col: str) -> int:
    """About a DataFrame's size on disk: Catalyst's estimate from file sizes (no job), or half its texts' bytes where it has none."""
    guess = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if guess < 1 << 50:
        return guess
    return (df.agg(F.sum(F.octet_length(F.col(quoted(text_col)).cast("string")))).first()[0] or 0) // 2


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on for tasks of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bounded_batches(df: DataFrame) -> DataFrame:
    """Has rows sent to Python workers in batches of BATCH_BYTES, unless the session says otherwise."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("b")) > BATCH_BYTES and df.sparkSession.sparkContext.getConf().get(key) is None:
        conf.set(key, str(BATCH_BYTES))
    return df


def text_slices(batch: pa.RecordBatch, column: str | int = TEXT, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where its texts pass `most` bytes; a single longer text is a slice by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], most: int, column: str | int = TEXT) -> Iterator[pa.RecordBatch]:
    """Slices of texts of about `most` bytes, over the ends of batches."""
    held, size = [], 0
    for batch in batches:
        for part in text_slices(batch, column, most):
            n = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + n > most:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.concat_batches(held)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list[Iterable]]],
    out: str,
    text_col: str = "text",
    carry: list[str] | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Runs over every text in Arrow batches, without a shuffle.

    `make` gives, once a task, a function from a list of texts (null: empty) to one
    list for each column of the DDL schema `out`; its attribute `close` is called in the end. The columns `carry` pass through;
    one that has the name of an output is replaced by the output.
    """
    fields = T.StructType.fromDDL(out)
    carry = [c for c in (carry or []) if c not in fields.names]
    # a carried text is sent once
    at = carry.index(text_col) if text_col in carry and isinstance(df.schema[text_col].dataType, T.StringType) else len(carry)
    kept = T.StructType([df.schema[c] for c in carry])
    schema = T.StructType([*kept.fields, *fields.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(fields)]
    names = [*carry, *fields.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in gathered(batches, slice_bytes, at):
            texts = [x or "" for x in part.column(at).to_pylist()]
            made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(work(texts), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(carry))), *made], names)
        getattr(work, "close", release)()

    sent = [F.col(quoted(c)) for c in carry]
    if at == len(carry):
        sent.append(F.col(quoted(text_col)).cast("string").alias(TEXT))
    source = bounded_batches(df).select(*sent)
    return source.mapInArrow(run, schema)


def runs_of_equal(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """Each key of an ascending array with where its run starts and ends."""
    found, start = np.unique(keys, return_index=True)
    return list(zip(found.tolist(), start.tolist(), np.append(start[1:], len(keys)).tolist()[: len(start)], strict=True))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod5(id_col: str):
    """crc32 of the id as text, modulo 5: the fold that decides what is held out."""
    return F.crc32(F.encode(F.col(quoted(id_col)).cast("string"), "utf-8")) % 5


#: Unicode's White_Space; str.split() takes \x1c-\x1f besides.
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def chunks_of(text: str) -> list[str]:
    """The runs of characters other than Unicode's White_Space."""
    if _SEPARATORS.search(text):
        return [x for x in _SPACES.split(text) if x]
    return text.split()
