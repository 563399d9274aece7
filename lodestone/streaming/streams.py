"""Debounced edits, rings of the last values of a key, log levels over windows, live metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators import parse
from ..operators.logs import level_of


def debounced(edits: DataFrame, idle: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Of edits (`file`, `ts`, `content`) the last one before each pause of `idle`."""
    w = F.session_window("ts", idle)
    last = edits.withWatermark("ts", late).groupBy("file", w).agg(F.max_by("content", "ts").alias("content"), F.count("*").alias("edits"))
    return last.select("file", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "content", "edits")


# Milliseconds of rest after which an editor asks for the light and for the full analysis.
LIGHT, FULL = 300, 2000


class Pauses(StatefulProcessor):
    """Holds a file's edits until it is known which rests of `waits` milliseconds follow them; a timer for each edit and wait.

    A timer fires when the watermark has passed it, so all edits before it are there, in
    whatever order they came. Edits go with their longest timer: state is what a file's edits
    of the longest wait and the watermark's delay take.
    """

    def __init__(self, waits: tuple[int, ...]):
        self.waits = sorted(waits)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.edits = handle, handle.getListState("edits", "at long, seq long, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = [(int(a), int(s), c) for part in rows for a, s, c in part[["at", "seq", "content"]].itertuples(index=False, name=None)]
        self.edits.appendList(new)
        for at in {a + w for a, _, _ in new for w in self.waits}:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted({tuple(r) for r in self.edits.get()})
        out = [(key[0], w, *e) for e, later in zip(held, [*held[1:], None], strict=True) for w in self.waits if e[0] + w == now and (later is None or later[0] - e[0] >= w)]
        kept = [e for e in held if e[0] + self.waits[-1] > now]
        if not kept:
            self.edits.clear()
        elif len(kept) < len(held):
            self.edits.put(kept)
        if out:
            yield pd.DataFrame(out, columns=["file", "wait", "at", "seq", "content"])

    def close(self) -> None:
        pass


def _timed(edits: DataFrame) -> DataFrame:
    rows = edits.where("file is not null and ts is not null")
    return rows.select("file", "ts", F.unix_millis("ts").alias("at"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("content", F.lit("")).alias("content"))


def paused(edits: DataFrame, waits: tuple[int, ...] = (LIGHT, FULL), late: str = "10 seconds") -> DataFrame:
    """Edits (`file`, `ts`, `seq`, `content`) after which a file rests for each of `waits` milliseconds: `wait`, `at` (milliseconds), `seq`, `content`.

    An edit just at the end of a wait comes after it. Equal edits are one; a null seq is 0, a null content empty, rows of a
    null file or time are left out. Needs the RocksDB state store; a query goes on from its checkpoint, timers included.
    """
    rows = _timed(edits.withWatermark("ts", late))
    return rows.groupBy("file").transformWithStateInPandas(Pauses(waits), "file string, wait int, at long, seq long, content string", "Append", "EventTime")


def paused_batch(edits: DataFrame, waits: tuple[int, ...] = (LIGHT, FULL)) -> DataFrame:
    """The rows of `paused` for edits that are all there, with an end without end."""
    following = F.lead("at").over(Window.partitionBy("file").orderBy("at", "seq", "content"))
    rows = _timed(edits).drop("ts").distinct().withColumn("following", following)
    each = rows.withColumn("wait", F.explode(F.array(*[F.lit(w) for w in sorted(waits)])))
    return each.where("following is null or following - at >= wait").select("file", "wait", "at", "seq", "content")


def level_windows(lines: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Log lines (`ts`, `line`) counted by level and window."""
    rows = lines.withWatermark("ts", late).withColumn("level", level_of(F.col("line")))
    return rows.groupBy(F.window("ts", width), "level").agg(F.count("*").alias("lines")).select(F.col("window.start").alias("start"), "level", "lines")


class LastN(StatefulProcessor):
    """Keeps the `kept` newest rows of a key and gives out the `shown` newest after each batch."""

    def __init__(self, kept: int, shown: int):
        self.kept, self.shown = kept, shown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "ts timestamp, seq long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = [tuple(r) for r in self.rows.get()]
        for part in rows:
            held += list(part[["ts", "seq", "value"]].itertuples(index=False, name=None))
        held = sorted(held, key=lambda r: (r[0], r[1]))[-self.kept :]
        self.rows.put([(t.to_pydatetime() if hasattr(t, "to_pydatetime") else t, int(s), float(v)) for t, s, v in held])
        shown = held[-self.shown :][::-1]
        yield pd.DataFrame({"key": [key[0]] * len(shown), "back": range(1, len(shown) + 1), "ts": [r[0] for r in shown], "seq": [r[1] for r in shown], "value": [r[2] for r in shown]})

    def close(self) -> None:
        pass


def last_values(events: DataFrame, kept: int = 50, shown: int = 10) -> DataFrame:
    """Events (`key`, `ts`, `seq`, `value`) to the newest of each key; needs the RocksDB state store."""
    return events.groupBy("key").transformWithStateInPandas(LastN(kept, shown), "key string, back int, ts timestamp, seq long, value double", "Update", "None")


def live_metrics(edits: DataFrame, act: Callable[[DataFrame, int], None], seconds: float = 0.2) -> DataStreamWriter:
    """The editor's figures of every edit (`file`, `content`): in each small batch the last content of a file, parsed; `act` gets the rows.

    The last edit is that of the greatest `ts`, then `seq`, as far as edits have these; without both it is any of the batch's.
    """
    times = [c for c in ("ts", "seq") if c in edits.columns] or ["content"]

    def work(batch: DataFrame, k: int) -> None:
        last = batch.withColumn("n", F.struct(*times)).groupBy("file").agg(F.max_by("content", "n").alias("content"))
        files = last.select(F.lit("live").alias("project_id"), F.xxhash64("file").alias("file_ord"), F.col("file").alias("path"), "content").persist()
        try:
            act(parse.live_metrics(files, parse.parse_files(files, ["light_functions", "light_classes", "light_imports"])), k)
        finally:
            files.unpersist()

    return edits.writeStream.trigger(processingTime=f"{seconds} seconds").foreachBatch(work)


def every(df: DataFrame, seconds: int, act: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Runs `act` on each batch of a stream, every so many seconds: periodic runs and fan-out."""
    return df.writeStream.trigger(processingTime=f"{seconds} seconds").foreachBatch(act)
