"""The streaming forms, run to completion over files."""

from pyspark.sql import functions as F

from lodestone.streaming import streams


def run(spark, df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return spark.sql(f"select * from {name}")


def test_debounce(spark, tmp_path):
    rows = [("a", 0, "1"), ("a", 1, "2"), ("a", 10, "3"), ("a", 100, "4")]
    df = spark.createDataFrame(rows, "file string, s int, content string").select("file", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts"), "content")
    df.coalesce(1).write.parquet(str(tmp_path / "edits"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "edits"))
    found = run(spark, streams.debounced(stream), "append", tmp_path, "debounced")
    assert {(r.content, r.edits) for r in found.collect()} >= {("2", 2), ("3", 1)}


def test_last_values(spark, tmp_path):
    df = spark.range(40).select((F.col("id") % 2).cast("string").alias("key"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), F.col("id").alias("seq"), F.col("id").cast("double").alias("value"))
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))
    found = run(spark, streams.last_values(stream, 5, 3), "update", tmp_path, "last_values").collect()
    assert {(r.key, r.back, r.seq) for r in found} == {(str(k), b, 40 - 2 * b + k) for k in (0, 1) for b in (1, 2, 3)}


def test_level_windows(spark, tmp_path):
    df = spark.createDataFrame([(0, "ERROR a"), (1, "INFO b"), (1000, "INFO c")], "s int, line string").select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts"), "line")
    df.coalesce(1).write.parquet(str(tmp_path / "lines"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "lines"))
    found = run(spark, streams.level_windows(stream), "append", tmp_path, "levels").collect()
    assert {(r.level, r.lines) for r in found} >= {("error", 1), ("info", 1)}


def test_live_metrics_of_edits(spark, tmp_path):
    spark.createDataFrame([("a.py", "def f(): pass")], "file string, content string").write.json(f"{tmp_path}/in")
    edits = spark.readStream.schema("file string, content string").json(f"{tmp_path}/in")
    seen = []
    query = streams.live_metrics(edits, lambda rows, k: seen.extend(rows.collect())).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.path, r.functions) for r in seen] == [("a.py", 1)]


def test_every(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    seen = []
    query = streams.every(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), 1, lambda df, k: seen.append(df.count())).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert seen == [3]


def test_live_metrics_take_the_last_edit_by_time(spark, tmp_path):
    """Edits in any order of files and partitions."""
    rows = [("a.py", 2, 1, "def f(): pass\ndef g(): pass"), ("a.py", 2, 0, "def f(): pass"), ("a.py", 1, 9, ""), ("b.py", 5, 0, "x = 1"), ("b.py", 4, 0, "def h(): pass")]
    spark.createDataFrame(rows, "file string, ts long, seq long, content string").repartition(3).write.json(f"{tmp_path}/in")
    edits = spark.readStream.schema("file string, ts long, seq long, content string").json(f"{tmp_path}/in")
    seen = []
    streams.live_metrics(edits, lambda rows, k: seen.extend(rows.collect())).trigger(availableNow=True).start().awaitTermination(60)
    assert {(r.path, r.functions) for r in seen} == {("a.py", 2), ("b.py", 0)}


def test_ring_of_batch_and_stream(spark, tmp_path):
    """After the last event the stream's ring is the batch's last frame."""
    from lodestone.operators import logs

    df = spark.range(37).select((F.col("id") % 3).cast("string").alias("key"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), F.col("id").alias("seq"), F.col("id").cast("double").alias("value"))
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))
    found = run(spark, streams.last_values(stream, 50, 10), "update", tmp_path, "rings").collect()
    frames = logs.histories(df.withColumnRenamed("key", "url").withColumnRenamed("value", "ms"))
    last = frames.groupBy("url").agg(F.max_by("ring", "seq").alias("ring")).collect()
    assert {(r.key, r.back, r.seq) for r in found} == {(r.url, b, x.seq) for r in last for b, x in enumerate(r.ring[::-1], 1)}


def test_two_pauses_over_a_restart(spark, tmp_path):
    """Edits of two files that interleave, out of order, over a restart: the rows of the batch form, each once."""
    first = [("a", 0, 0, "1"), ("a", 299, 1, "2"), ("b", 100, 2, "x"), ("a", 2299, 4, "4"), ("a", 599, 3, "3"), ("a", 599, 3, "3"), (None, 5, 9, "n"), ("b", None, 9, "n")]
    second = [("b", 1900, 7, None), ("a", 4200, 8, "6"), ("a", 2299, 5, "5"), ("b", 1900, None, "z"), ("end", 60_000, 0, "")]
    schema = "file string, ms long, seq long, content string"
    timed = lambda rows: spark.createDataFrame(rows, schema).select("file", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("ms")).alias("ts"), "seq", "content")
    found = []
    for part in (first, second):
        timed(part).repartition(3).write.mode("append").parquet(f"{tmp_path}/edits")
        stream = streams.paused(spark.readStream.schema(timed(part).schema).parquet(f"{tmp_path}/edits"))
        q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/check").foreachBatch(lambda df, k: found.extend(df.collect())).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    plain = streams.paused_batch(timed(first + second)).where("file <> 'end'").collect()
    key = lambda r: (r.file, r.wait, r["at"] - 1_700_000_000_000, r.seq, r.content)
    assert sorted(map(key, found)) == sorted(map(key, plain))
    assert sorted(map(key, plain)) == [("a", 300, 299, 1, "2"), ("a", 300, 599, 3, "3"), ("a", 300, 2299, 5, "5"), ("a", 300, 4200, 8, "6"), ("a", 2000, 4200, 8, "6"), ("b", 300, 100, 2, "x"), ("b", 300, 1900, 7, ""), ("b", 2000, 1900, 7, "")]
