"""Tables between the steps of iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Steps:
    """Writes each step's table to the shared folder and reads it back: a lost executor costs one step, and plans stay short."""

    def __init__(self, spark: SparkSession, name: str):
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            given = "file://" + os.path.join(tempfile.gettempdir(), "lodestone-checkpoints")
        self.spark, self.path, self.n = spark, f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Removes all tables: call it when what is read from them is no longer needed."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
