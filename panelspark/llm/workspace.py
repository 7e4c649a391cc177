"""Tables written in the folder that every executor shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ARROW_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES = 8 << 20  # what a Python task gets at once; a session that asks for less keeps its own


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a folder of our own serves a local master only (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="panelspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Workspace:
    """A fresh subfolder of the shared folder. save() cuts lineage: an executor that is lost costs a reread only."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/ws-{uuid.uuid4().hex}"
        self._n = 0
        size = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", spark.conf.get(ARROW_CONF).strip().lower())
        if not size or not 0 < int(size[1]) << 10 * " kmgt".index(size[2] or " ") <= ARROW_BYTES:
            spark.conf.set(ARROW_CONF, str(ARROW_BYTES))

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table. The shuffle files of the write go when it ends, not when the driver happens to collect its garbage."""
        path, before = self.folder(name), self.spark.conf.get(CLEANUP_CONF)
        self.spark.conf.set(CLEANUP_CONF, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP_CONF, before)
        return self.spark.read.schema(df.schema).parquet(path)
