"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


#: Settings of the session while a table is written, put back as they were after it: its job's shuffle files are of no
#: use once it is written, and batches handed to Python stay small where rows hold whole texts.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a temporary folder is made if all runs in this process; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tripforge-checkpoint-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder, for the length of a ``with`` block.

    Writing a table and reading it back cuts lineage, so a lost executor costs its tasks only. Tables are deleted when the
    block is left, also by an error; those made by ``keep`` go to the block around it, or stay until the application ends.

    Small results between tables can be held on the executors' disks instead (``hold``), until the block is left: what a
    lost executor held is computed again from the tables before it. What a block hands on must be a table.
    """

    def __init__(self, spark: SparkSession, outer: Scratch | None = None):
        self.spark, self.outer, self.paths, self.kept, self.held = spark, outer, [], [], []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind, *_) -> None:
        for df in self.held:
            df.unpersist()
        for path in self.paths + (self.kept if kind else []):
            self._fs(path).delete(self._path(path), True)
        if self.outer is not None and not kind:
            self.outer.paths += self.kept

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def place(self, name: str) -> str:
        """A path of its own for files that stay until the application ends."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self._fs(path).deleteOnExit(self._path(path))
        return path

    def _table(self, df: DataFrame, name: str, paths: list[str]) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        paths.append(path)
        self._fs(path).deleteOnExit(self._path(path))
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in WHILE_WRITING}
        for k, v in WHILE_WRITING.items():
            conf.set(k, v)
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """A table of this block."""
        return self._table(df, name, self.paths)

    def hold(self, df: DataFrame) -> DataFrame:
        """Rows that are computed once and held on the executors' disks; not for each step of a loop, whose plan would grow."""
        self.held.append(df.persist(StorageLevel.DISK_ONLY))
        return self.held[-1]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """A table that outlives this block."""
        return self._table(df, name, self.kept)
