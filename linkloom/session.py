"""Session helpers: worker import path, shared scratch space, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that go to a Python worker at once; long texts would make larger batches.
BATCH_BYTES = 4 << 20
#: Python workers outlive their tasks; these make them return freed arrays to the system.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}
ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers of this machine import the package, and bound their memory.

    On a cluster the package is installed on the executors or shipped with
    ``--py-files``; this only helps local masters started from another folder.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is set and there's no other machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="linkloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


class Workspace:
    """Named intermediate tables in the shared folder.

    ``cut`` writes a frame once and returns a reader over the files, so later
    stages neither recompute it nor depend on blocks that one executor holds.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = prepare(spark)
        self.base = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        self._count = 0
        self._paths: dict[int, str] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.base}/{self._count:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files behind frames that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            if path := self._paths.pop(id(df), None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
