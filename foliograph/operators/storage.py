"""Tables that an operator writes between its steps, and tables put below each other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets one of its own; a
    cluster fails, for no folder of one machine would do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="foliograph-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its rows and their places are fixed, and a lost executor costs running tasks only."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def below(first: DataFrame, *others: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of all tables, columns by name, missing ones null.

    Spark takes a union of sides that are partitioned alike by ``keys`` for partitioned itself, and leaves out the shuffle for a window or
    an aggregate above it; where adaptive execution packs the sides' partitions differently, rows of one key then don't meet. Keys that
    are computed carry no such promise, so the others' keys are.
    """
    out = first
    for other in others:
        out = out.unionByName(other.withColumns({k: F.element_at(F.array(k), 1) for k in keys}), allowMissingColumns=True)
    return out
