"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the query contracts: words are runs of characters outside space and U+0009 to U+000D.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Rows whose crc32(doc_id as text) leaves this remainder modulo 4 are never learned from.
HELD_OUT_REMAINDER = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows kept for evaluation. A null id hashes as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT_REMAINDER


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where lambdas inside ``body`` refer to it."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets one of its own;
    a cluster fails, for no folder of one machine would do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jvm_dir.get() if jvm_dir.isDefined() else None
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="foliograph-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether Spark, packing small shuffled results, would rather keep all cores busy than reach the advised size of a partition.
SPREAD = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again.

    A lost executor then costs only the tasks it was running; files written by finished tasks stay. Shuffled results are
    packed to the advised size of a partition, so that a small table is one file and not one for each core.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(SPREAD, None)
    spark.conf.set(SPREAD, "false")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SPREAD) if before is None else spark.conf.set(SPREAD, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_HELD: list = []


def claim(name: str, drop: Callable[[], None] | None = None) -> None:
    """Say that this worker process now runs ``name``. What another operator cached in the process, which Spark reuses, goes first."""
    if _HELD and _HELD[0] == name:
        return
    if _HELD:
        import ctypes
        import gc

        import pyarrow as pa

        if _HELD[1] is not None:
            _HELD[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    _HELD[:] = name, drop


def blocks(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``most`` characters; a longer text stands alone."""
    start = size = 0
    for k, t in enumerate(texts):
        own = len(t or "")
        if k > start and size + own > most:
            yield start, k
            start, size = k, 0
        size += own
    if len(texts) > start:
        yield start, len(texts)


#: Rows of an Arrow batch that are worked on at once.
PART_ROWS = 1024


def parts(batches: Iterator, rows: int = PART_ROWS) -> Iterator:
    """Arrow batches in parts of a few rows, so that texts and results of a whole batch are never held beside it."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def carried(documents: DataFrame, keep: list[str] | None, added: list[str]) -> tuple[list[str], DataFrame, int]:
    """Names of the columns that go through an operator (``keep``, or all; those of the same name as a result give way), the rows with
    them and the text, and the text's place. A text that goes through is sent once."""
    names = [c for c in (keep if keep is not None else documents.columns) if c not in added]
    if "text" in names:
        return names, documents.select(*names), names.index("text")
    return names, documents.select(*names, F.col("text").alias("_text")), len(names)


#: Spark's setting for the rows of an Arrow batch, its default, and what operators on texts set instead: 10,000 long texts are too much to hold.
BATCH_ROWS, DEFAULT_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2048"


def importable(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, with this package's folder on the Python path of workers that start from now on, and with Arrow batches of
    TEXT_ROWS rows where the session has Spark's default."""
    import functools
    import os
    from pathlib import Path

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
        paths = env.get("PYTHONPATH", "").split(os.pathsep)
        if root not in paths + os.environ.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
        if spark.conf.get(BATCH_ROWS, DEFAULT_ROWS) == DEFAULT_ROWS:
            spark.conf.set(BATCH_ROWS, TEXT_ROWS)
        return query(spark, *args)

    return run
