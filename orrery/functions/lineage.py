"""Cutting lineage and attaching small tables without assuming their size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table is broadcast; its rows are a few hundred bytes at most.
BROADCAST_ROWS = 50_000
#: Spark's setting that shuffle files go when the query that made them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; where it is unset, a local session makes one, a cluster has to name it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="orrery-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation of its past."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lookup(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left", rows: int | None = None) -> DataFrame:
    """Join ``df``, whose keys may be hot, with a table that is unique on ``keys``.

    The table is counted (pass ``rows`` if the count is known). Up to ``BROADCAST_ROWS`` rows it is broadcast; beyond that
    a sort-merge join follows, whose hot partitions adaptive execution splits.
    """
    n = table.count() if rows is None else rows
    return df.join(F.broadcast(table) if n <= BROADCAST_ROWS else table, keys, how)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet beside the checkpoints, in the folder that the cluster shares, and read again; ``options`` are the writer's.

    Spark deletes the shuffle files of the write at its end, as nothing reads them again (``_CLEANUP``).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete the files of a table that ``written`` made, once all that reads it is written itself."""
    spark = table.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
