"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import gc
import os
import threading
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

#: Rows per Arrow batch that Python operators ask for where rows can be long.
TEXT_BATCH = 1000
#: Seconds after which the JVM knows what Python has given back.
TOLD_S = 1.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    return os.path.join(ensure_checkpoint_dir(spark), "cabmart", f"{name}-{uuid.uuid4().hex}")


class Cuts:
    """The lineage cuts of one piece of work; whoever made this object deletes them once no frame reads them."""

    def __init__(self):
        self.paths: list[str] = []

    def delete(self, spark: SparkSession) -> None:
        while self.paths:
            _delete(spark, self.paths.pop())


#: Cuts of single queries: their frames may be read as long as the application runs, which deletes them at its end.
_unowned = Cuts()
_working = threading.local()


@contextmanager
def owned(cuts: Cuts):
    """Lineage cuts made inside (by this thread) belong to ``cuts``."""
    before = getattr(_working, "cuts", None)
    _working.cuts = cuts
    try:
        yield cuts
    finally:
        _working.cuts = before


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _delete_unowned() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        _unowned.delete(spark)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back (a lineage cut)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (getattr(_working, "cuts", None) or _unowned).paths.append(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of lineage cuts that no frame reads any more, and the shuffle files of finished jobs."""
    spark = tables[0].sparkSession
    root = scratch_path(spark, "").rpartition("/")[0]
    for table in tables:
        for folder in {os.path.dirname(f) for f in table.inputFiles()}:
            if f"/{os.path.basename(root)}/" not in folder:
                raise ValueError(f"not a lineage cut: {folder}")
            _delete(spark, folder)
    release(spark)


def release(spark: SparkSession, last: bool = False) -> None:
    """Let Spark remove the shuffle files of finished jobs now.

    It does so once nothing refers to their plans any more, which the driver's
    JVM notices only when it collects its garbage; after a lineage cut that is
    worth doing, as the jobs before it may have shuffled far more than they left.
    Python tells the JVM only once a second what it no longer refers to, so the plan of
    the job that has just ended stays.  With ``last``, that one goes as well.
    """
    gc.collect()
    if last:
        time.sleep(TOLD_S)
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores put in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def labelled_fold(id_col, modulus: int, held: int):
    """True for the rows that a query holds out: crc32(id as text) mod ``modulus`` is ``held``."""
    return (F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)) == F.lit(held)
