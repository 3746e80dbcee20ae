"""Lineage cuts: write a frame once into the cluster's shared checkpoint folder.

Used where a result must not be recomputed differently (numbered keys) or is
read several times (a batch that is checked and then joined).  The folder is
the one the session names in ``spark.checkpoint.dir`` (only a local session
without one gets a scratch folder of its own).  A parquet write is one job;
files written by finished tasks survive a lost executor.
"""

from __future__ import annotations

import os
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_scopes: list[list[str]] = []
_lock = threading.Lock()


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, "cabmart", f"{name}-{uuid.uuid4().hex}")
    with _lock:
        for made in _scopes:
            made.append(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete at its end every lineage cut made inside.

    For work whose results are written elsewhere: no frame that reads a cut may
    be used after the scope.
    """
    made: list[str] = []
    with _lock:
        _scopes.append(made)
    try:
        yield
    finally:
        with _lock:
            _scopes.remove(made)
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in made:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
