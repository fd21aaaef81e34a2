"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is unset and all runs in this process (tests) a folder of this machine is made.
    """
    path = spark.conf.get(CONF, None) or spark.sparkContext.getConf().get(CONF)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {CONF} to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="eospark-")
        spark.conf.set(CONF, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/eospark/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def mark() -> int:
    """A point in time for ``clear``."""
    return len(_MADE)


def clear(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Delete the intermediate tables that this driver has made since ``mark()``, but for the last few, and say how many.

    To be called once the results that are wanted have been written, as those results are still lazy before.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths, gone = _MADE[since : len(_MADE) - but], 0
    del _MADE[since : len(_MADE) - but]
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: later reads neither recompute ``df`` nor depend on the executors that made it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
