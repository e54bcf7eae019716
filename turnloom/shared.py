"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names no such folder and runs in one process (tests), one is made in the local temporary
    folder; a cluster without one is an error, since executors couldn't read each other's files. ``clear`` removes the folders.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _FALLBACK:
            _FALLBACK[app] = tempfile.mkdtemp(prefix="turnloom-shared-")
        base = _FALLBACK[app]
    path = f"{base.rstrip('/')}/turnloom-{name}-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(app, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Remove all folders that this session's operators made, and return their number. Results that are read from them
    lazily can't be read after that, so write or collect those before."""
    jvm, made = spark.sparkContext._jvm, _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(made)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
