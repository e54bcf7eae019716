"""Session helpers. The engine never assumes that it created the session it is given."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(app: str = "turnloom", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors unless PYTHONPATH already has it (what --py-files does)."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_turnloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="turnloom-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder, "turnloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(Path(ROOT, "turnloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._turnloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df, *keys: str):
    """``df`` dealt over all cores by ``keys``: a small file of many rows is one task otherwise, however dear a row is."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)
