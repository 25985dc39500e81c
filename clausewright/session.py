"""Session settings shared by tests, the benchmark and the command line."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the plans are written for; its workers can import this package."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints that the cluster names. Only a local session that names none gets a temporary
    one, which is removed at its end; on a cluster that is an error."""
    context = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir().isDefined():
        return named or context.getCheckpointDir().get()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)
    return named


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once, unless they can import it from their path or folder anyway."""
    root, app = Path(__file__).resolve().parent.parent, spark.sparkContext.applicationId
    reachable = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd(), *(p for p in sys.path if p.endswith("-packages"))]
    if app in _shipped or any(p and Path(p).resolve() == root for p in reachable):
        return
    folder = tempfile.mkdtemp(prefix="shipped-")  # Spark serves the file from here to its workers as long as the driver lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/clausewright", "zip", root, "clausewright"))
    _shipped.add(app)
