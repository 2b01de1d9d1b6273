"""Session helpers: a local session for tests and lineage cutting that survives executor loss."""

from __future__ import annotations

import os
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "opinara") -> SparkSession:
    """A session for tests and the local benchmark. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only for a local master without any."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = configured or sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        current = tempfile.mkdtemp(prefix="opinara-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that later stages never recompute it.

    Used where a plan must not be evaluated twice with different outcomes (partition numbers of a
    range sort) and where an iteration would otherwise grow its lineage.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_by_value(module: str) -> None:
    """Send the functions of a module along with the tasks that use them.

    Executors then need NumPy and Arrow but not this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])
