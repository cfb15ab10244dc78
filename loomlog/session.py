"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# SQL settings that decide results, not speed.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # a repeated JSON key keeps its last value instead of spoiling the line
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# HotSpot never compiles a method of more than 8000 bytes. A parse fused into one such method
# is interpreted; as separate projections it runs twice as fast.
SPEED_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that results and speed depend on to a session somebody else built."""
    for key, value in {**RESULT_SETTINGS, **SPEED_SETTINGS}.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, memory: str = "8g", name: str = "loomlog") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset there must be one machine only, as in a test; a cluster's executors
    could not read each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = os.path.join(tempfile.gettempdir(), f"loomlog-{os.getpid()}")
    return os.path.join(root.rstrip("/"), f"loomlog-{os.urandom(8).hex()}")
