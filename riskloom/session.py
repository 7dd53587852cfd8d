"""Session helpers: configuration for local runs and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("riskloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one job's files.

    It lies under the folder the cluster shares (``spark.checkpoint.dir``). Only where
    that is unset, as in tests on one machine, a temporary folder is used.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _local_folder()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="riskloom-")


def use_checkpoints(spark: SparkSession) -> None:
    """Point iterative jobs at the shared folder unless a checkpoint folder is already set."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(work_folder(spark, "checkpoints"))


# Methods above this many bytes of bytecode are never compiled by the JVM, so a wide
# projection fused into one method runs interpreted. Below the limit Spark falls back to
# one generated projection per operator, which is compiled.
JIT_METHOD_BYTES = 8000


def tune(spark: SparkSession) -> SparkSession:
    """Session settings for wide loan rows; results do not depend on them."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_METHOD_BYTES))
    return spark
