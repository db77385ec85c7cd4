"""Session settings, and what Python workers need to import this package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Let this session's Python workers import the package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, as tests and the benchmark use it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("specframe")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    importable(spark)
    return spark


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder for files: in the folder of spark.checkpoint.dir, which machines share; a temporary one on a single machine without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        root = tempfile.gettempdir()
    path = os.path.join(re.sub(r"^file:/*", "/", root), f"specframe-{what}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path
