"""Spark session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import SparkSession


def build_session(cpus: int | str = 8, shuffle_partitions: int = 8, **conf) -> SparkSession:
    """Local session for tests and the bench; ``conf`` takes ``spark.checkpoint.dir`` too. A cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("paywarden")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@lru_cache(maxsize=1)
def local_scratch() -> str:
    """A folder of a local session, removed when Python ends."""
    folder = tempfile.mkdtemp(prefix="paywarden-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


#: Folders that this process has asked for; ``drop_scratch`` removes them.
SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for written intermediate tables.

    On a cluster it lies under ``spark.checkpoint.dir``, which every executor
    can reach. Only a local session without that setting gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that every executor can reach.")
        shared = local_scratch()
    SCRATCH.append(f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return SCRATCH[-1]


@contextmanager
def many_folders(spark: SparkSession, most: int = 64):
    """Writes by folder keep up to ``most`` files of a task open instead of sorting its rows by folder first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables of this process. Frames that read them cannot be computed any more."""
    conf = spark._jsc.hadoopConfiguration()
    while SCRATCH:
        target = spark._jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        target.getFileSystem(conf).delete(target, True)
