"""Session for local work, and the shared folder jobs may write to."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "starcell", cores: int | str = "*", memory: str = "8g",
                  shuffle_partitions: int = 8, folder: str | None = None) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", folder or tempfile.mkdtemp(prefix="starcell-"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Call-site capture costs more than building these plans does.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@lru_cache(maxsize=1)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="starcell-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors share.

    Where it is unset, a session of a single process (master local[n]) gets a folder of
    its own; any other raises, since executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder(spark.conf.get("spark.app.id", "local"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below one folder per application, which can be dropped as a whole afterwards."""
    owner = f"starcell-{spark.conf.get('spark.app.id', 'local')}"
    return os.path.join(shared_folder(spark), owner, f"{name}-{uuid.uuid4().hex}")


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Store a frame in the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads the files instead of recomputing
    values, such as row numbers, that could come out differently.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
