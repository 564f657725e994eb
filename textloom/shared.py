"""Tables and files in the folder that driver and executors share: spark.checkpoint.dir.

Where the setting is absent, on a local master alone, a temporary folder serves. What was written
there below a local path goes when the process ends."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="textloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    root = f"{shared_dir(spark)}/textloom-{uuid.uuid4().hex}"
    local = root.removeprefix("file://")
    if local.startswith("/"):
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return f"{root}/{name}"


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder: evaluated once, and no executor's loss undoes it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """A path, or URI of any store that Arrow opens, as its file system and the path there."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)
