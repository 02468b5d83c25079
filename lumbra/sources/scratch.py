"""A folder that the driver and all executors share, for files that jobs write and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without it gets one temporary folder, removed at its end, a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lumbra-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def written(frame: DataFrame, name: str) -> DataFrame:
    """A table written once to the shared folder and read from there: for what is used more than once, or must survive lost executors."""
    path = f"{shared_dir(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
