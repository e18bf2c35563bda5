"""Session settings and lineage cutting shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Folders of local sessions; Python removes them when it ends.
_LOCAL_DIRS: dict[str, tempfile.TemporaryDirectory] = {}


def build_session(app: str = "wovengraph", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates, as the cluster names it.

    Only a local session without the setting gets a temporary folder: on a
    cluster such a folder would be lost with its machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.TemporaryDirectory(prefix="wovengraph-", ignore_cleanup_errors=True)
    return _LOCAL_DIRS[app].name


def new_folder(spark: SparkSession) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/wovengraph/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from the written table.

    Cuts lineage for loops; a lost executor costs one re-read, and the planner
    sees the real size of the table.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
