"""Session settings and the shared folder that jobs cut their lineage into."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("factloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a new local one in a local
    session (tests). A cluster must name one: its machines do not share their disks."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(told)
        return told
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="factloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there: later jobs neither
    recompute it nor lose it with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
