"""Sessions with the settings that results rely on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "quillon", **conf: str) -> SparkSession:
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"} | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut, kept in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one only where it names none and all runs in one process."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quillon-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path
