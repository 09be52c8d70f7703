"""The folder that all machines share, tables cut from their lineage there, and derived tables that are built once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_BUILT: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Where checkpoints go, as spark.checkpoint.dir says. Only on a local master, as in tests, one is set here."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def built(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of that key, which is built and written once for each application, and only read afterwards."""
    own = (spark.sparkContext.applicationId, *key)
    if own not in _BUILT:
        path = f"{shared_folder(spark)}/built-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _BUILT[own] = path
    return spark.read.parquet(_BUILT[own])
