"""How Spark is used: joins by measured sizes, and cutting lineage in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
#: What a join may broadcast, once its side is computed and its size is known.
BROADCAST = "1m"


def join_by_size(spark: SparkSession) -> None:
    """From now on joins of this session broadcast no side whose size is only estimated. Estimates come from the sizes of
    compressed files, and know nothing of texts made from keys: a million documents were sent through the driver as
    less than 10 MB. Adaptive execution still broadcasts what it has found to be small. Broadcast hints hold as before."""
    for name, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.autoBroadcastJoinThreshold", BROADCAST)):
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set, a temporary folder of this
    process in local mode; a cluster without a shared folder is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or getattr(sc, "_docloom_settled", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="docloom-settled-")
        atexit.register(shutil.rmtree, named, True)
        sc._docloom_settled = named
    return named


def settle(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder: cuts the lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/docloom-settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for functions that run in Python there."""
    sc = spark.sparkContext
    if getattr(sc, "_docloom_core_shipped", False) is True:
        return
    folder = tempfile.mkdtemp(prefix="docloom-")  # the driver's file server reads it
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "docloom_core.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(PACKAGE):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    sc.addPyFile(path)
    sc._docloom_core_shipped = True
