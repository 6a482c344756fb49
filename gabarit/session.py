"""Session helpers: a local session for tests and bench, tables written to cut lineage, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS, BROADCAST_CHARACTERS = 200_000, 20_000_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine, with what the operators rely on: UTC and AQE."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gabarit")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GABARIT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where that is unset and all runs on one machine (tests). Raises on a cluster without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir names no shared folder: what executors write on their own machines cannot be read again")
    own = os.path.join(tempfile.gettempdir(), f"gabarit-{os.getpid()}")
    if not os.path.isdir(own):
        os.makedirs(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet below work_dir and read it back: lineage ends at files that survive lost executors. release() deletes them."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete all that materialize() wrote in this process, once no result that reads it is needed any more; how many tables it was."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def small(df: DataFrame, limit: int = BROADCAST_ROWS, characters: int = BROADCAST_CHARACTERS) -> DataFrame:
    """df marked for broadcast if it has at most limit rows with so many characters of text (an element of an array counts as 16), else as it is (a shuffle join follows). df should be a written table: it is counted."""
    texts = [F.coalesce(F.length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() == "string"]
    texts += [16 * F.greatest(F.size(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString().startswith("array")]
    size = sum(texts, F.lit(0)).cast("long")
    n, c = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and c <= characters else df
