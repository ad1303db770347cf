"""Session helpers and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SPREAD_ROWS = 100_000
TASK_ROWS = 500_000  # of a spread table, where it has more than two tasks a core


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("twinlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")  # no stack capture per expression
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables.

    Only a local master may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="twinlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize_all(frames: list[DataFrame | Callable[[], DataFrame]], threads: int = 4) -> DataFrame:
    """Write frames of one schema side by side and read them back as one table.

    Small results of many metrics: separate jobs keep every plan small and let the
    scheduler overlap them, where one union would be planned as a single huge query.
    A frame that takes jobs to build is given as a function, so that those overlap too.
    """
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    root = f"{shared_folder(spark).rstrip('/')}/twinlens-{uuid.uuid4().hex}"
    paths = [f"{root}/{i}" for i in range(len(frames))]

    def write(frame: DataFrame | Callable[[], DataFrame], path: str) -> T.StructType:
        frame = frame if isinstance(frame, DataFrame) else frame()
        frame.write.parquet(path)
        return frame.schema

    with ThreadPoolExecutor(threads) as pool:
        schemas = list(pool.map(write, frames, paths))
    return spark.read.schema(schemas[0]).parquet(*paths)


def spread(df: DataFrame, n_rows: int) -> DataFrame:
    """Rows dealt evenly over all cores, before a pass that works long on each row.

    A small file is read as few splits, however many rows it holds. Below ``SPREAD_ROWS`` rows nothing is moved.
    """
    if n_rows < SPREAD_ROWS:
        return df
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, n_rows // TASK_ROWS))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where a derived table is scanned several times: the written copy survives
    lost executors, keeps column pruning and gives the optimizer real sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/twinlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
