"""Session defaults and the shared folder in which intermediate tables are written."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
STAGE_ROW_GROUP = 8 << 20  # small row groups, so that a reader can split a staged file over many tasks
FULL_SPLIT = 128 << 20
BUCKET_INPUT = 32 << 20  # bytes of input for each bucket of a table staged by a key
MOST_BUCKETS = 4096
PART_INPUT = 4 << 20  # bytes of the largest table for each part of what is derived from it
UNKNOWN_SIZE = 1 << 50  # Spark expects more of rows of which it knows nothing
_local_fallback: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(app: str = "relish", cpus: int | str = "*", shuffle_partitions: int = 8,
                  memory: str | None = None) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory or os.environ.get("RELISH_DRIVER_MEMORY", "8g"))
    )
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session started elsewhere, where they could not import it.

    Nothing is sent if the package is installed, on PYTHONPATH, or in the
    working folder.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in [*found, os.getcwd()] or "site-packages" in root or not hasattr(spark, "_jsparkSession"):
        return
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/relish", "zip", root, "relish"))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A temporary folder is used only in local mode, where driver and executors
    are the same machine.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_fallback:
        _local_fallback[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_fallback[app]


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative operators in a way that survives the loss of
    executors, and gives the reader real table sizes to plan joins with.
    """
    path = f"{shared_dir(df.sparkSession)}/relish-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", STAGE_ROW_GROUP).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table over all cores.

    A file is read in one task per row group, however many cores wait.  A table
    of less than one full split per core is dealt out before costly work; a
    larger one has splits enough and is left as it is.
    """
    if not hasattr(df.sparkSession, "_jsparkSession"):
        return df
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if cores > 1 and int(str(size)) < cores * FULL_SPLIT else df


@contextlib.contextmanager
def joins_by_part_of_key(spark: SparkSession):
    """Joins planned inside take rows dealt by some of their keys as they are, instead of dealing both sides by all keys."""
    before = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_KEYS, before)


def stage_by(df: DataFrame, key: str, then: Callable[[DataFrame], DataFrame] = lambda dealt: dealt, like: DataFrame | None = None,
             deal: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder, dealt by ``key``, so that joins on ``key`` read it without a shuffle.

    ``then`` changes the dealt rows before they are written, and leaves the key as it is.  There are as many
    buckets as in ``like``, or follow the size that Spark expects, which is right for tables and not for joins.
    Rows that are dealt by ``key`` already, as those of ``like`` are, need no ``deal``.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if like is not None:
        buckets = like._buckets
    elif hasattr(spark, "_jsparkSession"):
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size < UNKNOWN_SIZE:
            buckets = max(buckets, min(MOST_BUCKETS, size // BUCKET_INPUT))
    name = f"relish_{uuid.uuid4().hex}"
    (then(df.repartition(buckets, key) if deal else df).write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{name}")
     .option("parquet.block.size", STAGE_ROW_GROUP).format("parquet").saveAsTable(name))
    out = spark.table(name)
    out._buckets = buckets
    return out


def parts_for(*frames: DataFrame) -> int:
    """How many parts the joins of ``frames`` should have by the largest table that they read; 0 if one per core will do.

    Adaptive execution leaves about one part per core, up to 64 MB as compressed, which can be gigabytes when
    sorted.  The size Spark expects of a join says little, so that of the files behind it is taken.
    """
    spark = frames[0].sparkSession
    if not hasattr(spark, "_jsparkSession"):
        return 0
    largest = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        largest = max([largest, *[size for size in sizes if size < UNKNOWN_SIZE]])
    parts = min(MOST_BUCKETS, largest // PART_INPUT)
    return max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))) if parts > spark.sparkContext.defaultParallelism else 0


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over ``parts`` tasks, which a join on these keys takes over for its other side; as it is for 0 parts."""
    return df.repartition(parts, *keys) if parts else df


def drop_staged(*frames: DataFrame) -> None:
    """Delete tables written by ``stage`` that no later result reads."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path is None:
            continue
        spark = df.sparkSession
        if not hasattr(spark, "_jsparkSession"):
            continue  # a remote session has no file system handle; the cluster clears the folder
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
