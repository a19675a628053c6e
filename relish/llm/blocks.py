"""A table cut into blocks of rows that stay together over several passes.

Some operators pass over all texts, exchange short keys between all blocks, and
then need for each block the keys it asked about.  ``stage_blocks`` writes the
rows once, as they are read, bucketed by block: later passes that bring keys
back to a block read its rows without shuffling them.  The files lie in the
shared folder, so a lost executor costs a task.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relish.session import UNKNOWN_SIZE, shared_dir

MOST_BLOCKS = 32_768


@functools.lru_cache(maxsize=64)
def _bucket_values(spark: SparkSession, buckets: int) -> tuple[int, ...]:
    """For every bucket an integer that Spark puts into it."""
    reach = 20 * buckets + 200
    rows = spark.range(reach).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(buckets)).alias("b")).agg(F.min("v").alias("v"))
    found = {r["b"]: r["v"] for r in rows.collect()}
    return tuple(found.get(b, 0) for b in range(buckets))


def parts_of(df: DataFrame, most: int) -> int:
    """Into how many parts a partition of ``df`` is to be cut for parts of at most ``most`` bytes of the files behind it."""
    if not hasattr(df.sparkSession, "_jsparkSession"):
        return 1
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = max([0, *[int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]])
    return -(-size // (most * max(1, df.rdd.getNumPartitions()))) if 0 < size < UNKNOWN_SIZE else 1


def stage_blocks(df: DataFrame, parts: int = 1) -> DataFrame:
    """``df`` with the column ``block``, in a table bucketed by it; ``parts`` blocks per partition of ``df``.

    Beyond MOST_BLOCKS, several make one block.
    """
    spark = df.sparkSession
    blocks = max(1, min(df.rdd.getNumPartitions() * parts, MOST_BLOCKS))
    values = F.array(*[F.lit(v) for v in _bucket_values(spark, blocks)])
    number = F.spark_partition_id()
    if parts > 1:
        number = (number.cast("long") * parts + F.pmod(F.monotonically_increasing_id(), F.lit(parts))).cast("int")
    name = f"relish_{uuid.uuid4().hex}"
    (df.withColumn("block", F.element_at(values, number % blocks + 1))
     .write.bucketBy(blocks, "block").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd")
     .option("parquet.block.size", 8 << 20).format("parquet").saveAsTable(name))
    return spark.table(name)


def stage_bucketed(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df``, which has ``like``'s blocks, in a table bucketed as ``like`` is."""
    spark = df.sparkSession
    name = f"relish_{uuid.uuid4().hex}"
    (df.write.bucketBy(max(1, min(like.rdd.getNumPartitions(), MOST_BLOCKS)), "block").option("path", f"{shared_dir(spark)}/{name}")
     .option("compression", "zstd").option("parquet.block.size", 8 << 20).format("parquet").saveAsTable(name))
    return spark.table(name)
