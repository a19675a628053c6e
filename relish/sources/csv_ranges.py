"""One large CSV file with line breaks inside cells, read by many tasks.

Spark's line reader cuts a file into byte ranges.  Whether a line starts inside
a quoted cell depends on the number of quotes before it in its file: an even
number, and the line starts a record.  So each range counts its lines with an
odd number of quotes, prefix sums over the ranges (one row each) give every
range its start, and each line then knows its record without looking at other
lines.  Only lines of records that span several lines are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = ["file", "block"]
NUMBERED = "file string, block long, value string, odd int, line long, before long"


def _number_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``line``, the place in the range, and ``before``, the odd lines ahead of it there.

    A task reads its ranges one after the other, each in the file's order.
    """
    at, line, odd_lines = None, 0, 0
    for batch in batches:
        block = batch.column(1).to_numpy()
        files = batch.column(0).dictionary_encode()
        code = files.indices.to_numpy()
        odd = batch.column(3).to_numpy().astype(np.int64)
        cut = np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1
        lines, before = np.empty(len(odd), np.int64), np.empty(len(odd), np.int64)
        for start, end in zip([0, *cut], [*cut, len(odd)], strict=True):
            if start == end:
                continue
            here = (files.dictionary[int(code[start])].as_py(), int(block[start]))
            if here != at:
                at, line, odd_lines = here, 0, 0
            total = np.cumsum(odd[start:end])
            lines[start:end] = line + np.arange(end - start)
            before[start:end] = odd_lines + total - odd[start:end]
            line, odd_lines = line + end - start, odd_lines + int(total[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines), pa.array(before)], [*batch.schema.names, "line", "before"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the CSV files in ``path`` as text, ``(record)``, without headers and empty lines.

    Quotes must be doubled inside quoted cells and stand nowhere else.  A
    record's lines meet in one task; a quote that is never closed makes the rest
    of its file one record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).cast("int").alias("odd"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy(*RANGE).agg(F.sum("odd").alias("n")).select(*RANGE, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    placed = lines.mapInArrow(_number_lines, NUMBERED).join(starts, RANGE).withColumn("quotes", F.col("ahead") + F.col("before"))
    whole = (F.col("quotes") % 2 == 0) & (F.col("odd") == 0)
    first = (F.col("block") == 0) & (F.col("line") == 0)
    single = placed.filter(whole & ~first).select(F.col("value").alias("record"))
    # a record opens at an even count, its other lines stand at the odd count after it
    spanning = placed.filter(~whole).groupBy("file", F.floor(F.col("quotes") / 2).alias("number")).agg(
        F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("parts"))
    top = F.col("parts")[0]
    joined = spanning.filter(~((top["block"] == 0) & (top["line"] == 0))).select(
        F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"))
    return single.union(joined).select(F.regexp_replace("record", "\r$", "").alias("record")).filter("record <> ''")


def read_csv_ranges(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header in every file and line breaks in cells, a file read by as many tasks as it has splits.

    Gives the rows of ``read_csv`` with the same schema, in no particular order.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    row = F.from_csv("record", columns, {"escape": '"', "multiLine": "true"})
    return records(spark, path).select(row.alias("row")).select("row.*")
