"""A stream of label edits into an append log of changed labels.

Edits arrive as files.  A micro-batch keeps the last valid edit of each (example,
labeler) and writes these few rows to a folder of its own, named by the
batch; a batch that is repeated after a failure replaces that folder, so nothing
is written twice.  The label table is not rewritten: the labels of a moment are
the stored ones with the log's last edits on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relish.operators.store import ESCI, Store, upsert_labels

EDITS = "example_id long, labeler_id long, esci_label string, edited_at timestamp, seq long"
KEY = ["example_id", "labeler_id"]


def last_edits(edits: DataFrame) -> DataFrame:
    """The last valid edit of each key, by time and then ``seq``."""
    last = edits.filter(F.coalesce(F.col("esci_label").isin(ESCI), F.lit(False))).groupBy(*KEY).agg(
        F.max_by(F.struct("esci_label", "edited_at", "seq"), F.struct("edited_at", "seq")).alias("e"))
    return last.select(*KEY, "e.*")


def append_edits(batch: DataFrame, batch_id: int, log: str) -> None:
    """Write a micro-batch to the log; the same batch again leaves the log as it is."""
    last_edits(batch).write.mode("overwrite").parquet(f"{log.rstrip('/')}/batch={batch_id}")


def start_label_log(spark: SparkSession, edits: str, log: str, checkpoint: str, files_per_batch: int = 1000, **trigger) -> StreamingQuery:
    """M9 as a stream: JSON lines appearing in the folder ``edits`` go to the folder ``log``.

    Takes what is there and stops, unless another ``trigger`` is given
    (``processingTime="1 minute"``).
    """
    stream = spark.readStream.schema(EDITS).option("maxFilesPerTrigger", files_per_batch).json(edits)
    return (stream.writeStream.foreachBatch(lambda batch, batch_id: append_edits(batch, batch_id, log))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def logged_edits(spark: SparkSession, log: str) -> DataFrame:
    """The last edit of each key in the log, however late its file came; the log must hold a batch."""
    return last_edits(spark.read.schema(EDITS).parquet(f"{log.rstrip('/')}/batch=*"))


def labels_of(store: Store, log: str) -> Store:
    """The store with the log's edits applied, as one ``upsert_labels`` of all edits would have it."""
    return upsert_labels(store, logged_edits(store.label.sparkSession, log))[0]
