"""Staging of intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import pickle
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``, the folder that driver and executors share.

    Where the setting is absent a temporary folder serves a session on one machine (tests);
    on a cluster its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/lexspan/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    This cuts the lineage: what follows survives the loss of executors without repeating
    the work, sees one fixed partitioning, and joins against a scan, which leaves adaptive
    execution free to split skewed partitions on both sides.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task hands to Python at once. Texts may be long, so this is well below Spark's default.
BATCH_ROWS = 2000


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of at most BATCH_ROWS rows, which bounds a task's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def fitted(sample: DataFrame, fit):
    """``fit(table)`` of a bounded sample, run in one task; only the model comes to the driver."""

    def run(batches):
        kept = [b for b in batches if b.num_rows]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(kept)))], pa.binary())], ["model"])

    row = map_batches(sample.coalesce(1), run, "model binary").first()
    return pickle.loads(row["model"]) if row else None
