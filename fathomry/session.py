"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)
#: Rows of an Arrow batch, where the session has Spark's default of 10,000: whole texts go to Python workers.
ARROW_ROWS = "1000"


def prepared(spark: SparkSession) -> SparkSession:
    """Let Python workers of a local session find this package, wherever the driver was started; bound what they hold at once."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in (*paths, ROOT) if p)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); a local one only in a local session that sets none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="fathomry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; results that haven't been saved elsewhere go with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """``df`` written to the application's part of the shared folder and read again, where several branches of a plan use it.

    The rows are counted as they are written, so that ``row_count`` needs no job. ``group_rows``: rows of a row group at most, for
    large rows: writers hold a group, and readers a batch that ends with its group, whatever a task's share of the files is.
    """
    path = f"{_own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
    (writer.option("parquet.block.row.count.limit", group_rows) if group_rows else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.rows_written = seen.get.get("rows")  # none, if the plan turned out to be empty
    return out


def row_count(df: DataFrame, most: int) -> int:
    """The rows of ``df``, counted up to ``most`` where ``df`` isn't as ``written`` returned it."""
    known = getattr(df, "rows_written", None)
    return df.limit(most).count() if known is None else known
