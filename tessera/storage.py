"""Where a job puts tables of its own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local applications that name none.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which all executors share.

    Where it is unset, a local master (tests) gets a new temporary folder; on a cluster that would be each machine's
    own disk, so it is an error. The session's settings stay as they are.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        name = spark.sparkContext.applicationId
        at = _LOCAL[name] = _LOCAL.get(name) or tempfile.mkdtemp(prefix="checkpoint-")
    return at


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that no other table of this or another job has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The returned rows are read lazily, so the files stay as long as the job's results may be read: whoever owns the
    folder removes it after the job, as with Spark's own checkpoints.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
