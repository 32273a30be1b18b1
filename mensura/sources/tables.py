"""Tables that are written between steps, in the folder that the session names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset the warehouse, or in local mode a temporary folder.

    On a cluster a warehouse on a machine's own disk is an error: executors would not see each other's files.
    """
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    context = spark.sparkContext
    if context.applicationId not in _OWN:
        local = context.master.split("[")[0] == "local"
        found = "file://" + tempfile.mkdtemp(prefix="mensura-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not local and (found.startswith("file:") or "://" not in found):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[context.applicationId] = found
    return _OWN[context.applicationId]


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table of its own in the shared folder: loops stay shallow and survive lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/mensura/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
