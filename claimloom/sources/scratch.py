"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only if the session names none and runs in one process.

    On a cluster without spark.checkpoint.dir the warehouse serves, unless it is on local disks too: that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not local and (":/" not in warehouse or warehouse.startswith("file:")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-") if local else f"{warehouse}/scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/") + "/claimloom"


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written to a new table and read back, where several steps read it: lineage ends there and lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
