"""Running a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def run_once(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Everything that is there now, in one trigger, to Parquet in the shared folder; the written rows."""
    spark = stream.sparkSession
    base = folder or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints/netloom"
    path = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    # Deleted when the driver ends: the rows are read until then.
    for p in (path, f"{path}-progress"):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(stream.schema).parquet(path)
