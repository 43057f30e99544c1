"""Tables written between jobs, to cut a lineage that a loop would make longer and longer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints/lodequery"
    return folder.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as Parquet in the folder that driver and executors share, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodequery-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
