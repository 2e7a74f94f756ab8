"""Stage tables: a result that several steps read is written once to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again: evaluated once, with a short plan and real sizes for the joins that follow.

    The folder is spark.checkpoint.dir. A session on one machine that names none, as in tests, gets a temporary one; a cluster must name it.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stages-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
