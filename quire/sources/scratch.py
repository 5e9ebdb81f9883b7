"""Where intermediate tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder that every process of the session can see.

    ``spark.checkpoint.dir`` names the cluster's shared folder. Without it only a session
    on one machine gets a folder, below its warehouse; elsewhere executors would write
    where nobody else can read.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/quire-{uuid.uuid4().hex}"
