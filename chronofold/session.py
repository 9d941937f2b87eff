"""A session with the settings the library counts on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def spark_session(app: str = "chronofold", cpus: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and, on one machine, a shuffle partition for each core."""
    cpus = cpus or os.cpu_count() or 1
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables that a job writes and reads again: in the shared folder that ``spark.checkpoint.dir`` names, on a cluster without it in the warehouse.

    Only a local session without the setting gets a temporary folder of this machine, which goes at the end.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and spark.sparkContext.master.startswith("local"):
        import atexit
        import shutil
        import tempfile

        held = tempfile.mkdtemp(prefix="chronofold-")
        atexit.register(shutil.rmtree, held, ignore_errors=True)
        there = f"file://{held}"
    elif not there:
        there = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex}"
