"""A session with the settings that results depend on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: The folder that holds this package.
ROOT = str(Path(__file__).resolve().parents[1])
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "svloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package also where only the driver's path has it.

    On a cluster where the package lies elsewhere the added folder is not there and does nothing.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, ROOT])
