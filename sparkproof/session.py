"""Spark session and paths."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark. A cluster brings its own configuration."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkproof")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it (spark.checkpoint.dir).

    A temporary folder serves only where it is unset and driver and executors are one machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    conf = conf or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder in the place that all executors see."""
    return f"{shared_dir(spark).rstrip('/')}/sparkproof-{name}-{uuid.uuid4().hex}"


def package_zip(folder: str) -> str:
    """The package as one archive that Python imports from."""
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(folder, "sparkproof.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(at, name)
                out.write(full, os.path.join("sparkproof", os.path.relpath(full, root)))
    return path


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, for clusters on which it isn't installed. The driver serves the
    archive; executors that join later get it too."""
    spark.sparkContext.addPyFile(package_zip(tempfile.mkdtemp(prefix="sparkproof-")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
