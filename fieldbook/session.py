"""Session settings that every operator assumes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "fieldbook", master: str | None = None, **more: str) -> SparkSession:
    """A session in UTC with adaptive execution. Names in ``more`` use _ for the dot."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in more.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Needed where the executors do not have it on their path; harmless where they do.
    """
    context = spark.sparkContext
    if getattr(context, "_fieldbook", None) == context.applicationId:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="fieldbook-")) / "fieldbook.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, f"{package.name}/{source.relative_to(package)}")
    context.addPyFile(str(archive))
    context._fieldbook = context.applicationId
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)


def load(spark: SparkSession, sf_dir: str, name: str):
    """One table of a data folder; Spark opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir if that is
    set, else, in a local session, a temporary one. Other sessions must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fieldbook-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{label}-{uuid.uuid4().hex}"
