"""What a session needs so that Python code of this library can run on its executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as spark-submit --py-files would."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="leadlake-")) / "leadlake.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((*root.rglob("*.py"), *root.rglob("*.json"))):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder, spark.checkpoint.dir. Where that is unset, a session on one machine gets a folder of
    its own there, and one on a cluster a folder in the warehouse, which its executors reach."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            local = context.master.startswith("local[") or context.master == "local"
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextlib.contextmanager
def passing_shuffles(spark: SparkSession):
    """What is run within leaves no shuffle files when it is done, even if a listener still holds its plan; without this they
    stay until the driver's garbage is collected and nothing holds the plan."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpointed(df):
    """Cut the lineage with a checkpoint in the session's shared folder."""
    checkpoint_folder(df.sparkSession)
    with passing_shuffles(df.sparkSession):
        return df.select("*").checkpoint()  # a plan of its own, as its shuffles go


def stored(df):
    """Cut the lineage with a compressed table in the session's shared folder: a fraction of a checkpoint's bytes."""
    path = shared_path(df.sparkSession, "table")
    with passing_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared folder, for tables of one run."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
