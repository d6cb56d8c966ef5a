"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_shipped: set[str] = set()


def build_session(app: str = "tidemark", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or one under the warehouse.

    Both are shared on a cluster; a folder of one machine is never used.
    """
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints").rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application, for the steps that run Python there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package, packed = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    target = f"{fresh_dir(spark, 'code')}/{package.name}.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read back.

    For a small result that several later steps read: its inputs are scanned once,
    and losing an executor afterwards costs nothing.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; nothing is there yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
