"""Session set-up and the shared folder used for staged tables and stream state."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_or_create(app: str = "fairload", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # no Python call sites in error messages: recording them doubles the time to build a plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on and ship this package; leave sizing to the cluster's own settings."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that Python workers can import it wherever they start."""
    context = spark.sparkContext
    if getattr(context, "_has_fairload", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="fairload-")) / "fairload-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))  # the driver serves it to the executors
    context._has_fairload = True


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the session.

    Only a local master may fall back to a temporary folder: on a cluster that would be a
    different disk on each machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="fairload-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of the shared one for the intermediate tables of one run; deleted when the run ends."""
    before = shared_dir(spark)
    folder = f"{before}/run-{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", folder)
    try:
        yield folder
    finally:
        spark.conf.set("spark.checkpoint.dir", before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Used where several later steps read the same heavy result: the files survive the loss of
    executors, and later steps keep column pruning and filter push-down.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
