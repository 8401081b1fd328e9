"""Sessions, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g", app: str = "corvane") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()
_folders: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it; once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """A folder of this application's own below the one that the cluster names in spark.checkpoint.dir.

    Only where that is unset (tests on one machine) a temporary one is made. It is removed at the end.
    """
    context = spark.sparkContext
    if context.applicationId not in _folders:
        named = spark.conf.get("spark.checkpoint.dir", None) or Path(tempfile.mkdtemp(prefix="corvane-")).as_uri()
        folder = f"{named.rstrip('/')}/corvane-{uuid.uuid4().hex}"
        _folders[context.applicationId] = folder

        def remove() -> None:
            try:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
            except Exception:  # the session is over already
                pass

        atexit.register(remove)
    return _folders[context.applicationId]


def shared_path(spark: SparkSession) -> str:
    """The full URI of a new table in the shared folder, for Python workers that read parts of it with pyarrow."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{_shared_folder(spark)}/{uuid.uuid4().hex}")
    uri = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return uri if "://" in uri else uri.replace("file:/", "file:///", 1)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as a table to the shared folder and read it back.

    The data outlive the loss of any executor, and df is computed once (a checkpoint computes it twice).
    """
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartition a scan of few, small files so that every core takes part in costly per-row work.

    A scan that already has enough partitions passes through without a shuffle.
    """
    want = least or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
