"""Session, shared-folder and code-shipping helpers used by every operator."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()
_SCRATCH: list[tuple[SparkSession, str]] = []


def session(name: str = "lodestrata", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors once per Spark application.

    Workers unpickle Python functions by reference, so the package must be
    importable on every executor; a small zip served by the driver does that
    without a shared file system.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="lodestrata-"), "lodestrata_code.zip")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(PACKAGE_ROOT):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(PACKAGE_ROOT)))
    target = os.path.realpath(target)
    with open(target, "wb") as sink:
        sink.write(buffer.getvalue())
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, local mode) is one chosen here.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _LOCAL_DIR
    if _LOCAL_DIR is None:
        _LOCAL_DIR = "file://" + tempfile.mkdtemp(prefix="lodestrata-shared-")
    return _LOCAL_DIR


_LOCAL_DIR: str | None = None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which ``release`` deletes."""
    path = f"{shared_dir(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage in a way that survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder through Hadoop's file system of that path."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> int:
    """Delete all scratch tables that this session has written; returns their number."""
    mine = [item for item in _SCRATCH if item[0] is spark]
    for item in mine:
        delete_path(*item)
        _SCRATCH.remove(item)
    return len(mine)


@atexit.register
def _cleanup() -> None:
    if _LOCAL_DIR is not None:
        import shutil

        shutil.rmtree(_LOCAL_DIR.removeprefix("file://"), ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark alone (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small enough for very long texts."""
    current = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if current > rows or current <= 0:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
