"""Session helpers: reading tables, cutting lineage through the shared folder."""

from __future__ import annotations

import atexit
import getpass
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Tables written by ``cut`` in this process, by Spark application id.
_written: dict[str, list[str]] = {}
#: Applications whose Python workers have this package.
_shipped: set[str] = set()


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session that is given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfwise")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SHELFWISE_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application; they may start anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="shelfwise-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/shelfwise-{app}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One input table; a Parquet file or a folder of part files."""
    ship(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark runs in one process, a folder of this user under the
    temporary directory is set; on a cluster its absence is an error, since a machine-local folder would
    be lost with its machine.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"/tmp/shelfwise-{getpass.getuser()}-{os.getpid()}"
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    context.setCheckpointDir(f"file://{path}")
    return f"file://{path}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, noted for ``release``."""
    ship(spark)
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/{app}/{tag}-{uuid.uuid4().hex}"
    _written.setdefault(app, []).append(path)
    return path


def cut(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends, executors may be lost.

    A written table is computed once (``checkpoint()`` computes its input twice) and is compressed.
    Returns the new DataFrame and its path, for ``drop``.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables written by ``cut`` that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Remove every table this application wrote; results read from them are no longer usable."""
    drop(spark, *_written.pop(spark.sparkContext.applicationId, []))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions than there are; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def byte_size(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of ``df``; exact for a written table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
