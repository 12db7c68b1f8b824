"""Sessions, table access and the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
#: Paths that fresh_path() has given and nobody has deleted.
_written: set[str] = set()


def local_session(app: str = "quirelab", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give every executor this package; done once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_quirelab_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quirelab-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "quirelab.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, Path("quirelab") / path.relative_to(_PACKAGE))
    context.addPyFile(target)
    context._quirelab_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (tests only) a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quirelab-shared-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted by cleanup() at the latest."""
    path = f"{shared_dir(spark)}/quirelab-{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that lineage ends here and no result is computed twice.

    Tables that a returned DataFrame still reads stay until cleanup()."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quirelab_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialise() whose readers have all finished."""
    path = getattr(df, "_quirelab_path", None)
    if path:
        _delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Delete everything below fresh_path() that is left, once no result that reads them is needed any more."""
    for path in sorted(_written):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)
