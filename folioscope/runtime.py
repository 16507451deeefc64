"""Session settings, lineage cuts that survive lost executors, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, of a table that may be sent to every executor.
BROADCAST_BYTES = 32 << 20


def session(app: str = "folioscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine relies on; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers once per application, so that they can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_folioscope_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="folioscope-"), "folioscope.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    archive.write(path, os.path.join("folioscope", os.path.relpath(path, package)))
    context.addPyFile(target)
    context._folioscope_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"folioscope-{os.getpid()}")
    if not os.path.isdir(own):
        os.makedirs(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return "file://" + own


#: Workspaces whose tables haven't been removed.
_OPEN: list[Workspace] = []


def release() -> None:
    """Removes the tables of all workspaces. For callers that have written their results: a result that is read later needs its tables."""
    while _OPEN:
        _OPEN.pop().clear()


class Workspace:
    """Tables written into the shared folder to cut lineage.

    A written table outlives any executor, unlike a local checkpoint, and is read back with exact
    statistics. `drop` removes a table as soon as no later step needs it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        _OPEN.append(self)
        self.base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, *metrics) -> DataFrame:
        """Write `df`, read it back; with `metrics` (aggregate columns with aliases) return (table, values)."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        seen = Observation() if metrics else None
        (df.observe(seen, *metrics) if metrics else df).write.mode("overwrite").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._workspace_path = path
        return (table, seen.get) if metrics else table

    def clear(self) -> None:
        """Removes all tables of this workspace; for callers that have written the result elsewhere."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            path = getattr(table, "_workspace_path", None)
            if path:
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def table_bytes(table: DataFrame) -> int:
    """Bytes on disk of a table kept by a Workspace (a proven bound, not an estimate by the optimizer)."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._workspace_path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def small(table: DataFrame, limit: int = BROADCAST_BYTES, inflate: int = 4, of: DataFrame | None = None) -> DataFrame:
    """`table` marked for broadcast if the bytes written for it prove that it is small, else as it is.

    Parquet is compressed, so the written size is multiplied by `inflate` before the comparison. `of` is the
    written table where `table` is a projection of it, or has no more rows.
    """
    return F.broadcast(table) if table_bytes(table if of is None else of) * inflate <= limit else table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
