"""Spark sessions, tables, and shipping of this package to Python workers."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session on this machine, with the settings that the library expects of a cluster's."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TILESPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


#: Rows that go to a Python worker at once, unless the session says otherwise. Rows hold whole texts here, and Spark's
#: default of 10,000 would hold them twice on either side.
ROWS_PER_BATCH = 1_000
#: Bytes that go there at once, with one row more; Spark's default is 64 MB, and rows may be packs of texts of megabytes each.
BYTES_PER_BATCH = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application. They need no copy installed."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(ROWS_PER_BATCH))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64MB", "64m"):
        spark.conf.set(key, str(BYTES_PER_BATCH))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tilespark-")
    path = os.path.join(folder, "tilespark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder; only columns that a query uses are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and the master is this
    machine alone, a temporary folder of it. On a cluster each executor would write to its own disk, so there it raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share; the master is {master!r}")
        path = "file://" + os.path.join(tempfile.gettempdir(), f"tilespark-{os.getuid()}")
    return path.rstrip("/")


#: The folder of each application, and below it those of the runs that are open (run_folder), innermost last.
_folders: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _current(spark: SparkSession) -> list[str]:
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = f"{scratch_dir(spark)}/{app}-{uuid.uuid4().hex[:8]}"
        _folders[app] = [root]

        def at_exit():
            # the application may be gone already; its folder then stays for whoever empties the shared one
            with contextlib.suppress(Exception):
                _delete(spark, root)

        atexit.register(at_exit)
    return _folders[app]


@contextlib.contextmanager
def run_folder(spark: SparkSession):
    """What operators write to the shared folder within this block is deleted at its end, when the caller has written or
    collected the result. Without it the tables stay until the application ends."""
    folders = _current(spark)
    path = f"{folders[-1]}/run-{uuid.uuid4().hex}"
    folders.append(path)
    try:
        yield path
    finally:
        folders.remove(path)
        _delete(spark, path)


#: Spark's setting that deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str, row_group: int | None = None, outer: bool = False) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: its lineage ends there, so an executor
    that is lost later costs no recomputation, and every later use reads the same rows. row_group: bytes that a writer,
    and later a reader, holds at once; less than Parquet's 128 MB where single rows are large. outer: the table outlives
    the innermost open run_folder. What was shuffled for it is deleted when it is written, not when the driver next collects
    garbage."""
    spark = df.sparkSession
    folders = _current(spark)
    path = f"{folders[-2 if outer and len(folders) > 1 else -1]}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write if row_group is None else df.write.option("parquet.block.size", row_group)).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)
