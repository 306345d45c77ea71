"""Session helpers: builder for scripts and tests, shared working folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(master: str | None = None, app: str = "quarry", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quarry-pkg-")) / "quarry_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def on_mounted_folder(spark: SparkSession) -> bool:
    return spark.conf.get("quarry.sharedMount", "false").lower() == "true"


def work_dir(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; a temp folder only for local masters."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if shared:
        if shared.startswith("file:") and not sc.master.startswith("local") and not on_mounted_folder(spark):
            raise RuntimeError("spark.checkpoint.dir is a machine-local folder; set quarry.sharedMount=true if all executors mount it")
        return shared.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="quarry-")
    path = _local_dirs[sc.applicationId]
    sc.setCheckpointDir(path + "/checkpoints")
    return path


def stage_root(spark: SparkSession) -> str:
    """Folder of this application's stages."""
    return f"{work_dir(spark)}/quarry-stage/{spark.sparkContext.applicationId}"


def clear_stages(spark: SparkSession) -> bool:
    """Delete the stages of this application; only when every result that reads them has been written."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


#: Deletes a query's shuffle files when it ends, not when the driver next collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes in here leave no shuffle files behind: what they wrote is read back, the shuffles never are."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def drop_stage(df: DataFrame) -> None:
    """Delete a materialized frame that nothing will read again."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write `df` once under the shared folder (with `options` of the writer) and read it back.

    Reading back also gives the optimizer the true size, so a later join broadcasts the
    result only when it is really small.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast hint only when the counted (or provable) row bound is small."""
    return F.broadcast(df) if rows <= limit else df
