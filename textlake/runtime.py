"""Session defaults and lineage cuts that every other module shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_ZIPPED: list[Path] = []
_WRITTEN: list[tuple[SparkSession, str]] = []


def session(app: str = "textlake", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the engine is written for; the caller's conf wins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = b.config(map=settings).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that their Python workers find it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="textlake-")) / "textlake.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(at))
    _ZIPPED.append(at.parent)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, one machine has a folder of its own (tests); a cluster has none, and
    that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: set it to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"textlake-shared-{os.getpid()}")
    return at.rstrip("/")


def ship_file(spark: SparkSession, path: str) -> None:
    """Sends a file to the executors once a session; shipped() finds it there."""
    key = f"{spark.sparkContext.applicationId} {path}"
    if key not in _SHIPPED:
        _SHIPPED.add(key)
        spark.sparkContext.addFile(path)


def shipped(path: str) -> str:
    """Where an executor has a file: at its own path, or as sent by ship_file()."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def remove(at: str, spark: SparkSession) -> None:
    """Removes a table that materialize() wrote before the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that costs far more than moving its rows.

    A scan of many files passes unchanged; only one of fewer pieces than cores is dealt out anew.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df as a Parquet table in the shared folder and reads it back.

    Later stages then prune columns and survive the loss of any executor without repeating the work before the cut.
    The table is removed when the driver ends.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/textlake-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _WRITTEN.append((spark, at))
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that materialize() writes inside go when the block ends: for work that repeats, such as the batches of a stream."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        for _, at in _WRITTEN[before:]:
            remove(at, spark)
        del _WRITTEN[before:]


@atexit.register
def _clean() -> None:
    for folder in _ZIPPED:
        shutil.rmtree(folder, ignore_errors=True)
    for spark, at in _WRITTEN:
        try:
            remove(at, spark)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return
