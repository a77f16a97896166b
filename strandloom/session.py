"""Tables, sessions and shared scratch tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SCRATCH_CONF = "spark.checkpoint.dir"
_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, as --py-files would."""
    if spark.sparkContext.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="spark-strandloom-")  # read by this driver only, which serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{here.name}.zip", "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(f"{folder}/{here.name}.zip")
    _shipped.add(spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where that setting is missing, as in tests on one machine, a folder of
    this session is made and set as the checkpoint folder.
    """
    found = spark.conf.get(SCRATCH_CONF, None)
    if found:
        return found.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError(f"set {SCRATCH_CONF} to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-strandloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set(SCRATCH_CONF, made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only a re-read. The table is dropped
    by :func:`discard`, at the end of a :func:`scope` or when the driver ends.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{scratch_dir(spark)}/strandloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._strandloom_path = path
    return back


@contextmanager
def scope() -> Iterator[None]:
    """Drops, at its end, every table that was written by :func:`materialize` within it.

    Put it around a query and the writing of its result, as a driver that lives long should:
    results are read from such tables, so they can't be dropped before.
    """
    held = [path for _, path in _written]
    try:
        yield
    finally:
        for spark, path in [x for x in _written if x[1] not in held]:
            _delete(spark, path)
            _written.remove((spark, path))


def discard(df: DataFrame) -> None:
    """Drop a table of :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_strandloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _discard_all() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            pass
