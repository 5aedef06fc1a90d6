"""Session settings the jobs rely on, and where they may put durable scratch data."""

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Texts reach Python in batches of so many bytes, however long they are; a longer text is a batch of its own.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

_shipped: set[str] = set()
_local_roots: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session zone, so that day buckets and naive timestamps mean UTC, keep batches for Python small, and give workers this package."""
    for key, value in ({"spark.sql.session.timeZone": "UTC"} | BATCH_BYTES).items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        spark.sparkContext.addPyFile(_package_archive())
        _shipped.add(application)
    return spark


def _package_archive() -> str:
    """The package as a zip file, as ``--py-files`` would hand it out."""
    package = Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="articleflow-"), "articleflow.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    return archive


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path for intermediate tables, below the folder the cluster names in spark.checkpoint.dir.

    The setting is read from the session. Only where it is unset, and all tasks run on this machine (tests),
    a local folder takes its place.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if context.applicationId not in _local_roots:
            _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="articleflow-")
        root = _local_roots[context.applicationId]
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, path: str | None = None, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table and read it back: cuts the lineage and survives lost executors."""
    path = path or shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none where there is no such folder."""
    folder, files = _folder(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(folder) if entry.isDirectory()] if files.exists(folder) else []


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    folder, files = _folder(spark, f"{path}/_SUCCESS")
    return files.exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    folder, files = _folder(spark, path)
    files.delete(folder, True)


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as soon as it is written."""
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


class _Scratch:
    """Stores tables for one step; ``keep`` stores one that outlives it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str = "step") -> DataFrame:
        self.paths.append(shared_dir(self.spark, name))
        with freed_shuffles(self.spark):
            return materialize(df, self.paths[-1])

    def keep(self, df: DataFrame, name: str = "step") -> DataFrame:
        return materialize(df, name=name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[_Scratch]:
    """Intermediate tables that are removed when the step is over."""
    put = _Scratch(spark)
    try:
        yield put
    finally:
        for path in put.paths:
            remove(spark, path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by ``key`` for a Python-heavy stage, over as many tasks as other shuffles have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
