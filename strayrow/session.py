"""Session helpers: where shared files live and how derived tables are kept."""

from __future__ import annotations

import math
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"
# Tables written by materialize, per Spark application, until release.
_written: dict[str, list[str]] = {}
# Blocks of cleaned_up that are open in a thread.
_open = threading.local()
# Spark deletes the shuffle files of a query when it ends, not when the driver collects garbage.
SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing = threading.Lock()
# Per session: writes under way, and the setting before the first of them.
_writers: dict[int, tuple[int, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A local session without the setting gets a folder of its own; on a cluster a
    missing setting is an error, because a machine-local folder would lose data.
    """
    path = spark.conf.get(SHARED_DIR_CONF, None)
    if path:
        return path.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"set {SHARED_DIR_CONF} to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="strayrow-")
    spark.conf.set(SHARED_DIR_CONF, path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/strayrow/{label}-{uuid.uuid4().hex}"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """A block whose queries leave no shuffle files behind when they end."""
    key = id(spark)
    with _writing:
        n, before = _writers.get(key, (0, ""))
        if not n:
            before = spark.conf.get(SHUFFLE_CLEANUP_CONF, "false")
            spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
        _writers[key] = n + 1, before
    try:
        yield
    finally:
        with _writing:
            n, before = _writers.pop(key)
            if n > 1:
                _writers[key] = n - 1, before
            else:
                spark.conf.set(SHUFFLE_CLEANUP_CONF, before)


def materialize(df: DataFrame, label: str, compression: str | None = None, outside: int = 0) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and return the table.

    Used where a derived table is read several times: it cuts the lineage, keeps
    nothing in executor memory and survives lost executors. The shuffles that led to it are
    deleted. The table outlives the ``outside`` innermost blocks of :func:`cleaned_up`.
    """
    path = new_path(df.sparkSession, label)
    scopes = getattr(_open, "scopes", [])
    scopes = scopes[: len(scopes) - outside]
    if scopes:
        scopes[-1].append(path)
    else:
        _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    with short_shuffles(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """A block after which the tables that :func:`materialize` wrote inside it are deleted.

    For work that ends in the block, such as scoring a batch and storing its flags.
    Blocks may be nested; each belongs to the thread that opened it.
    """
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            delete_folder(spark, path)


def release(spark: SparkSession) -> int:
    """Delete the derived tables this application wrote with :func:`materialize`.

    Fitted neighbour models and results that are not written yet still read them, so
    this comes last; a saved model keeps its own copy. Gives the number of tables.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_folder(spark, path)
    return len(paths)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder through Spark's file systems; a missing one is no error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Derived tables of one job; see :func:`scratch`."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self.paths: list[str] = []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` as :func:`materialize` does and return the table, which lives as long as the block."""
        path = new_path(self._spark, label)
        self.paths.append(path)
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete the tables written so far."""
        while self.paths:
            delete_folder(self._spark, self.paths.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A block whose derived tables are deleted at its end, also after an error.

    What the block returns must not read them any more: write it with
    :func:`materialize` or to its own place inside the block.
    """
    tables = Scratch(spark)
    try:
        yield tables
    finally:
        tables.clear()


# Tables up to this size are spread over all cores before heavy work per row.
SMALL_ROWS = 1_000_000
# Rows of a partition in larger ones; files may pack millions in a few megabytes.
PARTITION_ROWS = 100_000


def spread(df: DataFrame, n: int) -> DataFrame:
    """Even out a table of ``n`` rows that a few files would leave on a few cores.

    A small one goes to all cores, a larger one to a partition for every PARTITION_ROWS rows, so
    that what one task holds or reads does not grow with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores if n <= SMALL_ROWS else max(cores, math.ceil(n / PARTITION_ROWS)))


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, for sessions started without it on their path.

    The same as naming a zip of it in ``--py-files``; once per Spark application.
    """
    context = spark.sparkContext
    name = f"strayrow-{context.applicationId}.zip"
    if any(f.endswith(name) for f in context.listFiles):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="strayrow-")) / name
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
