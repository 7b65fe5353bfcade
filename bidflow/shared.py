"""Shared storage for intermediate tables, and the session used by tests and bench."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Rows of a shuffle that one task sorts in memory beside the wider ones it makes of them, and what they take when compressed.
ROWS_PER_TASK = 400_000
SIZED_BYTES = "16m"
# Lets the shuffles of an action go with its end; else their files stay until the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Of written tables: hashes in hexadecimal digits take half of what they take otherwise.
COMPRESSION = "zstd"

_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


def local_session(cores: str = "*", app: str = "bidflow", **conf: str) -> SparkSession:
    """A single-machine session for tests and bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a
    missing setting is an error, because a machine-local folder would be lost
    with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="bidflow-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no one has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/bidflow/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Cuts the lineage, survives lost executors, and unlike an RDD checkpoint
    keeps columnar reads, column pruning and file statistics. Nothing reads the
    shuffles of the write again, so their files go with it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    scope = _scope.get()
    if scope is not None:
        scope.paths.append(path)
    with shuffles_gone(spark):
        df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_gone(spark: SparkSession) -> Iterator[None]:
    """The shuffles of a write done inside go with it."""
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


@contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of work done inside go to enough tasks for ``rows`` rows, whatever the session's count is.

    Spark merges small partitions by their compressed bytes, of which typed rows
    take many times more in memory; so they are merged to smaller ones, too,
    unless the session names a size.
    """
    count, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {key: spark.conf.get(key, None) for key in (count, size)}
    if rows > ROWS_PER_TASK * int(spark.conf.get(count)):
        spark.conf.set(count, str(-(-rows // ROWS_PER_TASK)))
    if rows > ROWS_PER_TASK and before[size] is None:
        spark.conf.set(size, SIZED_BYTES)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Scope:
    """Staged tables of a piece of work, and those that outlive it."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Let the last staged table, ``df``, live on in the scope around this one."""
        self.kept.append(self.paths[-1])
        return df


@contextmanager
def cleared(spark: SparkSession) -> Iterator[Scope]:
    """Delete at the end what was staged inside: for work whose result is written by then."""
    outer, scope = _scope.get(), Scope()
    token = _scope.set(scope)
    try:
        yield scope
    finally:
        _scope.reset(token)
        if outer is not None:
            outer.paths += scope.kept
        for path in scope.paths:
            if path not in scope.kept:
                hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
