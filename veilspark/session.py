"""Session settings and the shared folder used for checkpoints."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


SPREAD = "spark.veilspark.inputPartitions"
"""Where set, small tables of one row group are dealt to so many partitions after the scan."""

WORK_ROWS, LEAST_ROWS = 10_000, 250
"""Keys of forms or images to a task, and those below which a task is not worth while."""


def local_session(cores: str = "8", app: str = "veilspark") -> SparkSession:
    """Session for tests and local benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(max(8, int(cores) if cores.isdigit() else 8)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(SPREAD, cores if cores.isdigit() else "8")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    Where that setting is absent, a local session (tests, one machine) gets a
    temporary folder; on a cluster no other machine would see it, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex[:12]}")


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame that several branches read to the shared folder, once.

    Readers get a plain parquet scan (pruned and pushed down), the lineage is
    cut, and a lost executor costs only its own tasks.
    """
    path = shared_dir(df.sparkSession, purpose)
    for made in getattr(_open, "made", [])[-1:]:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_open = threading.local()


@contextmanager
def scratch() -> Iterator[None]:
    """Delete, at the end, the copies that ``materialise`` makes meanwhile in this thread; for jobs that end inside, such
    as the handler of a micro-batch, whose copies hold raw values."""
    if not hasattr(_open, "made"):
        _open.made = []
    _open.made.append([])
    try:
        yield
    finally:
        for path in _open.made.pop():
            delete(path)


def delete(folder: str) -> None:
    """Delete a folder below the shared one, if it is there."""
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", folder if ":" in folder else f"file:{folder}"))
    if store.get_file_info(inside).type == fs.FileType.Directory:
        store.delete_dir(inside)


_shipped: set[str] = set()
_BATCH_BYTES, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Jobs that run Python functions call this themselves, so the package need not
    be installed on the executors.
    """
    # Python functions get batches bounded by bytes, not by rows of any length; a user's own setting stays.
    if spark.conf.get(_BATCH_BYTES, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_BYTES, str(4 << 20))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "veilspark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Deal the rows to as many partitions as the session asks for, if it asks.

    A large input has a task per file split and needs no such shuffle; the setting
    is for small files of a single row group on one machine.

    ``rows``: for narrow tables whose rows make much work each. A million keys fit one split of a few MB, so the
    split says nothing about the work; without the setting they are dealt by so many rows to a task, and to all
    cores as soon as there are a few hundred rows for each.
    """
    spark = df.sparkSession
    wanted = spark.conf.get(SPREAD, None)
    if wanted:
        return df.repartition(int(wanted), *keys)
    return df if rows is None else df.repartition(tasks(df, rows), *keys)


def tasks(df: DataFrame, rows: int) -> int:
    """How many tasks the rows of a narrow table make, so many to each, and all cores if there are enough."""
    n = df.count()
    return max(1, -(-n // rows), min(df.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))


def grows(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast.

    Spark estimates a frame by the bytes of its files and the default sizes of its columns: one that was written well
    compressed, exploded or made by a Python function may be a hundred times that, and would go through the driver.
    """
    return df.hint("merge")
