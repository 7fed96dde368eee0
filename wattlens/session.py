"""Session helpers: pinned time zone, shared scratch space, lineage cuts."""

from __future__ import annotations

import io
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

class _Owners(threading.local):
    """The open ``owned_stages`` of a thread; a stream's callback runs in a thread of its own."""

    def __init__(self):
        self.open: list[list[str]] = []


_owners = _Owners()
_shipped: set[str] = set()


def build_session(app: str = "wattlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and all truncation done in UTC."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """Hour and day buckets are always cut in UTC, whatever the session started with."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="wattlens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured if configured else context.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Functions that run in workers are pickled by reference, so every executor has
    to be able to import them, wherever the driver was started.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    handle, path = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")
    with os.fdopen(handle, "wb") as file:
        file.write(archive.getvalue())
    context.addPyFile(path)  # the driver serves it to the executors
    _shipped.add(context.applicationId)


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder, owned by the open ``owned_stages``."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _owners.open:
        _owners.open[-1].append(path)
    return path


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete stage tables and empty the list."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    paths.clear()


@contextmanager
def owned_stages(spark: SparkSession | None = None, into: list[str] | None = None) -> Iterator[list[str]]:
    """Collect the stage tables written inside the block.

    With ``spark`` they are removed when the block ends, so results must be used
    inside it. Without, the caller drops them later with ``drop_paths``.
    """
    paths = [] if into is None else into
    _owners.open.append(paths)
    try:
        yield paths
    finally:
        _owners.open.pop()
        if spark is not None:
            drop_paths(spark, paths)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts lineage in a way that survives lost executors, keeps a costly stage from
    being computed once per consumer, and gives the planner the true size.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
