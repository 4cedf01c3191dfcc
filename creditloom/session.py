"""Session set-up and the one way this package cuts lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Whether the shuffle files of a query go at its end.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; the cluster's own settings win elsewhere."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split a hot join key even where that costs the next join another shuffle.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    A local session without that setting, as in tests, gets a temporary folder that is removed at
    its end; any other one is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="creditloom-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir`` for tables that a job writes and rereads."""
    return f"{_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


@contextlib.contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of each query made and run in here as soon as that ends."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def materialize(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Checkpoint ``df`` so that later stages see one fixed result even if executors are lost.

    With ``drop_shuffles`` Spark removes the shuffle files of ``df`` as soon as its rows are written,
    and not only when the driver happens to collect its garbage: nobody reads them again then.
    """
    spark = df.sparkSession
    _checkpoint_dir(spark)
    if not drop_shuffles:
        return df.checkpoint(eager=True)
    with dropped_shuffles(spark):
        return df.select("*").checkpoint(eager=True)  # a query of its own, made under the setting
