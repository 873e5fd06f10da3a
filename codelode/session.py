"""Session settings and the two helpers that touch cluster state."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even when an extra exchange follows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Cut ranked rows per task before the shuffle for every bound used here.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # Archives and source files are large cells: bound a batch by its bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 * 1024 * 1024),
}

# Rows of a request-like table that may be copied to every task: with
# 1,024-wide vectors in doubles this is 16 MB.
BROADCAST_ROWS = 2_000


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads at most one row more."""
    return df.limit(rows + 1).count() <= rows


def pin_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """A request-like table as a local relation, if it has at most ``rows`` rows.

    Reads at most one row beyond the bound; a larger table is returned as it is.
    """
    head = df.limit(rows + 1).toArrow()
    if head.num_rows > rows:
        return df, False
    return df.sparkSession.createDataFrame(head, df.schema), True


def maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    """Hint a broadcast only where the caller has checked the size."""
    return F.broadcast(df) if small else df


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; unset in local mode, one that goes with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    app = spark.sparkContext.applicationId
    if app in _local_folders:
        return _local_folders[app]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    _local_folders[app] = tempfile.mkdtemp(prefix="codelode-")
    atexit.register(shutil.rmtree, _local_folders[app], ignore_errors=True)
    return _local_folders[app]


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a checkpoint the copy is columnar, so each later use reads only the
    columns it needs.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
