"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# AQE supplies the run-time part of the design: coalescing small shuffle partitions, splitting
# skewed ones in sort-merge joins, and turning joins into broadcasts once a side is known small.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints of per-key tables go when their frame does; stream state lives outside the heap
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "wattline", **settings: str) -> SparkSession:
    """Session with the library's settings; `settings` (dots written as `__`) override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    merged = SETTINGS | {name.replace("__", "."): value for name, value in settings.items()}
    for name, value in merged.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, else a temporary one in local mode."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="wattline-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder and outlive lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


_STAGED: list[tuple[str, str]] = []


def stage(df: DataFrame, name: str = "stage", by: Sequence[str] = ()) -> DataFrame:
    """`df` written once as Parquet in the shared folder, partitioned `by` columns, and read back.

    For a frame that several operators, or an operator with several passes, will read: later scans
    are columnar and pruned, and nothing upstream is computed again.  `drop_staged` removes the tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    _STAGED.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: else they stay until the driver happens to
    collect its garbage.  For frames that are read back from where they were written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def drop_staged(spark: SparkSession) -> int:
    """Remove the tables this application has staged; frames made from them can no longer be read."""
    own = [path for app, path in _STAGED if app == spark.sparkContext.applicationId]
    for path in own:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _STAGED[:] = [entry for entry in _STAGED if entry[1] not in own]
    return len(own)
