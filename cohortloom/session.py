"""Session settings and the one place where a frame is cut loose from its lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the plans rely on. A person may own a third of all event
# rows; the row-level joins on person_id are split by AQE, and "force" lets it
# do so even where a later step would have reused the join's partitioning.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Where a session does not say how much a shuffle's task reads: 16 MB, as narrow rows take some 17 times that once sorted
TASK_BYTES, ADVISORY_BYTES = "16m", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
INPUT_TO_A_PARTITION = 4 << 20

# true: a query's shuffle files are removed when it ends
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_run_folder: ContextVar[str | None] = ContextVar("run_folder", default=None)


def tune(spark: SparkSession) -> SparkSession:
    """Switch the runtime settings on; static and sizing settings stay the cluster's."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, input_bytes: int) -> SparkSession:
    """Let the number of a shuffle's tasks follow the input, so that what one task holds does not.

    AQE merges partitions but splits only skewed ones: a fixed number of them grows with the tables.
    So shuffles start with one for every INPUT_TO_A_PARTITION bytes of input, if that is more than
    the session has, and AQE merges them up to TASK_BYTES unless the session names a size.
    """
    needed = -(-input_bytes // INPUT_TO_A_PARTITION)
    if needed > int(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL_PARTITIONS, str(needed))
    if spark.conf.get(ADVISORY_BYTES, None) is None:
        spark.conf.set(ADVISORY_BYTES, TASK_BYTES)
    return spark


def input_bytes(spark: SparkSession, path: str) -> int:
    """Bytes stored under ``path``, in any store that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``, or else what the program gave to
    ``SparkContext.setCheckpointDir``. Without either this fails: no folder of
    one machine is ever chosen here.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def use_local_folder(spark: SparkSession) -> SparkSession:
    """For programs that may run on one machine: give a single-process session a folder if it has none.

    The folder is removed when the program ends. A session with executors of
    its own (anything but ``local`` and ``local[...]``) is left as it is.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and (context.master == "local" or context.master.startswith("local[")):
        folder = tempfile.mkdtemp(prefix="cohortloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return spark


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; inside ``scratch`` it goes with that block."""
    return f"{_run_folder.get() or shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Everything materialised inside the block is deleted at its end.

    Results must be written or collected inside the block, as frames are lazy.
    """
    folder = new_path(spark, "run")
    token = _run_folder.set(folder)
    try:
        yield folder
    finally:
        _run_folder.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    For frames used more than once. The copy survives lost executors, is read
    column by column, and its file sizes let Spark choose joins by real size.
    The shuffle files of the write go with it, as nothing reads them again.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    if before is not None:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
