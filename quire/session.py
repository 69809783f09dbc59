"""Session helpers: builder, shared checkpoint folder, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Session key: tasks that an input of few, large splits is dealt out to. Unset, inputs are read as they are.
INPUT_TASKS = "quire.input.tasks"


def build_session(
    app: str = "quire", master: str | None = None, shuffle_partitions: int | None = None, input_tasks: int | None = None,
    arrow_rows: int | None = None,
) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE stays on everywhere: it coalesces small shuffles, splits skewed join partitions and
    re-plans joins by the sizes it has seen. ``input_tasks`` is for inputs whose files are single
    row groups (see ``spread``); ``arrow_rows`` bounds Arrow batches where single values are large.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Call-site capture costs more than planning for large column expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if input_tasks:
        builder = builder.config(INPUT_TASKS, str(input_tasks))
    if arrow_rows:
        builder = builder.config("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow_rows))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: ``spark.checkpoint.dir``, or the folder given to ``setCheckpointDir``.

    Where neither is set, a session on one machine gets a temporary folder, once, as its checkpoint
    folder; on a cluster that would be a folder the other machines cannot read, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    given = context.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


_WRITTEN: list[str] = []


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder that ``clear_scratch`` knows of."""
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def settle(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files, with one folder for each value of ``by``.

    Used after model calls (never pay for an answer twice, even if an executor
    is lost) and between the rounds of an iterative operator.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    settled.scratch = path
    return settled


def discard_folder(settled: DataFrame, by: str, value: str) -> None:
    """Delete the rows of one value of ``by``, which no later step reads, from a table settled in folders."""
    spark = settled.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{settled.scratch}/{by}={value}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """``settings`` hold for what is run inside."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def arrow_batches(spark: SparkSession, size: int):
    """Arrow batches of at most about ``size`` bytes for what is written inside: Python workers then hold little of long rows."""
    return configured(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(size)})


def single_use(spark: SparkSession):
    """For tables that are settled inside: files of their shuffles go as soon as a table is written, and a table in folders
    (``by``) is written without a sort, as one open file for each folder and task."""
    return configured(
        spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "8"}
    )


def written() -> list[str]:
    """Folders that ``settle`` has written and nobody has deleted."""
    return list(_WRITTEN)


def clear_scratch(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete settled folders (all, by default) once no result that reads them is needed; returns the count."""
    done = 0
    for name in written() if paths is None else paths:
        if name in _WRITTEN:
            _WRITTEN.remove(name)
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            done += bool(files.delete(path, True))
    return done


def discard(*settled: DataFrame) -> None:
    """Delete settled tables that no later step reads."""
    for df in settled:
        clear_scratch(df.sparkSession, [df.scratch])


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out to as many tasks as the session asks for in ``quire.input.tasks``.

    For row-local work on files of a single row group, which no reader can split. Unset, as on a
    cluster with ordinary files, the input is read as it is and nothing is shuffled.
    """
    tasks = df.sparkSession.conf.get(INPUT_TASKS, None)
    return df.repartition(int(tasks)) if tasks else df
