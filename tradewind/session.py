"""Session settings the jobs rely on, and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import math
import shutil
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

TARGET_PARTITION_BYTES = 128 * 1024 * 1024
# Of stored input, whose rows take many times the room once they are sorted and hashed.
SHUFFLE_PARTITION_BYTES = 16 * 1024 * 1024

# Splitting a hot join partition pays for itself even when a later aggregate on the
# same key then needs its own exchange, hence the forced skew join.
_RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small partitions are merged by their compressed size. Keys compress a hundredfold, and a task may
    # sort and hash them for several joins, so what is merged is kept small whatever the table's size.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply the runtime settings; with `input_bytes`, also size the shuffles for that input.

    The shuffle width only ever grows: adaptive execution merges partitions that turn out
    small, but cannot add any.
    """
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    if input_bytes is not None:
        wanted = math.ceil(input_bytes / SHUFFLE_PARTITION_BYTES)
        if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    # A local session, as in tests: its tables go with it.
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    named = f"{warehouse}/tradewind-{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", named)
    if warehouse.startswith("file:/"):
        atexit.register(shutil.rmtree, "/" + named.removeprefix("file:").lstrip("/"), ignore_errors=True)
    return named


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tradewind/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read, and gives Catalyst the real
    size of the result.
    """
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.written_path = path
    if (job := _job_tables.get()) is not None:
        job.append(written)
    return written


_REMOVES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it has ended, not when the driver next collects its garbage.

    For steps that write one large table after another. A DataFrame that is run twice within shuffles twice.
    """
    before = spark.conf.get(_REMOVES_SHUFFLES, None)
    spark.conf.set(_REMOVES_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVES_SHUFFLES)
        else:
            spark.conf.set(_REMOVES_SHUFFLES, before)


# Tables of the job this thread works for; None outside of `scratch`.
_job_tables: ContextVar[list[DataFrame] | None] = ContextVar("job_tables", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes at its end what `materialize` wrote within, also in steps run `side_by_side`.

    For jobs whose results are stored elsewhere by then. If the job fails, the tables go as well.
    """
    token = _job_tables.set([])
    try:
        yield
    finally:
        tables = _job_tables.get()
        _job_tables.reset(token)
        discard(*tables)


Result = TypeVar("Result")


def side_by_side(
    spark: SparkSession, label: str, steps: Sequence[Callable[[], Result]], at_once: int = 8
) -> list[Result]:
    """Results of steps that do not depend on each other, in order; `at_once` of them share the cluster.

    Each step's Spark jobs form a job group of their own. If a step fails, steps not yet begun are
    dropped, the groups of the running ones are cancelled, and its error is raised.
    """
    context, run = spark.sparkContext, uuid.uuid4().hex

    def in_group(number: int) -> Result:
        context.setJobGroup(f"{label}-{run}-{number}", f"{label} {number + 1} of {len(steps)}", interruptOnCancel=True)
        return steps[number]()

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        # Each thread carries on this one's Spark properties and scratch tables.
        begun = [pool.submit(copy_context().run, inheritable_thread_target(spark)(in_group), n) for n in range(len(steps))]
        done, running = wait(begun, return_when=FIRST_EXCEPTION)
        failed = next((step for step in begun if step in done and step.exception()), None)
        if failed is not None:
            for step in begun:
                step.cancel()
            while running:  # a step may be about to start its next job
                for number, step in enumerate(begun):
                    if not step.done():
                        context.cancelJobGroup(f"{label}-{run}-{number}")
                _, running = wait(running, timeout=0.2)
            raise failed.exception()
    return [step.result() for step in begun]


def discard(*tables: DataFrame) -> None:
    """Remove tables that `materialize` wrote, once all that was made from them is written itself."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
