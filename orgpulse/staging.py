"""Tables written once and read many times.

Multi-pass statistics should not derive their input again on every pass, and executors may be lost
between passes. Staged data therefore goes to parquet in the shared folder that the cluster names in
`spark.checkpoint.dir` (where that is unset, in the session's warehouse folder, which is shared too);
readers get column pruning and filter pushdown, and no lineage. `release` removes what an application
has staged, and runs by itself when the Python process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import math
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

# Bytes of the input files that a partition of a shuffle stands for.
BYTES_PER_PARTITION = 2_000_000
PARTITIONS = "spark.sql.shuffle.partitions"

_shared: dict[tuple, tuple[DataFrame, list[str]]] = {}
_paths: dict[str, list[str]] = {}


def staging_root(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def keep_until_release(spark: SparkSession, path: str) -> None:
    """Let `release` delete a folder that the caller writes."""
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the staging folder and read it back."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/orgpulse/{name}-{uuid.uuid4().hex}"
    keep_until_release(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables this application has staged, those after the first `since` ones. Frames
    that read them can no longer be evaluated."""
    paths = _paths.get(spark.sparkContext.applicationId, [])
    for path in paths[since:]:
        _delete(spark, path)
    gone = set(paths[since:])
    del paths[since:]
    for key in [k for k, (_, held) in _shared.items() if gone.intersection(held)]:
        del _shared[key]


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # the JVM may have ended first
            release(spark)


def modified(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Modification times of files or folders, and of the files in such folders."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    times = []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        if fs.exists(at):
            times += sorted((s.getPath().toString(), s.getModificationTime(), s.getLen()) for s in fs.listStatus(at))
    return tuple(times)


@contextlib.contextmanager
def partitions_by_size(spark: SparkSession, inputs: Sequence[str]) -> Iterator[None]:
    """Shuffles planned inside have a partition for every `BYTES_PER_PARTITION` of the files in `inputs`, or the
    session's number where that is more. A fixed number lets every sort, join and aggregate of a task grow with the
    tables until it spills; adaptive execution joins what turns out small."""
    former = spark.conf.get(PARTITIONS)
    needed = math.ceil(sum(size for _, _, size in modified(spark, inputs)) / BYTES_PER_PARTITION)
    if needed <= int(former):
        yield
        return
    spark.conf.set(PARTITIONS, str(needed))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, former)


def staged_once(
    spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], inputs: Sequence[str] = ()
) -> DataFrame:
    """The staged table `name` of `source`, built once per Spark application and state of the files
    in `inputs`: a table that changes under the same path is staged anew."""
    app = spark.sparkContext.applicationId
    key = (app, source, name, modified(spark, inputs))
    if key not in _shared:
        before = len(_paths.get(app, []))
        with partitions_by_size(spark, inputs):
            frame = stage(build(), name)
        _shared[key] = (frame, _paths[app][before:])
    return _shared[key][0]


def forget(source: str | None = None) -> None:
    """Drop the memory of staged tables, so that the next plan builds them again."""
    for key in [k for k in _shared if source is None or k[1] == source]:
        del _shared[key]
