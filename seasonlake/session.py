"""Session defaults and the one place that decides where checkpoints go."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, name: str = "seasonlake", **conf: str) -> SparkSession:
    """Session with the library defaults; explicit ``conf`` wins.

    On a cluster leave ``master`` unset (spark-submit provides it) and size
    ``spark.sql.shuffle.partitions`` from the data; AQE coalesces what is too many.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is only ever chosen in local mode, where there is one machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path of its own beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Spark's switch that frees the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Sides of a join that are broadcast: none by the size of its files, some by what they measure.
MEASURED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "2MB"}
_lock = threading.Lock()
_set: dict[tuple[str, ...], tuple[int, dict[str, str | None]]] = {}
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def _while_set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that hold until the last of overlapping calls ends, in whatever threads."""
    key = tuple(settings)
    with _lock:
        calls, before = _set.get(key, (0, {}))
        if not calls:
            before = {name: spark.conf.get(name, None) for name in settings}
            for name, value in settings.items():
                spark.conf.set(name, value)
        _set[key] = calls + 1, before
    try:
        yield
    finally:
        with _lock:
            calls, before = _set.pop(key)
            if calls > 1:
                _set[key] = calls - 1, before
            else:
                for name, value in before.items():
                    spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffles_freed(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries that end inside leave no shuffle files; otherwise these stay until the
    driver happens to collect its garbage. Calls may overlap in threads."""
    return _while_set(spark, {CLEANUP: "true"})


def sizes_measured(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries planned inside broadcast a side of a join only once it has been shuffled and
    is known to be small. The size of its files tells little: stored keys may take a thirtieth
    of what their rows take on the driver, and one plan may broadcast ten such sides."""
    return _while_set(spark, MEASURED)


def pinned(df: DataFrame) -> DataFrame:
    """Write the frame once to the shared checkpoint folder and read it back.

    The plan is evaluated once (``checkpoint()`` would run its last stage twice), later
    readers see the same rows whatever executors are lost, and the stored columns can
    be pruned and their size is known when joins are planned. What the plan shuffled is
    not needed any more and goes.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "pinned")
    with shuffles_freed(spark):
        df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def unpinned(*frames: DataFrame) -> None:
    """Delete what ``pinned`` stored for frames that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(_folders.pop(df))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
