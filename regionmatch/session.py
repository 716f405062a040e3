"""Session settings and lineage cuts shared by the iterative operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter supplies its own."""
    return (
        SparkSession.builder.master(master)
        .appName("regionmatch")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


_OWN: list[str] = []
_WRITTEN: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; in local mode, where that is unset, a temporary
    folder that goes when the process ends."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, which ``drop_written`` deletes."""
    path = f"{scratch_root(spark)}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def drop_written(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that were written to the shared folder so far (all but the first ``since`` of those that are
    there); call it when results have been taken."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while len(_WRITTEN) > since:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Unlike ``DataFrame.checkpoint`` this computes the input once, survives the loss of
    executors, and gives the optimizer true sizes for the joins that follow.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at the end, and the shuffle files of each step when its table is written."""
    mark, before = len(_WRITTEN), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
        drop_written(spark, mark)


def settled(spark: SparkSession, build: Callable[[], Sequence[DataFrame]]) -> list[DataFrame]:
    """Write the tables ``build`` returns and delete those it wrote on the way; nothing else of it may be read later."""
    with passing_tables(spark):
        out = [cut_lineage(df) for df in build()]
        kept = _WRITTEN[-len(out):]
        del _WRITTEN[-len(out):]
    _WRITTEN.extend(kept)
    return out


def by_shuffle(df: DataFrame) -> DataFrame:
    """Mark a side whose rows were multiplied by an explode: its size estimate is that of its
    source, so it must not be picked for a broadcast."""
    return df.hint("merge")


def join_measured(big: DataFrame, small: DataFrame, on: list[str] | str, max_rows: int = 1_000_000) -> DataFrame:
    """Inner join that broadcasts ``small`` only after counting it; beyond the bound both sides shuffle."""
    from pyspark.sql import functions as F

    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on)
    return by_shuffle(big).join(small, on)
