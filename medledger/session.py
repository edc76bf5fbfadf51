"""Spark session helpers.

The library never decides cluster sizing; it only reads settings from the
active session. ``local_session`` exists for tests, the bench and the
driver's smoke check.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "medledger") -> SparkSession:
    """A local session for tests and benches: AQE on, UI off, UTC clock."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.files.minPartitionNum", str(max(4, shuffle_partitions)))
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder the cluster names.

    Reads ``spark.checkpoint.dir`` (or a folder already set on the context).
    Only a local-mode session without one gets a fresh scratch folder; on a
    cluster a missing setting is an error, because a machine-local folder
    would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if re.fullmatch(r"local(\[[^\]]*\])?", sc.master):  # one process; local-cluster[...] has machines of its own
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="medledger-ckpt-"))
        return sc.getCheckpointDir()
    raise ValueError("set spark.checkpoint.dir to a shared folder before running iterative operators")


class _Scopes(threading.local):
    """The scopes open in a thread: two streams run their batches in two threads at once."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``cut_lineage`` writes (and other scratch folders) inside the block when it ends.

    Results built inside must be written or collected before the block ends: they
    read these tables lazily. Scopes belong to the thread that opens them and may be nested.
    """
    written: list[str] = []
    _scopes.open.append(written)
    try:
        yield
    finally:
        _scopes.open[:] = [s for s in _scopes.open if s is not written]
        jvm = spark.sparkContext._jvm
        for path in written:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under the shared checkpoint folder; an open scope of ``intermediate_tables`` removes it at its end."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"
    if _scopes.open:
        _scopes.open[-1].append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    One job computes the plan once (``Dataset.checkpoint`` would compute it a
    second time to write it). The files live under ``spark.checkpoint.dir``,
    so the result survives the loss of an executor, and the scan gives AQE
    real sizes. Never a local checkpoint.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "medledger-tables")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
