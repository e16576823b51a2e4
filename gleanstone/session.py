"""A session with the settings that the engine expects."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


def _has_master(conf: dict[str, str]) -> bool:
    """Whether a master comes from conf, a running session, spark-submit, the environment or the defaults file."""
    named = ("PYSPARK_GATEWAY_PORT", "SPARK_MASTER", "MASTER", "SPARK_REMOTE")  # the first is set by spark-submit
    if "spark.master" in conf or SparkSession.getActiveSession() or any(n in os.environ for n in named) or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        return True
    folder = os.environ.get("SPARK_CONF_DIR") or os.path.join(os.environ.get("SPARK_HOME", ""), "conf")
    try:
        with open(os.path.join(folder, "spark-defaults.conf")) as f:
            return any(line.split()[:1] == ["spark.master"] or line.startswith("spark.master=") for line in f)
    except OSError:
        return False


def session(name: str = "gleanstone", cores: str | int = "*", partitions: int | None = None, **conf: str) -> SparkSession:
    """Times are UTC; adaptive execution and runtime filters are on. The master and checkpoint folder come from the cluster's own configuration; only where no master is configured is it local."""
    builder = SparkSession.builder.appName(name)
    if not _has_master(conf):
        builder = builder.master(f"local[{cores}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}),
        **conf,
    }
    return builder.config(map=settings).getOrCreate()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Arrow batches of so many rows at most, so that a batch of long texts fits a Python worker, for what is run meanwhile; then the session's setting holds again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(min(rows, int(before or rows)) if int(before or rows) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which all executors share.

    Where that is unset, a session with a local master (tests) gets a temporary folder; any other raises an error, as executors would not see each other's files.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = _OWN.setdefault(context.applicationId, "")
        if not top:
            top = _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="gleanstone-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
