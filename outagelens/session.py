"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: rows of an hourly table that a shuffle partition holds, about
PARTITION_ROWS = 250_000
#: bytes of the files, or of the shuffled rows merged by AQE, that a task of an hourly table reads: such rows are mostly nulls and
#: repeats, some 3 to 40 bytes there and over a kilobyte in the sorts of a task
TASK_BYTES = 4 << 20
#: bytes of a generated function that HotSpot still compiles: a larger one, as wide rows give, is interpreted, several times slower than
#: the same operators without whole-stage code
METHOD_BYTES, _METHOD_LIMIT = 8000, "spark.sql.codegen.hugeMethodLimit"
_DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": os.environ.get("OUTAGELENS_TZ", "UTC"),
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "outagelens") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in _DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("OUTAGELENS_DRIVER_MEM", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a folder that all executors share, and is used as is.
    Only with a local master may it be unset; a scratch folder is then created for the session.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="outagelens-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def _lowered(spark: SparkSession, name: str, most: int) -> None:
    """The session's setting ``name``, a size, set to ``most`` bytes unless it is less."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))


def room_for(spark: SparkSession, rows: int) -> int:
    """The session's number of shuffle partitions, raised (never lowered) to one for each ``PARTITION_ROWS`` of ``rows``.

    With a fixed number a task's rows grow with the input. AQE merges partitions that turn out small. For more rows than
    one partition's, files and merged partitions are read by ``TASK_BYTES`` at most, and functions that the JVM's compiler leaves alone
    are not generated (settings of the session, lowered where higher)."""
    if rows > PARTITION_ROWS:
        if int(spark.conf.get(_METHOD_LIMIT)) > METHOD_BYTES:
            spark.conf.set(_METHOD_LIMIT, str(METHOD_BYTES))
        for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
            _lowered(spark, name, TASK_BYTES)
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    need = -(-rows // PARTITION_ROWS)
    if need > now:
        spark.conf.set("spark.sql.shuffle.partitions", str(need))
    return max(now, need)


def materialised(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as parquet to the shared folder and read back.

    For a table that feeds several branches: it cuts the lineage, survives lost executors, keeps column
    pruning and leaves no cached blocks behind in the session. Nor does it leave shuffle files."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/outagelens-{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        # doubles take less room than with the default codec
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions started within remove their shuffle files at their end, not when the driver next collects garbage, which may be
    after the fits that read their result (a setting of the session, put back as it was)."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` from a written table (a ``checkpoint()`` would compute it twice and keep rows whole)."""
    return materialised(df, "lineage")


def release(spark: SparkSession) -> None:
    """Drop whatever the session has cached (no operator leaves cached blocks behind)."""
    spark.catalog.clearCache()
