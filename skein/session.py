"""Sessions, partition counts and durable cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "skein") -> SparkSession:
    """A session for one machine; on a cluster use the one the cluster gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and read it back, so that later steps neither repeat nor depend on what made it.

    The folder is the one the cluster names in spark.checkpoint.dir. Where that is unset a folder of this machine is used if
    the session is local, as in tests; on a cluster that is an error.
    """
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, for tables that later steps read."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder in use; it is set where it isn't yet."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def spread(df: DataFrame, *keys: str, least: int | None = None) -> DataFrame:
    """Rows dealt over enough tasks for a CPU-bound step, if the scan gives too few of them.

    For scans only: the number of tasks of a plan with a shuffle is known after it ran. A scan of a large table has many
    splits already and stays as it is; a small or badly split one is dealt by the hash of its keys, which is stable when
    a task is repeated.
    """
    want = least or 3 * df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by the hash of their keys over enough tasks for a CPU-bound step, in a number that adaptive execution
    keeps; a later grouping by the keys needs no further shuffle."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)
