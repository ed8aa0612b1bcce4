"""Session helpers: a local session for tests, table access, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the bench. On a cluster the caller's session is used as it is."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("taxonflow").config("spark.driver.memory", memory)
    merged = {**DEFAULT_CONF, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}
    return builder.config(map=merged).getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    The files outlive any executor, so a lost executor costs a re-read and not a re-run.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where it is unset, a local one in a local session (tests),
    and an error in any other, whose executors could not read it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    return tempfile.mkdtemp(prefix="taxonflow-checkpoint-")


def n_tasks(spark: SparkSession) -> int:
    """Partitions to use where an explicit number is needed: the session's shuffle setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def month_of(column) -> "F.Column":
    return F.date_format(column, "yyyy-MM")
