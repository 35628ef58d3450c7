"""Session settings and the checkpoint folder used to cut long lineages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "laborlens", shared: str | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session.

    ``shared`` is the folder for checkpoints and the warehouse.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", f"{shared}/checkpoints").config("spark.sql.warehouse.dir", f"{shared}/warehouse")
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: what ``spark.checkpoint.dir`` names, else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints").rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder, never to a machine-local one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_root(spark))


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the place that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Share the rows of a table with too few file splits among all cores.

    A small file is one row group and so one busy task, however heavy the text work on it. Tables
    with at least one split per core are returned as they are: nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, df.columns[0])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss, unlike a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
