"""Session set-up and helpers that depend on the cluster's settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and bench; on a cluster the caller's own session is used instead."""
    b = (
        SparkSession.builder.master(master)
        .appName("marketweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session on one machine (tests) may leave it unset and gets a temporary folder; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    ctx = spark.sparkContext
    if ctx.getCheckpointDir() is None:
        if not named and not ctx.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        ctx.setCheckpointDir(named or tempfile.mkdtemp(prefix="marketweave-checkpoint-"))
    return ctx.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder among the shared ones, deleted when the application ends."""
    path = f"{shared_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there, for what later steps read by columns or more than once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder; survives the loss of executors."""
    shared_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def small_side(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """``df`` checkpointed, with a broadcast hint if it has at most ``max_rows`` rows.

    The second value tells whether the hint was given; beyond the bound Spark shuffles the side (sort-merge join, with AQE
    splitting skewed partitions), so the result is the same at every size.
    """
    from pyspark.sql import functions as F

    cut = cut_lineage(df)
    small = cut.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(cut) if small else cut), small


def spread(table: DataFrame) -> DataFrame:
    """A table as it was read, over all cores if its files give fewer tasks than there are cores.

    A small file of one row group is one task, however costly what follows, so the columns that are used move once. A table with as
    many splits as the session has cores is left as it is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session's executors, once per application."""
    import shutil
    from pathlib import Path

    ctx = spark.sparkContext
    if getattr(ctx, "_marketweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="marketweave-")) / "marketweave_pkg"), "zip", root.parent, root.name)
    ctx.addPyFile(archive)
    ctx._marketweave_shipped = True
