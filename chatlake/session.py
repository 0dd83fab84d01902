"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "chatlake", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine assumes (UTC, AQE, Arrow); on a cluster the caller brings its own."""
    n = os.cpu_count() or 8 if cores == "*" else int(cores)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    session = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; a parquet file or a directory of parts."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``; only a one-machine session gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master == "local" or sc.master.startswith("local["):
        own = tempfile.mkdtemp(prefix="chatlake-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage; survives the loss of any executor.

    A checkpointed frame keeps the size the optimizer had estimated for its plan. In a loop of joins these estimates multiply
    to numbers of astronomic length, so the rows are wrapped anew, without an estimate; joins are chosen by the sizes AQE sees.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    saved = df.checkpoint(eager=True)
    rows = saved._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, saved._jdf.schema(), False), spark)
