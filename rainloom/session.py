"""Session helpers: a tuned builder, table loading and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings every session of the engine starts from; a cluster's own settings win.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "rainloom", cores: int | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session that exists."""
    builder = SparkSession.builder.appName(app)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add (or replace) ``columns`` in a step that the optimiser does not merge with its neighbours.

    Long chains of parsing expressions grow exponentially when projections collapse and predicates are
    pushed through them; a generator of one row keeps every step computed once.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the folder in ``spark.checkpoint.dir``.

    The folder is read from the session, as executors must share it. Only where it is unset (a local
    test session) a temporary folder of this machine is set.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "rainloom-checkpoints")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
