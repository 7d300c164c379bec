"""Session factory and the helpers every module shares: table access, the meaning of "missing", the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.schema import EngineError

#: Characters that count as blanks around a line, a field or a value.
BLANKS = " \t\r\n\f\v"


def build_session(app: str = "grainmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; `conf` keys use `__` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a checkpoint folder the session was given.

    Only a local session, whose executors all are on this machine, gets a folder of its own where none is set; on a cluster
    that is an error, because a machine-local folder would differ from executor to executor.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise EngineError("set spark.checkpoint.dir to a folder that all executors share")
        given = os.path.join(tempfile.gettempdir(), f"grainmill-{uuid.uuid4().hex[:8]}")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def clean(c: Column | str) -> Column:
    """A string with the blanks around it removed; NULL when nothing or `\\N` is left."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c, F.lit(BLANKS))
    return F.when((t != "") & (t != "\\N"), t)


def clean_num(c: Column | str) -> Column:
    """A double that is NULL where the value is NULL or NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
