"""Writing and reading tables of a run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share; on a local master (tests) an own one will do."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="skywave-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and does not depend on any executor."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_run(tables: dict[str, DataFrame], root: str) -> None:
    """The tables of a run (boxes, components, chunks, thresholds), each by capture; a capture that is written again
    replaces what was there."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("capture_id").parquet(f"{root}/{name}")


def write_metrics(df: DataFrame, path: str) -> None:
    """A metric table as CSV with a header; null fields are empty and numbers that are none are `nan`."""
    text = [F.when(F.isnan(c.name), F.lit("nan")).otherwise(F.col(c.name).cast("string")).alias(c.name) if c.dataType.typeName() in ("double", "float") else F.col(c.name) for c in df.schema]
    df.select(*text).write.mode("overwrite").csv(path, header=True)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A metric table from CSV; empty fields are null and `nan` is a number."""
    return spark.read.csv(path, header=True, schema=schema, nanValue="nan")
