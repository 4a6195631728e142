"""Tables that a job writes between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``. Where that is unset a temporary folder stands in, but
    only with a local master: on a cluster executors could not read each other's files."""
    app, base = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tracewright-scratch-"))
    return f"{base.rstrip('/')}/tracewright-{app}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: evaluated one time, and later steps no longer depend on its lineage."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> bool:
    """Delete all tables that ``materialize`` wrote for this application; DataFrames that still read them fail afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
