"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def materialised(df: DataFrame) -> DataFrame:
    """df written to and read from the folder in spark.checkpoint.dir; where it is unset (tests), one of its own."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="authspan-")
        root = _own[app]
    path = f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a table of materialised(), which nothing may read any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._table)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
