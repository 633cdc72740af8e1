"""Tables in the shared checkpoint folder: lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode a temporary folder is set if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.lexarium.scratch", None)
    if found:
        return found.rstrip("/")
    if not ((spark.sparkContext.master or "") + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="lexarium-")
    spark.conf.set("spark.lexarium.scratch", found)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used, to be freed by ``release``."""
    path = f"{shared_dir(spark)}/lexarium/{uuid.uuid4().hex}-{label}"
    _WRITTEN.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back: the plan starts anew from the files."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Where the list of written tables ends now, for ``release``."""
    return len(_WRITTEN)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> int:
    """Delete what ``written`` wrote in this process between two marks; to be called once no DataFrame that reads it is needed.
    Returns how many tables went. Later marks count from the shortened list."""
    gone = 0
    paths = _WRITTEN[since:until]
    del _WRITTEN[since:until]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        with contextlib.suppress(Exception):  # the folder may be gone with its session
            gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone
