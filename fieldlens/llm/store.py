"""Written intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldlens.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/fieldlens-{uuid.uuid4().hex}/{name}"


#: Spark then deletes the shuffle files of a query as it ends, and not when the driver happens to collect its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back: lineage is cut, and lost executors recompute nothing before it.

    Nothing later reads the shuffles of the write, so they go when it has ended; the session's own setting stands again after that.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._fieldlens_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by ``written`` that no later plan reads."""
    path = getattr(df, "_fieldlens_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
