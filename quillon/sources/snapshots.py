"""Several tables committed as one version: all are written first, the manifest row last."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version bigint, name string, rows bigint"


def _manifests(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """Manifests there are, read from the one folder; null before the first commit."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    found = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return found if version is None else found.filter(F.col("version") == version)


def latest_version(spark: SparkSession, folder: str) -> int | None:
    found = _manifests(spark, folder)
    return None if found is None else found.agg(F.max("version")).first()[0]


def commit(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame]) -> int:
    """Writes every table under the next version, then its manifest in one file. A run that stops before leaves the last
    version as it was; its files are written over by the next run."""
    version = (latest_version(spark, folder) or 0) + 1
    counts = []
    for name, df in tables.items():
        path = f"{folder}/{name}/version={version}"
        df.write.mode("overwrite").parquet(path)
        counts.append((version, name, spark.read.parquet(path).count()))
    spark.createDataFrame(counts, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return version


def read(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a committed version, the latest by default."""
    at = version or latest_version(spark, folder)
    if at is None or _manifests(spark, folder, at).filter(F.col("name") == name).isEmpty():
        raise ValueError(f"{name} has no committed version {at} in {folder}")
    return spark.read.parquet(f"{folder}/{name}/version={at}")
