"""Immutable dataset versions as folders `v{n}` and a version list."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS_SCHEMA = (
    "dataset_id string, version_number int, parent_version int, schema_fingerprint string"
)


def _list(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(VERSIONS_SCHEMA).parquet(f"{root}/versions")
    except Exception as problem:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(problem):
            return spark.createDataFrame([], VERSIONS_SCHEMA)
        raise


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def versions(spark: SparkSession, root: str) -> DataFrame:
    return _list(spark, root)


def write_version(
    spark: SparkSession, root: str, dataset_id: str, tables: Mapping[str, DataFrame],
    parent_version: int | None = None,
) -> int:
    """Write the next version of a dataset; an existing one is never changed.

    The parent has to be a version of the same dataset. Tables are written by the
    executors; the version list gets its row last, so a failed write leaves no version,
    only a folder whose number is not used again.
    """
    from dqloom.operators.counts import column_catalog
    from dqloom.sources.identity import schema_fingerprint

    known = _list(spark, root).filter(F.col("dataset_id") == dataset_id)
    row = known.agg(
        F.max("version_number").alias("top"),
        F.bool_or(F.col("version_number") == F.lit(parent_version)).alias("has_parent"),
    ).first()
    if parent_version is not None and not row["has_parent"]:
        raise ValueError(f"version {parent_version} is not a version of {dataset_id}")
    number = (row["top"] or 0) + 1
    while _exists(spark, f"{root}/{dataset_id}/v{number}"):
        number += 1
    catalog = None
    for i, (name, df) in enumerate(tables.items()):
        df.write.mode("errorifexists").parquet(f"{root}/{dataset_id}/v{number}/{name}")
        part = column_catalog(df, name).withColumn("table_order", F.lit(i))
        catalog = part if catalog is None else catalog.unionByName(part)
    fingerprint = schema_fingerprint(catalog).first()["schema_fingerprint"]
    spark.createDataFrame(
        [(dataset_id, number, parent_version, fingerprint)], VERSIONS_SCHEMA
    ).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return number


def read_version(
    spark: SparkSession, root: str, dataset_id: str, number: int, table: str
) -> DataFrame:
    return spark.read.parquet(f"{root}/{dataset_id}/v{number}/{table}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One corrected table as CSV or Parquet."""
    if fmt == "csv":
        df.write.mode("errorifexists").csv(path, header=True)
    else:
        df.write.mode("errorifexists").format(fmt).save(path)
