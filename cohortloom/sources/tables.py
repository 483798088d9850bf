"""Tables in and out. Configuration is data: partition columns of the result, not folder names that
a typo silently misses."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, schema=None, key: str | None = None, fmt: str | None = None) -> DataFrame:
    """Parquet or delimited table with an explicit schema. With ``key``, a row without one stops the
    job; without it such rows are kept."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".tsv", ".txt")) else "parquet")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",")
    df = reader.load(path)
    if not key:
        return df
    there = F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.raise_error(F.lit(f"{path}: a row without {key}")))
    return df.withColumn(key, there)


def read_cube(spark: SparkSession, path: str, cohort: DataFrame, key: str, schema=None) -> DataFrame:
    """Per-subject matrices as one table; subjects of the cohort without data appear with NULLs."""
    return cohort.select(key).join(read_table(spark, path, schema), key, "left")


def to_long(df: DataFrame, keys, vec: str, index: str = "parcel", value: str = "value") -> DataFrame:
    """One row per cell of an array column."""
    return df.select(*keys, F.posexplode(F.col(vec).cast("array<double>")).alias(index, value))


def split_delay(df: DataFrame, keys, index: str, n_features: int, value: str) -> DataFrame:
    """Delay-stacked index to (delay number, feature number)."""
    return df.select(
        *keys, F.floor(F.col(index) / n_features).cast("int").alias("delay_id"), (F.col(index) % n_features).cast("int").alias("feature_id"), value
    )


def melt_frames(df: DataFrame, keys, frames, name: str = "frame", value: str = "x") -> DataFrame:
    return df.unpivot(list(keys), list(frames), name, value)


def pivot_frames(df: DataFrame, keys, name: str, value: str, frames) -> DataFrame:
    return df.groupBy(*keys).pivot(name, list(frames)).agg(F.sum(value))


def write_result(df: DataFrame, path: str, config: dict, mode: str = "error") -> None:
    """Write a result below its configuration, as partition columns."""
    out = df.withColumns({k: F.lit(v) for k, v in config.items()})
    writer = out.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*config).parquet(path)


def read_result(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """Result of exactly this configuration; a configuration that was never written is an error."""
    df = spark.read.parquet(path)
    for k, v in config.items():
        df = df.filter(F.col(k) == F.lit(v))
    if df.isEmpty():
        raise LookupError(f"no result for {config}")
    return df.drop(*config)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """Read the finished result at ``path``, or build and write it first."""
    if overwrite or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _key(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:32]


def committed(spark: SparkSession, path: str, config: dict) -> str | None:
    """What the finished result of this configuration was made from; None if there is none."""
    record = f"{path.rstrip('/')}_commits/{_key(config)}"
    p, fs = _files(spark, f"{record}/_SUCCESS")
    return spark.read.parquet(record).first()["inputs"] if fs.exists(p) else None


def materialize_config(spark: SparkSession, path: str, config: dict, inputs: str, build: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The result of one configuration below ``path``, built if it is absent, was made from other ``inputs``, or on
    request; results of other configurations are not touched.

    ``inputs`` names what the result depends on (versions, checksums). A commit record is written after the data and
    removed before they are replaced, so a build that was cut off is built again.
    """
    path = path.rstrip("/")
    record = f"{path}_commits/{_key(config)}"
    if overwrite or committed(spark, path, config) != inputs:
        at, fs = _files(spark, record)
        fs.delete(at, True)
        out = build().withColumns({k: F.lit(v) for k, v in config.items()})
        # Only the partition that the rows belong to is replaced; an empty result leaves an empty partition.
        if out.isEmpty():
            old, fs = _files(spark, "/".join([path, *(f"{k}={v}" for k, v in config.items())]))
            fs.delete(old, True)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*config).parquet(path)
        spark.createDataFrame([(json.dumps(config, sort_keys=True), inputs)], "config string, inputs string").coalesce(1).write.mode("overwrite").parquet(record)
    found = spark.read.parquet(path)
    for k, v in config.items():
        found = found.filter(F.col(k) == F.lit(v))
    return found.drop(*config)


def write_csv(df: DataFrame, path: str) -> None:
    """Small report as one delimited file."""
    df.coalesce(1).write.mode("error").option("header", True).csv(path)
