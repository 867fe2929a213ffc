"""Sources and sinks: Parquet tables, typed CSV files, partitioned output."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A named table; unknown names are an error."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8", multiline: bool = True) -> DataFrame:
    """A CSV file with a header, an explicit schema and quoted line breaks; a byte-order mark is dropped.

    Spark can only split files without quoted line breaks: say multiline=False for those.
    """
    raw = spark.read.option("header", True).option("encoding", encoding).option("multiLine", multiline).option("escape", '"').option("enforceSchema", True).schema(schema).csv(path)
    first = schema.fields[0].name
    return raw.withColumnRenamed("﻿" + first, first)


def write_parquet(df: DataFrame, path: str, month_of: str | None = None) -> None:
    """Overwrites path; month_of names a timestamp column whose month becomes the partition."""
    out = df.withColumn("month", F.date_format(month_of, "yyyy-MM")) if month_of else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy("month") if month_of else writer).parquet(path)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of each table, in one job."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors must share.

    Where none is set and Spark runs in one process, a temporary folder serves.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='metricwell-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


def state_of(table: DataFrame) -> str:
    """A name for what a table read from files holds now: of all its files' paths, sizes and times, in any order."""
    file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    row = table.select(file.alias("file")).distinct().agg(F.count("*").alias("n"), F.bit_xor("file").alias("files")).first()
    return f"{row['n']}-{(row['files'] or 0) & (1 << 64) - 1:016x}"


def store(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again, so that it is computed once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
