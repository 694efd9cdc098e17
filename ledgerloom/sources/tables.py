"""Reading delimited and columnar tables under fixed schemas, and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Empty(ValueError):
    """A table that must have rows has none."""


def scan_csv(spark: SparkSession, path: str, columns: list[str], optional: bool = False, required: bool = False, row_number: str | None = None) -> DataFrame:
    """All ``columns`` as text, by header name; a column the file lacks is null. A missing optional file is an empty table.

    ``row_number`` names a column that counts the records of each file from 1, in the file's order; a file is one split then.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + ([T.StructField(row_number, T.LongType())] if row_number else []))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if optional and not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    names = {n.lstrip("﻿").strip().lower(): n for n in raw.columns}
    if row_number:
        places = Window.partitionBy("_file").orderBy("_at")
        raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at")).withColumn("_row", F.row_number().over(places).cast("long"))
    df = raw.select(*[(F.col(f"`{names[c.lower()]}`") if c.lower() in names else F.lit(None)).cast("string").alias(c) for c in columns], *([F.col("_row").alias(row_number)] if row_number else []))
    if required and df.isEmpty():
        raise Empty(path)
    return df


def read_any(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Parquet, ORC, JSON, text or binary files; JDBC and others by their Spark names."""
    reader = spark.read.format({"binary": "binaryFile"}.get(kind, kind)).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key occurs once, (keys, n) of keys that occur more often)."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    r = repeated.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    on = [df[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return df.join(r, on, "left_anti"), repeated


def header(df: DataFrame, name: str, value: str, names: list[str]) -> DataFrame:
    """One row from name-value rows; the least value where a name is repeated, null where it is missing."""
    return df.agg(*[F.min(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def keyword_totals(df: DataFrame, rule: Column, value: Column) -> DataFrame:
    """(measure, n, total) by the first keyword rule that holds; rows of no rule have a null measure."""
    return df.groupBy(rule.alias("measure")).agg(F.count("*").alias("n"), F.sum(value).cast("decimal(18,2)").alias("total"))


def first_record(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(1)


def content_hash(*columns: str) -> Column:
    """First 16 hex digits of the SHA-256 of the columns' texts."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *columns), 256), 1, 16)


def surrogate(prefix: str, width: int, *order: str) -> Column:
    """``PREFIX0001`` by the order of rows; for small tables, as it numbers all rows in one task."""
    return F.concat(F.lit(prefix), F.lpad(F.row_number().over(Window.orderBy(*order)).cast("string"), width, "0"))


def template(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def write_tabs(tables: dict[str, DataFrame], folder: str, kind: str = "parquet", status: str = "") -> dict[str, str]:
    """Every table as a folder of its own, named with the status (``[DOES NOT TIE]`` becomes ``.DOES_NOT_TIE``); the paths by name."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}" + (f".{status.strip('[]').replace(' ', '_')}" if status else "")
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv(paths[name]) if kind == "csv" else writer.format(kind).save(paths[name]))
    return paths


def carry_forward(items: DataFrame, worklist: DataFrame | None, key: str, columns: list[str]) -> DataFrame:
    """``items`` with the ``columns`` that a worklist of the run before has for their key, and ``periods``, how many runs an item is open.

    A worklist is what an earlier run wrote of this function's result; without one every item is new. A key that a worklist
    has several times takes its least row.
    """
    if worklist is None:
        return items.select("*", *[F.lit(None).cast("string").alias(c) for c in columns], F.lit(1).alias("periods"))
    old = worklist.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_old"), F.max("periods").alias("_periods"))
    return items.join(old, key, "left").select(*[items[c] for c in items.columns], *[F.col(f"_old.{c}").alias(c) for c in columns], (F.coalesce("_periods", F.lit(0)) + 1).alias("periods"))
