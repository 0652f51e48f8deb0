"""Sources and sinks of observations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import CLOUD_TYPE, FILL_FLAG, label_of
from ..operators.filters import filtered
from .footers import schema_audit  # noqa: F401

FORMATS = ("parquet", "csv", "orc", "json")


def node_files(spark: SparkSession, folder: str, pattern: str = "nodo_*.parquet") -> DataFrame:
    """Parquet files of single nodes as one table; nodo_id from the file name nodo_<id>_..."""
    df = spark.read.option("pathGlobFilter", pattern).option("mergeSchema", True).parquet(folder)
    return df.withColumn("nodo_id", F.regexp_extract(F.col("_metadata.file_name"), r"nodo_(\d+)_", 1).cast("int"))


def node_dimension(spark: SparkSession, path: str, schema: str = "nodo_id int, latitude double, longitude double, msnm double") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


PER_NODE = ("location_id", "latitude", "longitude", "elevation")  # fixed names: header fields that change between nodes


def payload_table(spark: SparkSession, folder: str, schema: str, header: str = "cambian") -> DataFrame:
    """Payload texts as typed rows: file, the columns of `schema` by their tidied names (text that does not fit its type is an error),
    and `header`: all fields ("todos") or those that change between nodes ("cambian")."""
    if header not in ("todos", "cambian"):
        raise ValueError(f"unknown header mode {header!r}")
    rows = payloads(spark, folder)
    fields = StructType.fromDDL(schema)
    names = F.transform("columns", lambda c: F.regexp_replace(F.lower(F.trim(c)), " ", "_"))
    cells = rows.withColumn("cells", F.map_from_arrays(names, "values"))
    kept = F.col("header") if header == "todos" else F.map_filter("header", lambda k, _: k.isin(*PER_NODE))
    return cells.select("file", kept.alias("header"), *(F.nullif(F.trim(F.try_element_at("cells", F.lit(f.name))), F.lit("")).cast(f.dataType).alias(f.name) for f in fields))


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(file, header map, columns, values) rows of payload texts: names, header values, column names, then one line per hour."""
    raw = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split(F.rtrim("value"), "\r?\n").alias("lines"))
    names = F.transform(F.split(F.get("lines", F.lit(0)), ","), lambda c: F.regexp_replace(F.lower(F.trim(c)), "[ -]", "_"))
    header = F.map_from_arrays(names, F.split(F.get("lines", F.lit(1)), ","))
    return raw.where(F.size("lines") > 3).select("file", header.alias("header"), F.split(F.get("lines", F.lit(2)), ",").alias("columns"), F.explode(F.slice("lines", F.lit(4), F.size("lines") - 3)).alias("line")).where(F.trim("line") != "").select("file", "header", "columns", F.split("line", ",").alias("values"))


def matrix_rows(matrix: DataFrame, step: str = "vec_id", values: str = "embedding", scale: float = 1.0, steps: tuple | None = None) -> DataFrame:
    """A (time x node) matrix, one row per step, as long rows (step, nodo_id, value / scale); steps: an inclusive range."""
    if steps:
        matrix = matrix.where(F.col(step).between(*steps))
    return matrix.select(F.col(step).alias("step"), F.posexplode(values).alias("nodo_id", "value")).withColumn("value", F.col("value").cast("double") / scale)


def dataset_info(df: DataFrame) -> DataFrame:
    """One row of a table that is read from files: files, bytes, rows, and its columns with their types."""
    per = df.groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count("*").alias("rows"))
    types = F.array(*(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")) for f in df.schema))
    return per.agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.sum("rows").alias("rows")).withColumn("columns", types)


def schema_difference(spark: SparkSession, a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, side) of columns that only one table has."""
    rows = [(c, "a") for c in a.columns if c not in b.columns] + [(c, "b") for c in b.columns if c not in a.columns]
    return spark.createDataFrame(rows, "column string, side string")


def write_ordered(df: DataFrame, path: str, partitions: int | None = None, mode: str = "error") -> None:
    """zstd Parquet in ranges of nodes, each sorted by node and time."""
    dealt = df.repartitionByRange(partitions, "nodo_id", "datetime") if partitions else df.repartitionByRange("nodo_id", "datetime")
    dealt.sortWithinPartitions("nodo_id", "datetime").write.mode(mode).option("compression", "zstd").parquet(path)


def decoded(df: DataFrame) -> DataFrame:
    """Labels of cloud_type and fill_flag, and whether a row is filled, as further columns."""
    if "cloud_type" in df.columns:
        df = df.withColumn("cloud_label", label_of("cloud_type", CLOUD_TYPE))
    if "fill_flag" in df.columns:
        df = df.withColumn("fill_label", label_of("fill_flag", FILL_FLAG)).withColumn("filled", F.col("fill_flag") != 0)
    return df


def write_replacing(df: DataFrame, path: str, history: str | None = None) -> None:
    """Write beside `path`, then swap by two renames, between which a reader finds no table; `versions.publish` has no such gap. The old one moves to `history`,
    or goes. A failed write leaves the old table.

    Works on any file system that Spark writes to; `df` may be read from `path`.
    """
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.next-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(staging)
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = history or f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"could not move {path} to {old}")
    if not fs.rename(at(staging), at(path)):
        raise OSError(f"could not move {staging} to {path}; the old table is {old}")
    if history is None and fs.exists(at(old)):
        fs.delete(at(old), True)


def export(df: DataFrame, path: str, fmt: str | None = None, decode: bool = False, **filters) -> None:
    """Write a filtered subset (arguments of `filtered`) by the path's extension or a named format; others are an error."""
    fmt = fmt or path.rsplit(".", 1)[-1]
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    df = filtered(df, **filters) if filters else df
    df = decoded(df) if decode else df
    writer = df.write.format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
