"""What Parquet footers say, read by the executors from the ends of the files."""

from __future__ import annotations

from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, bytes long, rows long, row_groups int, column string, type string, error string"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def _footer(path: str):
    import pyarrow.fs
    import pyarrow.parquet

    system, inside = pyarrow.fs.FileSystem.from_uri(path if urlparse(path).scheme not in ("", "file") else "file://" + urlparse(path).path)
    with system.open_input_file(inside) as f:
        return pyarrow.parquet.ParquetFile(f).metadata


def _rows(batches):
    for pdf in batches:
        out = []
        for path, size in zip(pdf.path, pdf.length):
            try:
                meta = _footer(path)
                known = (path, size, meta.num_rows, meta.num_row_groups)
                fields = meta.schema.to_arrow_schema()
                out += [(*known, f.name, str(f.type), None) for f in fields] or [(*known, None, None, None)]
            except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is reported with it
                out.append((path, size, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
        yield pd.DataFrame(out, columns=_NAMES).astype({c: "Int64" for c in ("bytes", "rows", "row_groups")})


def footers_of(files: DataFrame, slices: int = 64) -> DataFrame:
    """Footers of `files` (path, length): see `footers`."""
    return files.select("path", "length").repartition(slices, "path").mapInPandas(_rows, SCHEMA)


def footers(spark: SparkSession, paths, pattern: str = "*.parquet", slices: int = 64) -> DataFrame:
    """(file, bytes, rows, row_groups, column, type, error): one row per file and top-level column of the Parquet files in folders (or of single files), in one job.

    Spark lists the files; their contents are not read but for the footers, which tasks fetch through pyarrow's file systems (local, HDFS, S3, GCS). An unreadable
    file has one row with its error; no files, no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(paths)
    return footers_of(files, slices)


def dataset_facts(spark: SparkSession, paths, pattern: str = "*.parquet") -> DataFrame:
    """One row: files, unreadable ones, bytes, rows and row groups, from footers alone."""
    per = footers(spark, paths, pattern).groupBy("file").agg(F.first("bytes").alias("bytes"), F.first("rows").alias("rows"), F.first("row_groups").alias("row_groups"), F.count("error").alias("bad"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return per.agg(F.count("*").alias("files"), F.count_if(F.col("bad") > 0).alias("unreadable"), total("bytes"), total("rows"), total("row_groups"))


def column_types(spark: SparkSession, paths, pattern: str = "*.parquet") -> DataFrame:
    """(column, type, files): in how many files each column has which type."""
    return footers(spark, paths, pattern).where("column is not null").groupBy("column", "type").agg(F.count("*").alias("files"))


def schema_audit(spark: SparkSession, paths, expected) -> DataFrame:
    """(file, column, side) for Parquet files, or folders of them, against a list of column names: side is missing, extra, or unreadable with the error in place of a
    column. `file` is the path as given. All footers are read in one job."""
    given = {urlparse(p).path.rstrip("/"): p for p in paths}

    def named(batches):
        for pdf in batches:
            inside = [urlparse(f).path for f in pdf.file]
            pdf["file"] = [given.get(f) or given.get(f.rpartition("/")[0]) or f for f in inside]
            yield pdf

    found = footers(spark, list(paths)).mapInPandas(named, SCHEMA)
    per = found.groupBy("file").agg(F.collect_set("column").alias("have"), F.max("error").alias("error"))
    wanted = F.array(*map(F.lit, expected)).cast("array<string>")
    side = lambda values, name: F.transform(values, lambda c: F.struct(c.alias("column"), F.lit(name).alias("side")))
    broken = F.when(F.col("error").isNotNull(), F.array(F.struct(F.col("error").alias("column"), F.lit("unreadable").alias("side"))))
    usual = F.concat(side(F.array_except(wanted, "have"), "missing"), side(F.array_except("have", wanted), "extra"))
    return per.select("file", F.explode(F.coalesce(broken, usual)).alias("x")).select("file", "x.*")
