"""Resumable ingest: file streams whose checkpoint remembers what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions
from ..sources.footers import footers_of


def ingest_new_files(spark: SparkSession, folder: str, schema, out: str, checkpoint: str):
    """Append the rows of files that no earlier run has read; returns the finished query. `schema` is fixed: a file's other columns are
    ignored, missing ones are null; a failed run is repeated from its checkpoint without repeating rows in `out`."""
    stream = spark.readStream.schema(schema).parquet(folder)
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


LEDGER = "nodo_id int, year int, file string, rows long, batch long"
ASIDE = "file string, reason string, batch long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return versions.current(spark, path) if versions.parts(spark, path) else spark.createDataFrame([], schema)


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """(nodo_id, year, file, rows, batch) of all files whose rows are in the table."""
    return _table(spark, f"{out}/ledger", LEDGER).select(*(f.split()[0] for f in LEDGER.split(", ")))


def set_aside(spark: SparkSession, out: str) -> DataFrame:
    """(file, reason, batch) of the files whose rows are not in the table."""
    return _table(spark, f"{out}/aside", ASIDE).select(*(f.split()[0] for f in ASIDE.split(", ")))


def rows(spark: SparkSession, out: str) -> DataFrame:
    """The table: columns that came late are null in earlier rows."""
    return versions.current(spark, f"{out}/rows")


def ingest_node_files(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "nodo_*.parquet", files_per_batch: int = 1000):
    """Take the files nodo_<id>_<year>_... that no earlier run has taken into the table at `out` (`rows`), keep a ledger of (node, year, file, batch), and set aside what
    cannot be read, has no such name, or repeats a node and year that the ledger has; returns the finished query.

    The stream carries names, not contents. A batch's rows, ledger and files set aside are parts of versioned tables under the number of the batch, so a batch that is
    run again after a crash replaces what it has left and nothing is there twice. A batch has at most `files_per_batch` files, whose names pass through the driver.
    """

    def take(batch: DataFrame, number: int) -> None:
        found = footers_of(batch.select("path", "length")).groupBy("file").agg(F.max("error").alias("error"), F.max("rows").alias("rows"))
        name = F.element_at(F.split("file", "/"), -1)
        parts = found.select("file", "error", "rows", *(F.regexp_extract(name, r"^nodo_(\d+)_(\d{4})_", i).try_cast("int").alias(c) for i, c in ((1, "nodo_id"), (2, "year"))))
        earlier = ledger(spark, out).where(F.col("batch") != number).groupBy("nodo_id", "year").agg(F.min("batch").alias("earlier"))
        first = parts.where("error is null").groupBy("nodo_id", "year").agg(F.min("file").alias("first"))
        state = parts.join(earlier, ["nodo_id", "year"], "left").join(first, ["nodo_id", "year"], "left")
        reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("nodo_id").isNull() | F.col("year").isNull(), "no node and year in its name")
        reason = reason.when(F.col("earlier").isNotNull(), F.format_string("node and year are in batch %d", "earlier")).when(F.col("file") != F.col("first"), F.concat(F.lit("same node and year as "), "first"))
        decided = state.withColumn("reason", reason).withColumn("batch", F.lit(number).cast("long")).collect()  # at most files_per_batch
        good = [r for r in decided if r.reason is None]
        bad = [(r.file, r.reason, number) for r in decided if r.reason is not None]
        if good:
            table = spark.read.option("mergeSchema", "true").parquet(*(r.file for r in good))
            table = table.withColumn("nodo_id", F.regexp_extract(F.col("_metadata.file_name"), r"nodo_(\d+)_", 1).cast("int")).withColumn("batch", F.lit(number).cast("long"))
            versions.publish(table, f"{out}/rows", ["batch"])
            versions.publish(spark.createDataFrame([(r.nodo_id, r.year, r.file, r.rows, number) for r in good], LEDGER), f"{out}/ledger", ["batch"])
        if bad:
            versions.publish(spark.createDataFrame(bad, ASIDE), f"{out}/aside", ["batch"])

    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)
    query = names.select("path", "length").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
