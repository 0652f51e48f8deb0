"""Physical layout of fact tables: folders by region and year, buckets by node, bounded row groups.

A query on some regions or years opens their folders only. Rows of a node are in the bucket of the same number in every table written with the same number of buckets, so
aggregates by node (and finer keys), and joins of two such tables on keys with the node, need no exchange.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

PARTITIONS = ("region", "year")


def write_bucketed(df: DataFrame, name: str, path: str | None = None, buckets: int = 64, partitions=PARTITIONS, mode: str = "error", row_group_bytes: int = 64 << 20) -> None:
    """Save df as table `name` (at `path`, if given): partitions by those of `partitions` that it has, `buckets` buckets by nodo_id, each sorted by node and time.

    One exchange deals the rows by the hash that names the buckets, so each bucket of a partition is one file.
    """
    own = [p for p in partitions if p in df.columns]
    order = [c for c in ("nodo_id", "datetime") if c in df.columns]
    dealt = df.repartition(buckets, "nodo_id").sortWithinPartitions(*own, *order)
    writer = dealt.write.format("parquet").mode(mode).option("compression", "zstd").option("parquet.block.size", row_group_bytes).bucketBy(buckets, "nodo_id").sortBy(*order)
    writer = writer.partitionBy(*own) if own else writer
    (writer.option("path", path) if path else writer).saveAsTable(name)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: StructType, buckets: int = 64, partitions=PARTITIONS) -> DataFrame:
    """Register what `write_bucketed` has left at `path` in a session whose catalog does not know it, and read it."""
    own = [p for p in partitions if p in schema.fieldNames()]
    order = [c for c in ("nodo_id", "datetime") if c in schema.fieldNames()]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*(f for f in schema if f.name not in own), *(schema[p] for p in own)])
    by = f"PARTITIONED BY ({', '.join(own)}) " if own else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {by}CLUSTERED BY (nodo_id) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    if own:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def replace_partitions(df: DataFrame, name: str, buckets: int = 64) -> None:
    """Replace those partitions of a bucketed table that df has rows of; others stay. Columns are matched by name."""
    spark = df.sparkSession
    rows = df.select(*spark.table(name).columns).repartition(buckets, "nodo_id")
    with _set(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        rows.write.mode("overwrite").insertInto(name)


def colocated(spark: SparkSession):
    """Within it, plans are made that join tables of equal buckets on nodo_id and further keys bucket by bucket. Run the query, or look at its plan, inside."""
    return _set(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")
