"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, one of the only machine; an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="meshcast-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/meshcast-{uuid.uuid4().hex}/{name}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet to the shared folder and read it back. Its shuffle files go once it is written."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(column):
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, UPPER.lower())


def sliced(batches, rows: int = 1000):
    """Smaller batches, so that what is computed from one stays small."""
    for pdf in batches:
        for lo in range(0, len(pdf), rows):
            yield pdf.iloc[lo : lo + rows].reset_index(drop=True)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-word shingles in order; of the whole sequence, if it has 1 to k-1 words."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = hashes[: n - k + 1] + np.uint64(k)
    for i in range(1, k):
        out = (out ^ (out >> _SHIFT)) * _MIX + hashes[i : n - k + 1 + i]
    return out ^ (out >> _SHIFT)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest reachable node.

    Alternating large-star and small-star rounds. Each round is two joins on keys, whose hot keys adaptive execution
    splits, and is written to the shared folder. It ends when a round changes nothing. Null ends are ignored.
    """
    e = staged(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct(),
        "edges",
    )

    def mark(x: DataFrame):
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    seen = mark(e)
    while True:
        least = e.groupBy("hi").agg(F.min("lo").alias("m"))
        large = e.join(least.select(F.col("hi").alias("lo"), "m"), "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        small = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
        e = staged(
            small.select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x"))
            .select("x.hi", "x.lo")
            .where("hi <> lo")
            .distinct(),
            "round",
        )
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())
