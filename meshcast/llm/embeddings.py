"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into halves; an independent codebook for each half (k-means on a bounded sample) makes a product grid of
cells. A vector visits the cells of its own label from the nearest on (multi-sequence order over the two sorted lists of
distances to the borders of the cells): to reach cell (i, j), a partner has to be at least

    border(x1, i)^2 + border(x2, j)^2

away. Beyond 2 - 2t no cell can hold a partner at cosine >= t; few partners move straight at a border, so the traversal ends
earlier, where the target recall is reached for partners drawn at the threshold itself. Candidates are verified by the cosine in
double precision.

Visits are not symmetric: a vector may reach a partner's cell that does not reach its own. Where they meet, the visitor gets the link,
and the resident too unless its own traversal reaches the visitor's block, where it gets the link as a visitor. So both ends of each
found link count it once.

Equal vectors of one label are one class, compared once. A cell's residents and visitors meet in chunks of bounded size, and each pair of
chunks gives counts and a spanning forest of its links instead of pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, sliced, staged

CHUNK = 1024  # residents of a cell that visitors meet in one task
CELL = 64  # vectors to a cell of the grid, on average; codebooks grow so that it is not exceeded, as far as the sample can train them


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(np.unique(x, axis=0)))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (((c * c).sum(1)[None] - 2 * x @ c.T)).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _normalised(x: np.ndarray) -> np.ndarray:
    """Scaled first, so that very large and very small components neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0))


def _assign(books):
    def run(batches):
        c1, c2 = books.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = _normalised(np.array(pdf.v.tolist(), np.float64))
            h = x.shape[1] // 2
            d1, d2 = _distances(x[:, :h], c1), _distances(x[:, h:], c2)
            i, j = d1.argmin(1), d2.argmin(1)
            yield pd.DataFrame({"label": pdf.label, "rep": pdf.rep, "copies": pdf.copies, "v": pdf.v, "i": i.astype(np.int32), "j": j.astype(np.int32)})

    return run


def _bounds(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to the border between its own cell and that of each centroid; 0 for its own."""
    d = _distances(x, c) ** 2
    own = d.argmin(1)
    apart = _distances(c, c)[own]
    return (np.maximum(d - d.min(1)[:, None], 0) / np.where(apart > 0, 2 * apart, 1)) ** 2


def cutoff(x: np.ndarray, books, threshold: float, recall: float, probes: int = 6000, seed: int = 11) -> float:
    """How far the traversal has to go to reach the target recall, measured on partners drawn at cosine `threshold` exactly, which are
    the hardest to find: a third differ in all components, a third in the first half only, a third in the second."""
    rng = np.random.default_rng(seed)
    q = x[rng.integers(0, len(x), probes)]
    h = x.shape[1] // 2
    z = rng.normal(size=q.shape)
    z[1::3, :h], z[2::3, h:] = 0, 0
    z -= (z * q).sum(1)[:, None] * q
    y = threshold * q + np.sqrt(1 - threshold**2) * z / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]
    need = 0
    for a, b, c in ((q[:, :h], y[:, :h], books[0]), (q[:, h:], y[:, h:], books[1])):
        need = need + _bounds(a, c)[np.arange(probes), _distances(b, c).argmin(1)]
    return float(min(np.quantile(need, recall), 2 - 2 * threshold)) + 1e-9


def traversal(s1: np.ndarray, s2: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, a, b): multi-sequence order. s1 and s2 hold each vector's sorted bounds to the cells of both codebooks. In each step every
    vector visits the nearest cell s1[a] + s2[b] that it has not visited yet; its traversal ends where that lies beyond `most`."""
    live, out = np.arange(len(s1)), []
    nearest, at = s1 + s2[:, :1], np.zeros(s1.shape, np.int64)  # of each a: the bound of its next cell, and the b of that cell
    while len(live):
        rows = np.arange(len(live))
        a = nearest.argmin(1)
        go = nearest[rows, a] <= most
        if not go.all():
            live, nearest, at, s1, s2 = live[go], nearest[go], at[go], s1[go], s2[go]
            rows, a = np.arange(len(live)), a[go]
        b = at[rows, a]
        out.append((live, a, b))
        at[rows, a] = b + 1
        more = b + 1 < s2.shape[1]
        nearest[rows, a] = np.where(more, s1[rows, a] + s2[rows, np.where(more, b + 1, 0)], np.inf)
    return tuple(np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out) if out else ((), (), ())))


def _visits(books, most: float):
    """(vector, cell) rows: the multi-sequence traversal of the grid, nearest cells first, up to the cutoff."""

    def run(batches):
        c1, c2 = books.value
        for pdf in sliced(batches, 2000):
            x = _normalised(np.array(pdf.v.tolist(), np.float64))
            h = x.shape[1] // 2
            b1, b2 = _bounds(x[:, :h], c1), _bounds(x[:, h:], c2)
            o1, o2 = b1.argsort(1, kind="stable"), b2.argsort(1, kind="stable")
            n, a, b = traversal(np.take_along_axis(b1, o1, 1), np.take_along_axis(b2, o2, 1), most)
            yield pd.DataFrame({"label": pdf.label.to_numpy()[n], "rep": pdf.rep.to_numpy()[n], "i": o1[n, a].astype(np.int32), "j": o2[n, b].astype(np.int32)})

    return run


def _verify(threshold: float):
    def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Smallest node of each node's component in a graph of n nodes."""
        mark = np.arange(n)
        while True:
            low = np.minimum(mark[a], mark[b])
            new = mark.copy()
            np.minimum.at(new, mark[a], low)
            np.minimum.at(new, mark[b], low)
            new = new[new]
            if (new == mark).all():
                return mark
            mark = new

    def run(key, left, right):
        """Visitors (left) meet the residents of one chunk (right)."""
        out = []
        if len(left) and len(right):
            residents = _normalised(np.array(right.v.tolist(), np.float64))
            rid, copies = right.rep.to_numpy(np.int64), right.copies.to_numpy(np.int64)
            seen = np.concatenate(right.seen.tolist())
            owner = np.repeat(np.arange(len(right)), right.seen.str.len())
            credit = np.zeros(len(right), np.int64)
            for lo in range(0, len(left), CHUNK):
                part = left.iloc[lo : lo + CHUNK]
                vid = part.rep.to_numpy(np.int64)
                hit = _normalised(np.array(part.v.tolist(), np.float64)) @ residents.T >= threshold
                hit &= vid[:, None] != rid[None, :]
                links = hit @ copies
                # Residents that reach the visitor's block count the link there.
                homes, own = np.unique(part.home.to_numpy(), return_inverse=True)
                at = np.minimum(np.searchsorted(homes, seen), len(homes) - 1)
                reach = np.zeros((len(homes), len(rid)), bool)
                reach[at[homes[at] == seen], owner[homes[at] == seen]] = True
                credit += (hit & ~reach[own]).T @ part.copies.to_numpy(np.int64)
                a, b = np.nonzero(hit)
                ids = np.unique(np.concatenate([vid, rid]))
                mark = forest(len(ids), np.searchsorted(ids, vid[a]), np.searchsorted(ids, rid[b]))
                some = np.flatnonzero(mark != np.arange(len(ids)))
                if links.any():
                    out.append(pd.DataFrame({"rep": vid[links > 0], "links": links[links > 0], "root": pd.array([None] * int((links > 0).sum()), "Int64")}))
                if len(some):
                    out.append(pd.DataFrame({"rep": ids[some], "links": np.int64(0), "root": pd.array(ids[mark[some]], "Int64")}))
            if credit.any():
                out.append(pd.DataFrame({"rep": rid[credit > 0], "links": credit[credit > 0], "root": pd.array([None] * int((credit > 0).sum()), "Int64")}))
        return pd.concat(out) if out else pd.DataFrame({"rep": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": pd.array([], "Int64")})

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, centroids: int = 32, sample: int = 8192, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of `vectors` (vec_id, embedding, label).

    Only vectors of equal, non-null labels and equal length are compared. Null, zero and empty vectors and those with null or
    non-finite components link with nothing. Equal vectors link with each other. vec_id names one vector: a repeated row is one more
    vector, which links with its twin. An empty table gives no rows. Each codebook has `centroids` centroids, more for over
    CELL * centroids^2 vectors, and is learnt from at most `sample` vectors drawn by a hash; every vector is indexed.
    """
    spark = vectors.sparkSession
    # Floats travel as they are; all arithmetic is in double precision.
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    all_ = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("v"), F.col("label").cast("string"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = F.coalesce(F.forall("v", finite) & F.exists("v", lambda c: c != 0) & F.col("label").isNotNull(), F.lit(False))
    all_ = all_.withColumn("v", F.when(good, F.col("v"))).withColumn("label", F.concat_ws(":", F.col("label"), F.size("v").cast("string")))
    # Copies under the same label are one class, named by a digest.
    all_ = all_.withColumn("digest", F.when(F.col("v").isNotNull(), F.sha1(F.concat_ws(",", "label", F.col("v").cast("array<string>")).cast("binary"))))
    classes = all_.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = staged(classes, "classes")
    member = all_.select("vec_id", "digest").join(classes.select("digest", "rep", "copies"), "digest", "left").select("vec_id", "rep", "copies")

    found = None
    # One turn for each vector length; a table of embeddings has one.
    for width, n in classes.groupBy(F.size("v")).count().collect():
        some = classes.where(F.size("v") == width)
        # The sample is drawn by a hash, and bounded by the parameter.
        train = some.orderBy(F.xxhash64("rep"), "rep").select("v").limit(sample).toPandas().v
        x = _normalised(np.array(train.tolist(), np.float64))
        k = max(centroids, min(int(np.ceil(np.sqrt(n / CELL))), sample // 8))
        h = width // 2
        books = spark.sparkContext.broadcast((kmeans(x[:, :h], k), kmeans(x[:, h:], k)))
        cells = staged(
            some.select("label", "rep", "copies", "v").mapInPandas(_assign(books), f"label string, rep long, copies long, v {kind}, i int, j int"), "cells"
        )
        # A row of cells is cut into blocks of columns, and a block with many residents into chunks; its visitors are dealt to chunks too.
        block = F.pmod("j", F.least(F.ceil(F.sum("count").over(Window.partitionBy("label", "i")) / CHUNK), F.lit(k)).cast("int"))
        sizes = cells.groupBy("label", "i", "j").count().withColumn("block", block)
        blocks = staged(sizes.groupBy("label", "i", "block").agg(F.ceil(F.sum("count") / CHUNK).cast("int").alias("chunks"), F.collect_list("j").alias("js")), "blocks")
        visits = cells.select("label", "rep", "v").mapInPandas(_visits(books, cutoff(x, books.value, threshold, recall)), "label string, rep long, i int, j int")
        # Cells without residents drop out; a block is visited once.
        own = ["label", "i", "block"]
        visits = staged(visits.join(blocks.select(*own, F.explode("js").alias("j")), ["label", "i", "j"]).select(*own, "rep").distinct(), "visits")
        turns = blocks.drop("js").join(visits.groupBy(*own).agg(F.ceil(F.count("*") / (4 * CHUNK)).cast("int").alias("turns")), own)
        dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        keys = [*own, "chunk", "turn"]
        # Blocks by number: those that a vector visits, at most all of the grid, and its own.
        number = (F.col("i") * k + F.col("block")).cast("int")
        seen = visits.groupBy("rep").agg(F.collect_list(number).alias("seen"))
        placed = cells.join(blocks.select("label", "i", "block", F.explode("js").alias("j")), ["label", "i", "j"])
        residents = placed.join(turns, own).join(seen, "rep")
        residents = residents.withColumn("chunk", dealt("chunks")).withColumn("turn", every("turns")).select(*keys, "rep", "copies", "v", "seen")
        visitors = visits.join(turns, own).withColumn("turn", dealt("turns")).withColumn("chunk", every("chunks")).select(*keys, "rep")
        visitors = visitors.join(placed.select("rep", F.col("copies").alias("own_copies"), number.alias("home"), F.col("v").alias("own_v")), "rep")
        visitors = visitors.select(*keys, "rep", F.col("own_copies").alias("copies"), "home", F.col("own_v").alias("v"))
        met = visitors.groupBy(*keys).cogroup(residents.groupBy(*keys)).applyInPandas(_verify(threshold), "rep long, links long, root long")
        found = met if found is None else found.union(met)
    if found is None:
        found = spark.createDataFrame([], "rep long, links long, root long")
    found = staged(found, "links")
    links = found.where("root is null").groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    component = staged(component, "components")
    by_rep = classes.select("rep").join(links, "rep", "left").join(component, "rep", "left")
    return (
        member.join(by_rep, "rep", "left")
        .select(
            "vec_id",
            (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
            F.coalesce("component", "rep", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
