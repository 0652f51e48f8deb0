"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct k-word shingles (64-bit hashes); documents with equal sets are one class, named by a 64-bit
digest of the set. All sets use one global order of shingles, frequent ones last, so the first `n - ceil(t n) + 1` of a set (its
prefix) are rare; linked sets share a shingle of both prefixes.

* Index: the inverted list of a prefix shingle holds (set, size, position). Entries that no other set shares are dropped while
  the lists are sorted, before anything is stored.
* Answers: each set is compared with one leader, a set that it shares most lists with. Let S be the leader and D(A) the symmetric
  difference of A and S. Any two sets of one leader have

      |A & B| = |A & S| + |B & S| - |S| + |D(A) & D(B)|

  so B's answer is A's, corrected by the few shingles in which they differ from S; whole sets are not read again. Two sets that
  need no common difference to link are linked to S themselves, so only sets that S does not link with look for partners, in lists
  of differences.
* Blocks: sets of different leaders meet in the lists, cut into blocks by size band and position. A set is first held against the
  extents of a list's blocks (sizes and positions), and reads only blocks that can reach the threshold.

No list is gathered in one task: lists are grouped with partial aggregates and joined on keys, whose hot ones adaptive execution
splits; where lists are sorted, those of very frequent shingles are salted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, shingle_hashes, sliced, staged, word_hashes

BUCKETS = 22  # bits: size of the table that orders shingles by frequency; it does not grow with the data
LONG_LIST = 1 << 14  # a list that may hold more entries than this, and more than the mean bucket 16 times over, is salted
SHORT_LIST = 64  # entries of a list whose pairs are counted before any set is read
POSITIONS = 8  # blocks of positions in a prefix


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; empty for null and for texts without words."""
    if not text:
        return np.empty(0, np.uint64)
    return np.unique(shingle_hashes(word_hashes(text.encode("utf-8", "surrogatepass").lower().split()), k))


def _digests(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, from two sums over its shingles."""
    ends = np.cumsum(sizes, dtype=np.int64)
    with np.errstate(over="ignore"):
        mixed = (flat ^ (flat >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (flat, mixed)]
        s1, s2 = (x[ends] - x[ends - sizes] for x in sums)
        x = (s1 ^ (s2 >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + s2 + sizes.astype(np.uint64)
        return ((x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _sets_of(texts, k: int):
    sets = [shingle_set(t, k) for t in texts]
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    return sets, sizes, flat, _digests(flat, sizes)


def _survey(k: int):
    def run(batches):
        table, seen = np.zeros(1 << BUCKETS, np.int64), 0
        for pdf in sliced(batches):
            _, sizes, flat, ids = _sets_of(pdf.text, k)
            table += np.bincount((flat >> np.uint64(64 - BUCKETS)).astype(np.int64), minlength=1 << BUCKETS)
            seen += len(flat)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n": sizes.astype(np.int32), "id": ids, "bucket": pd.array([None] * len(pdf), "Int32"), "times": np.int64(0)})
        # Only buckets that stand out; the order need not be exact, only the same everywhere. The last row is the number of shingles.
        out = np.flatnonzero(table >= 4 + 4 * (seen >> BUCKETS))
        out, times = np.append(out, -1), np.append(table[out], seen)
        yield pd.DataFrame({"doc_id": pd.array([None] * len(out), "Int64"), "n": np.int32(0), "id": np.int64(0), "bucket": pd.array(out, "Int32"), "times": times})

    return run


def _prefixes(k: int, percent: int, levels, long_level: int):
    def run(batches):
        level = levels.value
        for pdf in sliced(batches):
            _, sizes, flat, ids = _sets_of(pdf.text, k)
            first = np.flatnonzero(pd.Series(ids).duplicated().to_numpy() | (sizes == 0))
            own = np.repeat(np.arange(len(sizes)), sizes)
            lv = level[(flat >> np.uint64(64 - BUCKETS)).astype(np.int64)]
            order = np.lexsort((flat, lv, own))
            position = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            prefix = sizes - (percent * sizes + 99) // 100 + 1
            prefix[first] = 0
            keep = position < np.repeat(prefix, sizes)
            h, p, o = flat[order[keep]], position[keep], own[keep]
            salt = np.where(level[(h >> np.uint64(64 - BUCKETS)).astype(np.int64)] >= long_level, 1 + (ids[o] & 1023), 0)
            yield pd.DataFrame({"h": h.view(np.int64), "salt": salt.astype(np.int32), "id": ids[o], "np": (sizes[o] << 32) | p})

    return run


def _shared(batches):
    """Rows in the order of (h, salt, id): drops repeated entries, and those of a list (not a salted one) with no second set."""
    held = None  # last row so far, and whether the one before it is of the same list
    for pdf in batches:
        if not len(pdf):
            continue
        if held is not None:
            pdf = pd.concat([held[0], pdf], ignore_index=True)
        h, salt, i = pdf.h.to_numpy(), pdf.salt.to_numpy(), pdf.id.to_numpy()
        new = np.append(True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]) | (i[1:] != i[:-1]))
        pdf, h, salt = pdf[new], h[new], salt[new]
        same = (h[1:] == h[:-1]) & (salt[1:] == salt[:-1])
        before = np.append(False if held is None else held[1], same)
        live = before | np.append(same, False) | (salt > 0)
        held = (pdf.iloc[-1:], bool(before[-1]))
        yield pdf[live][:-1] if live[-1] else pdf[live]
    if held is not None and (held[1] or held[0].salt.iloc[0] > 0):
        yield held[0]


def _sets(k: int):
    def run(batches):
        for pdf in sliced(batches):
            sets, _, _, ids = _sets_of(pdf.text, k)
            yield pd.DataFrame({"id": ids, "shingles": [s.view(np.int64) for s in sets]})

    return run


def _needed(percent: int, n, m):
    """Least intersection of linked sets of n and m shingles."""
    return F.floor((F.lit(percent) * (n + m) + F.lit(99 + percent)) / F.lit(100 + percent)).cast("int")


def ngram_jaccard_join(docs: DataFrame, k: int = 4, percent: int = 85, star_rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of `docs` (doc_id, text; other columns are ignored).

    Words are runs of anything but ASCII white space, A-Z lower-cased. Sets link when 100 |A & B| >= percent |A | B|.
    component_id is the smallest doc_id of the rows that a row reaches. Null and empty texts and texts without words have an empty
    set (n_shingles 0) and link with nothing. Repeated rows give repeated rows, and rows that share a doc_id but not a text are
    compared each for itself; a row without a doc_id keeps a null component and connects nothing; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    survey = staged(docs.mapInPandas(_survey(k), "doc_id long, n int, id long, bucket int, times long"), "survey")
    member = survey.where("bucket is null").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("id")).alias("id"))

    # At most 2^BUCKETS rows, whatever the input: 4 MB as a broadcast table.
    counted = survey.where("bucket is not null").groupBy("bucket").agg(F.sum("times").alias("times"))
    counted = counted.select("bucket", F.floor(F.log2(F.greatest("times", F.lit(1)))).cast("int").alias("level")).toPandas()
    mean = max([0, *counted.level[counted.bucket == -1]]) - BUCKETS
    counted = counted[counted.bucket >= 0]
    levels = np.zeros(1 << BUCKETS, np.uint8)
    levels[counted.bucket.to_numpy(np.int64)] = np.minimum(counted.level.to_numpy(np.int64), 63)
    long_level = max(int(np.log2(LONG_LIST)), mean + 4)
    levels = spark.sparkContext.broadcast(levels)

    entries = docs.where("doc_id is not null").mapInPandas(_prefixes(k, percent, levels, long_level), "h long, salt int, id long, np long")
    entries = entries.repartition("h", "salt").sortWithinPartitions("h", "salt", "id").mapInPandas(_shared, entries.schema)
    lists = staged(entries.select("h", "id", F.shiftright("np", 32).cast("int").alias("n"), F.col("np").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("p")), "lists")

    lists = staged(_promising(lists, percent), "promising")

    # Their sets, each read from one of its documents. Spark broadcasts the ids or not by their stored size.
    rep = F.min("doc_id").alias("doc_id")
    found = staged(member.join(lists.select("id").distinct(), "id").groupBy("id", "doc_id").agg(F.count("*").alias("rows")).groupBy("id").agg(rep, F.min_by("rows", "doc_id").alias("rows")), "found")
    sets = docs.join(found.select("doc_id"), "doc_id", "left_semi").mapInPandas(_sets(k), "id long, shingles array<long>")
    sets = sets.join(found.select("id"), "id", "left_semi")
    if not found.where("rows > 1").isEmpty():
        sets = sets.dropDuplicates(["id"])
    sets = staged(sets, "sets")

    answers, linked = _answers(lists, sets, percent, star_rounds)
    component = staged(connected_components(linked, "id", "leader"), "components").withColumnRenamed("node", "id")
    # What is known of each set: its nearest leader, its difference from it, and its component so far.
    nearest = answers.where("diff is not null").groupBy("id").agg(F.max_by(F.struct("leader", "leader_n", "both", "diff"), F.struct(F.col("both") / (F.col("n") + F.col("leader_n") - F.col("both")), "leader")).alias("x"))
    nearest = nearest.select("id", "x.*")
    groups = staged(nearest.join(component, "id", "left").withColumn("component", F.coalesce("component", "id")), "groups")
    derived = _derived(groups, percent)
    crossed = _crossed(lists.drop("mine"), sets, groups.select("id", "leader"), component, percent)
    edges = linked.union(derived).union(crossed)
    component = staged(connected_components(staged(edges, "links"), "id", "leader"), "components").withColumnRenamed("node", "id")

    # The name of a component is its smallest doc_id.
    rows = member.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("name"))
    return rows.join(names, "component", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"))


def _promising(lists: DataFrame, percent: int) -> DataFrame:
    """The entries of sets that share enough of their prefix to link with anything, with the number of a set's entries as `mine`.

    Of two linked sets, the one whose prefix ends first shares all but what lies beyond its prefix, at least `least` shingles, with the
    other's prefix. In short lists, pairs are counted; a set's entries in long lists may all be shared with the same partner.
    """
    c = F.col

    def least(n, m):
        return _needed(percent, n, m) - F.ceil(F.greatest(n, m) * percent / 100.0 - 1e-6).cast("int") + 1

    entries = lists.join(lists.groupBy("h").agg(F.count("*").alias("sets"), F.min("n").alias("n0"), F.max("n").alias("n1")), "h")
    # The partner's size lies between a long list's ends; between these, `least` falls below both ends by one at most, where it is rounded.
    n, long = c("n"), c("sets") > SHORT_LIST
    low, high = F.greatest("n0", F.ceil(n * percent / 100.0 - 1e-6)).cast("int"), F.least("n1", F.floor(n * 100.0 / percent + 1e-6)).cast("int")
    own = entries.where(long).groupBy("id").agg(F.count("*").alias("long"), (F.min(F.least(least(n, low), least(n, high))) - 1).alias("least"))
    short = entries.where(~long).select("h", "id", "n", "p")
    x, y = (short.select("h", *(c(i).alias(i + s) for i in ("id", "n", "p"))) for s in ("_x", "_y"))
    fits = F.least("p_x", "p_y") + F.least(c("n_x") - c("p_x"), c("n_y") - c("p_y")) >= _needed(percent, c("n_x"), c("n_y"))
    pairs = x.join(y, "h").where((c("id_x") < c("id_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & fits)
    pairs = pairs.groupBy("id_x", "id_y").agg(F.count("*").alias("shared"), F.first(least(c("n_x"), c("n_y"))).alias("least"))
    longs = lambda s: own.select(c("id").alias("id" + s), c("long").alias("long" + s))
    both = F.when(c("long_x").isNotNull() & c("long_y").isNotNull(), F.least("long_x", "long_y")).otherwise(0)
    pairs = pairs.join(longs("_x"), "id_x", "left").join(longs("_y"), "id_y", "left").where(c("shared") + both >= c("least"))
    kept = pairs.select(F.explode(F.array("id_x", "id_y")).alias("id")).union(own.where("long >= least").select("id")).distinct()
    return lists.join(kept, "id", "left_semi").withColumn("mine", F.count("*").over(Window.partitionBy("id")))


def _answers(lists: DataFrame, sets: DataFrame, percent: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Every set against the leader that it shares most lists with: (id, n, leader, leader_n, both, diff), and the links among them.

    `diff` is null where the two have too little in common to derive anything. In each round the sets that no leader has
    linked yet look for one among themselves.
    """
    answers, linked, open_ = None, None, lists
    step = float(np.log(100.0 / percent))
    for turn in range(rounds):
        if turn:
            taken = linked.select("id").union(linked.select("leader")).distinct()
            open_ = open_.join(taken, "id", "left_anti")
        # An original has few shingles of its own, its edited copies do: the larger the share of its prefix that others hold, the better a leader.
        share = F.col("mine") / (F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1)
        ranked = open_.select("h", "id", share.alias("share"), F.floor(F.log("n") / F.lit(step)).cast("int").alias("band"))
        order = F.struct((-F.col("share")).alias("least"), F.xxhash64("id", F.lit(turn)).alias("any"), "id")
        leaders = ranked.groupBy("h", "band").agg(F.min(order).alias("leader")).withColumnRenamed("band", "led")
        # Linked sets lie in the same size band or in neighbouring ones. A leader comes before its followers in the order, so none follows itself.
        # Joined on the list alone: a list has few bands, and its entries shuffle once.
        met = ranked.join(leaders, "h").where((F.abs(F.col("band") - F.col("led")) <= 1) & (F.col("leader") < order)).groupBy("id", "leader").count()
        pairs = staged(met.groupBy("id").agg(F.max_by("leader.id", F.struct("count", -F.col("leader.least"), "leader.id")).alias("leader")), "followers")
        one = pairs.join(sets, "id").withColumnRenamed("shingles", "own")
        theirs = sets.join(pairs.select(F.col("leader").alias("id")), "id", "left_semi").select(F.col("id").alias("leader"), F.col("shingles").alias("theirs"))
        both = one.join(theirs, "leader")
        lost, more = F.array_except("theirs", "own"), F.array_except("own", "theirs")
        both = both.select("id", F.size("own").alias("n"), "leader", F.size("theirs").alias("leader_n"), lost.alias("lost"), more.alias("more")).withColumn("both", F.col("leader_n") - F.size("lost"))
        diff = F.when(4 * F.col("both") >= F.col("n") + F.col("leader_n"), F.concat("lost", "more"))
        answer = staged(both.select("id", "n", "leader", "leader_n", "both", diff.alias("diff")), "answers")
        answers = answer if answers is None else answers.union(answer)
        linked = answers.where(F.col("both") >= _needed(percent, F.col("n"), F.col("leader_n"))).select("id", "leader")
    return answers, linked


def _derived(groups: DataFrame, percent: int) -> DataFrame:
    """Links (id, leader) between sets of one leader that it does not link with both, from their differences alone.

    With l and m the numbers of shingles that a set lacks and has beyond its leader S, v = 100 l + percent m and V = (100 - percent) |S|:
    A and B link when (100 + percent) |D(A) & D(B)| >= v(A) + v(B) - V, and S links with A when v(A) <= V.
    """
    total, room = 100 + percent, (100 - percent) * F.col("leader_n")
    lost = F.col("leader_n") - F.col("both")
    own = groups.withColumn("v", 100 * lost + percent * (F.size("diff") - lost)).withColumn("far", F.col("v") > room)
    far = own.where("far").groupBy("leader").agg(F.min("v").alias("least"))
    own = own.join(far, "leader")
    # The fewest common differences that a link needs: with the nearest far set, or for a far set with the leader's own neighbours.
    fewest = F.greatest(F.lit(1), F.ceil((F.col("v") - room + F.when(F.col("far"), F.lit(0)).otherwise(F.col("least"))) / total).cast("int"))
    own = own.where(F.size("diff") > 0).select("leader", "leader_n", "id", "component", "both", "diff", "v", "far", fewest.alias("fewest"))
    # Differences that at least two sets share, rare ones first; a set needs `fewest` of them, so one of its first ones is shared.
    items = own.select("leader", "id", "fewest", F.explode("diff").alias("e"))
    often = items.groupBy("leader", "e").agg(F.count("*").alias("times")).where("times > 1")
    kept = items.join(often, ["leader", "e"]).groupBy("leader", "id").agg(F.sort_array(F.collect_list(F.struct("times", "e"))).alias("es"), F.first("fewest").alias("fewest"))
    kept = kept.where(F.size("es") >= F.col("fewest")).select("leader", "id", F.explode(F.slice("es", F.lit(1), F.size("es") - F.col("fewest") + 1)).alias("x")).select("leader", "id", "x.e")
    about = own.select("leader", "id", "component", "far", "v")
    kept = staged(kept.join(about, ["leader", "id"]), "differences")
    a, b = (kept.select("leader", "e", *(F.col(c).alias(c + s) for c in ("id", "component", "far", "v"))) for s in ("_a", "_b"))
    once = ~F.col("far_b") | (F.col("id_a") < F.col("id_b"))
    pairs = a.where("far_a").join(b, ["leader", "e"]).where((F.col("component_a") != F.col("component_b")) & once).select("leader", "id_a", "id_b").distinct()
    x, y = (own.select("leader", *(F.col(c).alias(c + s) for c in ("id", "v", "diff", "leader_n"))) for s in ("_a", "_b"))
    met = pairs.join(x, ["leader", "id_a"]).join(y.drop("leader_n_b"), ["leader", "id_b"])
    common = F.size(F.array_intersect("diff_a", "diff_b"))
    return met.where(total * common >= F.col("v_a") + F.col("v_b") - (100 - percent) * F.col("leader_n_a")).select(F.col("id_a").alias("id"), F.col("id_b").alias("leader"))


def _crossed(lists: DataFrame, sets: DataFrame, leader: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Links (id, leader) between sets of different leaders and components, by reading the blocks of their lists."""
    step = float(np.log(100.0 / percent))
    known = lists.join(leader, "id", "left").join(component, "id", "left").withColumn("leader", F.coalesce("leader", "id")).withColumn("component", F.coalesce("component", "id"))
    # Lists of one leader's sets, or of one component, are done. One side leaves out the list's largest group.
    sizes = known.groupBy("h", "leader").agg(F.count("*").alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    open_ = sizes.groupBy("h").agg(F.max_by("leader", F.struct("n", "leader")).alias("main"), F.count("*").alias("k"), F.min("c0").alias("c0"), F.max("c1").alias("c1")).where("k > 1 and c0 <> c1").select("h", "main")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1
    entries = known.join(open_, "h").withColumn("band", F.floor(F.log("n") / F.lit(step)).cast("int")).withColumn("block", F.floor(F.col("p") * POSITIONS / prefix).cast("int"))
    entries = staged(entries, "entries")
    blocks = entries.groupBy("h", "band", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("p").alias("p0"), F.max("p").alias("p1"))

    def can(n, p, n0, n1, p0, p1):
        """Whether sizes allow a link, and positions a large enough intersection: what comes before, the shingle itself, what comes after."""
        return (100 * n1 >= percent * n) & (100 * n >= percent * n0) & (F.least(p, p1) + 1 + F.least(n - p, n1 - p0) - 1 >= _needed(percent, n, n0))

    c = F.col
    visits = entries.where("leader <> main").select("h", c("id").alias("x"), c("n").alias("xn"), c("p").alias("xp"), c("leader").alias("xl"), c("component").alias("xc")).join(blocks, "h")
    visits = visits.where(can(c("xn"), c("xp"), c("n0"), c("n1"), c("p0"), c("p1"))).drop("n0", "n1", "p0", "p1")
    met = visits.join(entries, ["h", "band", "block"]).where((c("xl") != c("leader")) & (c("xc") != c("component")) & can(c("xn"), c("xp"), c("n"), c("n"), c("p"), c("p")))
    # In a list, a pair is met once: neither set is of the main group, or only the resident is.
    met = met.where((c("leader") == c("main")) | (c("x") < c("id")))
    # All shingles that both prefixes share are counted. The set whose prefix ends first shares no more of its prefix than these.
    beyond = F.greatest(*(F.ceil(c(n) * percent / 100.0 - 1e-6) for n in ("xn", "n"))) - 1
    pairs = met.groupBy(F.least("x", "id").alias("x"), F.greatest("x", "id").alias("y")).agg(F.count("*").alias("shared"), F.first(_needed(percent, c("xn"), c("n")) - beyond).alias("least")).where("shared >= least").select("x", "y")
    pairs = staged(pairs, "pairs")
    own = lambda i, name: sets.join(pairs.select(c(i).alias("id")), "id", "left_semi").select(c("id").alias(i), c("shingles").alias(name))
    one = pairs.join(own("x", "sx"), "x").join(own("y", "sy"), "y")
    return one.where(F.size(F.array_intersect("sx", "sy")) >= _needed(percent, F.size("sx"), F.size("sy"))).select(c("x").alias("id"), c("y").alias("leader"))
