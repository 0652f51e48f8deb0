"""URL filter: rules for hosts and paths, and link-graph propagation for what no rule decides.

Trust is a personalised PageRank from hosts that the rules allow, along the links of the pages between hosts; distrust the same from
blocked hosts along reversed links. Besides, both pass from a parent domain down to its hosts, never up: what one host earns does
not reach its siblings through the domain they share. A host whose distrust, relative to its seeds' mean, exceeds its trust by the
threshold is blocked. DataFrame functions only; the iterations work on hosts, not on pages, and end when the scores stand still.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, staged

#: (action, rule): host, then path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LINK = r"(?i)(?:href|src)\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"


def host_of(url):
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), lower_ascii(F.regexp_extract(after, r"^([^/?#]*)", 1))).otherwise("")


def path_of(url):
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def _best(host, path, rules):
    """The longest rule that fits, as struct(length, rule, action); null if none does."""
    fits = []
    for action, rule in rules:
        h, _, p = rule.partition("/")
        fit = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    return F.greatest(*fits, F.lit(None).cast("struct<n:int,rule:string,action:string>"))


ROUNDS_AT_ONCE = 4  # rounds between two tests of convergence


def _spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """Personalised PageRank of each side: (side, host, score), once no score moves by more than `tolerance` in ROUNDS_AT_ONCE rounds.

    edges: (side, src, dst, share), the shares of a source sum to 1 on each side; seeds: (side, host, seed). What a round can still
    move shrinks by the damping (below 1) each time, so that it ends.
    """
    start = seeds.select("side", "host", (F.col("seed") * (1 - damping)).alias("score"))
    rank = seeds.select("side", "host", F.col("seed").alias("score"))
    while True:
        new = rank
        for _ in range(ROUNDS_AT_ONCE):
            at = new.select(F.col("side").alias("s"), "host", "score")
            moved = edges.join(at, (edges.side == at.s) & (edges.src == at.host)).select("side", F.col("dst").alias("host"), (F.col("share") * F.col("score") * damping).alias("score"))
            new = moved.union(start).groupBy("side", "host").agg(F.sum("score").alias("score"))
        new = staged(new, "rank")
        # A host without seeds that is reached no more has left `new`.
        both = new.union(rank.select("side", "host", -F.col("score"))).groupBy("side", "host").agg(F.abs(F.sum("score")).alias("change"))
        change = both.agg(F.max("change")).first()[0]
        rank = new
        if change is None or change <= tolerance:
            return rank


def url_verdicts(pages: DataFrame, rules=RULES, damping: float = 0.85, tolerance: float = 1e-9, threshold: float = 0.0) -> DataFrame:
    """page_id, host, path, rule, verdict, host_score: one row per row of `pages` (page_id, url, html).

    A null url or one without :// has an empty host and path. The rule that wins is the longest; without one the host's score
    decides: blocked if it is below -threshold, allowed otherwise (so also where the graph knows nothing of the host). A null or empty html has no links.
    Scores are rounded to 9 digits, so the order of additions cannot decide.
    """
    page = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.col("html").cast("string"))
    judged = page.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("best", _best(F.col("host"), F.col("path"), rules))
    links = page.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst")).select("src", lower_ascii(F.col("dst")).alias("dst"))
    links = links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    # Per host: how many of its pages the rules allow and block.
    hosts = staged(
        judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("best.action") == "allow").alias("allowed"), F.count_if(F.col("best.action") == "block").alias("blocked"), F.count("*").alias("pages")), "hosts"
    )
    down = hosts.select(F.expr("substring(host, instr(host, '.') + 1)").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("w")).where("instr(dst, '.') > 0 and instr(src, '.') > 0")
    links = staged(links, "links")
    edges = links.union(down).select(F.lit("trust").alias("side"), "*").union(links.select("dst", "src", "w").union(down).select(F.lit("distrust"), "*"))
    edges = staged(edges.groupBy("side", "src", "dst").agg(F.sum("w").alias("w")), "edges")
    shares = edges.join(edges.groupBy("side", "src").agg(F.sum("w").alias("all")), ["side", "src"]).select("side", "src", "dst", (F.col("w") / F.col("all")).alias("share"))

    def seeds(side: str, column: str) -> DataFrame:
        # A host is a seed by the share of its pages that the rules decide so; the seeds' mean is 1.
        s = hosts.where(F.col(column) > 0).select("host", (F.col(column) / F.col("pages")).alias("s"))
        mean = s.agg(F.avg("s")).first()[0] or 1.0
        return s.select(F.lit(side).alias("side"), "host", (F.col("s") / F.lit(mean)).alias("seed"))

    rank = _spread(staged(shares, "shares"), staged(seeds("trust", "allowed").union(seeds("distrust", "blocked")), "seeds"), damping, tolerance)
    trust = rank.where("side = 'trust'").select("host", F.col("score").alias("trust"))
    distrust = rank.where("side = 'distrust'").select("host", F.col("score").alias("distrust"))
    score = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left")
    score = staged(score.select("host", F.round(F.coalesce("trust", F.lit(0.0)) - F.coalesce("distrust", F.lit(0.0)), 9).alias("host_score")), "scores")
    return judged.join(score, "host", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.when(F.col("host_score") < -threshold, "block").otherwise("allow")).alias("verdict"), "host_score",
    )
