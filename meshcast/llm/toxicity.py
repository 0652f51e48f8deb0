"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is trained in numpy from confirmed toxic texts (P) and unlabelled texts (U) with the
non-negative risk estimator

    R = prior * E_P[loss(+1)] + max(0, E_U[loss(-1)] - prior * E_P[loss(-1)])

where `prior` is the share of toxic texts. When the second term falls below zero, the step goes against it only.
Training rows are a bounded sample (parameters); every row is scored over its whole text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, staged, word_hashes

BITS = 20
PREFIXES = range(4, 9)
_TABLE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))


def features(text: str | None) -> np.ndarray:
    """Distinct hashed words of the whole text, without ASCII punctuation, A-Z lower-cased, and their first 4 to 8 bytes."""
    words = set((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).lower().split())
    parts = list(words)
    for n in PREFIXES:
        parts += {w[:n] + b"*" for w in words if len(w) > n}
    return np.unique((word_hashes(parts) >> np.uint64(64 - BITS)).astype(np.int64))


def _csr(rows: list[np.ndarray]):
    return np.concatenate([np.empty(0, np.int32), *rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def _margins(w: np.ndarray, b: float, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(w[flat])])
    return sums[ends[1:]] - sums[ends[:-1]] + b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def standing_out(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, min_z: float = 4.5, least: int = 8) -> np.ndarray:
    """Which features' share of the toxic texts stands out from their share of the unlabelled ones, by counts of texts; the rest would only be learnt by heart."""
    share = (toxic + other + 1) / (n_toxic + n_other + 2)
    z = (toxic / max(n_toxic, 1) - other / max(n_other, 1)) / np.sqrt(share * (1 - np.minimum(share, 0.999)) * (1 / max(n_toxic, 1) + 1 / max(n_other, 1)))
    return (np.abs(z) >= min_z) & (toxic + other >= least)


def risk(x: np.ndarray, positive, unlabelled, prior: float, l2: float = 0.0) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The parts prior * E_P[loss(+1)] and E_U[loss(-1)] - prior * E_P[loss(-1)] of the risk and their gradients, for weights and bias x."""
    parts = []
    for flat, ends in (positive, unlabelled):
        z = _margins(x[:-1], x[-1], flat, ends)
        owner = np.repeat(np.arange(len(z)), np.diff(ends))
        down = lambda d, flat=flat, owner=owner: np.append(np.bincount(flat, d[owner], len(x) - 1), d.sum())
        parts.append((z, down))
    (zp, dp), (zu, du) = parts
    first, rest = prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    g_first = dp(-prior * (1 - _sigmoid(zp)) / len(zp))
    g_rest = du(_sigmoid(zu) / len(zu)) - dp(prior * _sigmoid(zp) / len(zp))
    return first + l2 * (x[:-1] ** 2).sum() / 2, rest, g_first + l2 * np.append(x[:-1], 0), g_rest


def train(positive, unlabelled, n_features: int, prior: float, epochs: int = 400, rate: float = 0.1, l2: float = 2e-5) -> np.ndarray:
    """Full-batch Adam on the non-negative risk with the logistic loss; deterministic. Returns the weights of the features and the bias.

    `positive` and `unlabelled` are (features, ends) of their texts, one after the other.
    """
    x, m, v = np.append(np.zeros(n_features), np.log(prior / (1 - prior))), 0.0, 0.0
    if not n_features or len(positive[1]) < 2 or len(unlabelled[1]) < 2:
        return x
    for t in range(1, epochs + 1):
        _, rest, g_first, g_rest = risk(x, positive, unlabelled, prior, l2)
        g = g_first + g_rest if rest >= 0 else -g_rest
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (1 - 0.9 * t / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def fit(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 9000, chars: int = 20_000) -> tuple[np.ndarray, float]:
    """Weights of all hashed features, and the bias.

    P is at most `positives` confirmed toxic rows, U at most `unlabelled` rows of `docs` without a label, both of the training fold and
    the first by a hash of their id; where fewer rows have no label, others join U with their label hidden. Rows over `chars` characters
    are left out of the sample. Rows whose crc32(doc_id) mod 3 is 1 are never read. The class prior is the share of toxic rows
    among the labelled ones, between 0.005 and 0.5. Texts are counted and reduced to the chosen features on the executors.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(fold % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*"), F.sum("toxic")).first()
    prior = float(np.clip((counts[1] or 0) / max(counts[0], 1), 0.005, 0.5))
    order = F.xxhash64("doc_id")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null and doc_id is not null").where(F.length("text") <= chars)
    all_ids = texts.where(fold % 3 != 1).select("doc_id").distinct().join(known, "doc_id", "left")
    picked = all_ids.where("toxic = 1").orderBy(order, "doc_id").limit(positives).select("doc_id", F.lit(1).alias("toxic"))
    hidden = all_ids.orderBy(F.col("toxic").isNotNull(), order, "doc_id").limit(unlabelled).select("doc_id", F.lit(0).alias("toxic"))
    picked = staged(picked.union(hidden), "picked")
    # The sample's size is bounded by the parameters, so its ids are broadcast.
    rows = texts.join(F.broadcast(picked), "doc_id").mapInPandas(_sample, "doc_id long, toxic int, f array<int>")
    rows = staged(rows.dropDuplicates(["doc_id", "toxic"]), "sample")
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    weights, bias = np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior)))
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return weights, bias
    often = rows.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.count_if(F.col("toxic") == 1).alias("cp"), F.count_if(F.col("toxic") == 0).alias("cu"))
    often = often.where("cp + cu >= 8").toPandas()  # at most 2^BITS rows
    used = np.sort(often.f.to_numpy(np.int64)[standing_out(often.cp.to_numpy(), often.cu.to_numpy(), n_toxic, n_other)])
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    table = docs.sparkSession.sparkContext.broadcast(place)
    kept = rows.mapInPandas(_reduce(table), "doc_id long, toxic int, f binary").toPandas().sort_values(["doc_id", "toxic"])
    sets = [[np.frombuffer(x, np.int32) for x in kept.f[kept.toxic == t]] for t in (1, 0)]  # toxic texts are among the second, too
    x = train(_csr(sets[0]), _csr(sets[1]), len(used), prior)
    weights[used] = x[:-1]
    return weights, float(x[-1])


def _sample(batches):
    for pdf in sliced(batches):
        yield pd.DataFrame({"doc_id": pdf.doc_id, "toxic": pdf.toxic, "f": [features(t).astype(np.int32) for t in pdf.text]})


def _reduce(table):
    def run(batches):
        for pdf in batches:
            yield pdf.assign(f=[(q := table.value[np.asarray(f, np.int64)])[q >= 0].tobytes() for f in pdf.f])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **sample) -> DataFrame:
    """All columns of `docs` with score (0 to 1) and predicted (1 where score >= threshold) appended.

    Null and empty texts get the score of a text without words. With no confirmed toxic row every text gets the prior. Repeated rows
    are each scored; an empty table gives no rows. Columns of `docs` named score or predicted are replaced.
    """
    w, b = fit(docs, labels, **sample)
    model = docs.sparkSession.sparkContext.broadcast((w, b))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w, b = model.value
        return pd.Series(_sigmoid(np.array([float(w[features(t)].sum(dtype=np.float64)) + b for t in texts])))

    scored = docs.withColumn("score", score(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
