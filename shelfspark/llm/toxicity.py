"""Toxicity scores by non-negative positive-unlabelled learning.

Trained from confirmed toxic documents (positives) and other documents of unknown label: the class prior corrects the risk,
R = p R+(pos) + max(0, R-(unlabelled) - p R-(pos)), and where that difference is negative its gradient is reversed, as in
the published non-negative estimator. The classifier is a linear numpy model on hashed word presence; a document's score is
the sigmoid of its sum. Bounds of the fit: ``positives`` and ``unlabelled`` texts at most, chosen by a hash of the text, so
equal texts count once; every document is scored whole. The words that get a weight are chosen by their frequencies over all
different texts, less the positives' share of them, and only those words of the sampled texts reach the driver.

The class prior, where it is not given, is the share of toxic texts among the different labelled ones, kept between 0.01 and 0.99 so that
both classes have some weight.

Labels are joined to documents for rows outside the held-out fold only. Labels, language, source and id are no inputs.
Defined cases: null text as empty; empty texts get the score of no words; no positives: the score is the prior; null ids and
repeated rows are scored like any; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bin_counts, held_out, known_ids, made_of, smallest
from .features import word_bins

BINS = 1 << 18


def presence(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bins of the distinct words of each text."""
    return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int64)


def distinct_counts(texts: DataFrame, bins: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many different texts (doc_id: a text's hash) each of these bins stands, and the number of different texts. Texts
    stay where they are read; what is shuffled of each is the bins that it holds of these."""
    shared = texts.sparkSession.sparkContext.broadcast(bins)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(BINS, bool)
        wanted[shared.value] = True
        for batch in batches:
            made = [np.unique(h[wanted[h]]).astype(np.int32).tobytes() for h in (word_bins(t.as_py(), BINS) for t in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "made"])

    once = texts.mapInArrow(pack, "doc_id long, made binary").groupBy("doc_id").agg(F.min("made").alias("made")).select("made")
    return bin_counts(once, lambda made: np.frombuffer(made, np.int32), BINS)


def chosen(positive: np.ndarray, n_positive: int, everywhere: np.ndarray, n: int, prior: float, lift: float = 4.0) -> np.ndarray:
    """The bins of words that are ``lift`` times as common among the positives as among the negatives, whose frequency is what
    the prior leaves of that everywhere. A standard error is taken off, so a word of a single text has nothing left."""
    dp = positive / max(1, n_positive)
    dn = np.maximum(0, (everywhere / max(1, n) - prior * dp) / (1 - prior))
    return np.flatnonzero(dp - np.sqrt(dp / max(1, n_positive)) > lift * dn + 1e-12)


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, use: np.ndarray, steps: int = 2000, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias, from the bins of each text's distinct words; bins that are not in ``use`` keep weight 0."""
    w, bias = np.zeros(BINS, np.float64), float(np.log(prior / (1 - prior)))
    if not pos or not unl:
        return w.astype(np.float32), bias
    pr, pb = presence(pos)
    ur, ub = presence(unl)
    at = np.full(BINS, -1)
    at[use] = np.arange(len(use))
    pr, pb = pr[at[pb] >= 0], at[pb[at[pb] >= 0]]
    ur, ub = ur[at[ub] >= 0], at[ub[at[ub] >= 0]]
    v, b = np.zeros(len(use)), bias
    m1, m2 = np.zeros(len(use) + 1), np.zeros(len(use) + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        zp = b + np.bincount(pr, v[pb], len(pos))
        zu = b + np.bincount(ur, v[ub], len(unl))
        negative = soft(zu).mean() - prior * soft(zp).mean()
        gp_pos, gp_neg, gu = -prior * sig(-zp) / len(pos), -prior * sig(zp) / len(pos), sig(zu) / len(unl)
        if negative >= 0:
            gp, g = gp_pos + gp_neg, gu
        else:  # the estimate of the negatives' risk went below 0: undo it
            gp, g = -gp_neg, -gu
        grad = np.append(np.bincount(pb, gp[pr], len(use)) + np.bincount(ub, g[ur], len(use)) + l2 * prior * v, gp.sum() + g.sum())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad**2
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        v, b = v - step[:-1], b - step[-1]
    w[use] = v
    return w.astype(np.float32), float(b)


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    at = np.flatnonzero(weights).astype(np.int32)  # a few thousand at most: words frequent among the positives
    value = weights[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(BINS, np.float32)
        w[at] = value
        for batch in batches:
            z = [bias + float(w[np.unique(x)].sum()) if len(x := (h := word_bins(t.as_py(), BINS))[w[h] != 0]) else bias for t in batch.column(2)]
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], [id_col, "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), held_out(id_col).alias("held_out"), text_col).mapInArrow(run, f"{id_col} long, held_out boolean, score double, predicted int")


def train_and_score(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 6000, prior: float | None = None, seed: int = 3) -> DataFrame:
    # a text is known by its hash, so that copies count once
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = labels.where(~held_out()).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    known = ids.join(known.withColumnRenamed("doc_id", "id"), "id").groupBy(F.col("t").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
        prior = min(0.99, max(0.01, prior))
    few = smallest(known.where("toxic = 1").select("doc_id"), positives, seed)
    once = lambda ids: texts.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select("text")  # noqa: E731  a bounded sample's texts
    distinct = lambda t: np.unique(word_bins(t, BINS))
    positive, n_positive = bin_counts(once(few), distinct, BINS)
    everywhere, n = distinct_counts(texts, np.flatnonzero(positive))
    use = chosen(positive, n_positive, everywhere, n, prior)

    def packed(text: str | None) -> bytes:
        bins = distinct(text)
        return bins[np.isin(bins, use)].astype(np.int32).tobytes()

    pos, unl = ([np.frombuffer(x, np.int32) for x in made_of(texts, ids, packed).values()] for ids in (few, smallest(known_ids(texts), unlabelled, seed + 1)))
    return score(docs, *fit_nnpu(pos, unl, prior, use))
