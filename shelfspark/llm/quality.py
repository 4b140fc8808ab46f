"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

The terms of a document are its words (``WORDS`` bins) and its surface terms (``SHAPES`` bins, see ``features.shape_bins``),
weighted (1 + log count) * idf and projected on the leading ``DIMS`` singular vectors of the voters. Document frequencies are
counted over all documents, one row a bin. At most ``neighbours_from`` labelled rows outside the held-out fold, chosen by a
hash of the id, evenly from both labels, fit the projection and are the voters; that bound is also the bound of what is
broadcast (voters x DIMS floats). Every document, whole, meets every voter in blocked cosine products, and its ``k`` nearest
vote with weight max(0, cosine) ** ``power``, each label's votes divided by its share of the voters.

Defined cases: null text as empty; a text without words has the zero vector, no vote and score 0; of voters equally near as
the kth those with the smaller id vote; no voters: score 0.5; null ids and repeated rows are scored like any; very long texts
are read whole; an empty table gives an empty result; ``score`` takes only the id and the text of its input, and
``keep_good`` keeps all its columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bin_counts, held_out, known_ids, made_of, smallest
from .features import shape_bins, word_bins

SHAPES, WORDS, DIMS = 2048, 4096, 48
TERMS = SHAPES + WORDS
#: How much a word's weight counts beside a surface term's.
WORD_SHARE = 0.5


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The bins of a text's terms, and the weight of each before its IDF."""
    count = np.bincount(np.concatenate([shape_bins(text, SHAPES), SHAPES + word_bins(text, WORDS)]), minlength=TERMS)
    at = np.flatnonzero(count)
    return at.astype(np.int32), (1 + np.log(count[at])).astype(np.float32)


def _packed(text: str | None) -> bytes:
    at, w = terms(text)
    return at.tobytes() + w.tobytes()


def _unpacked(row: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row, np.int32, len(row) // 8), np.frombuffer(row, np.float32, offset=len(row) // 2)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.maximum(n, 1e-12), 0).astype(np.float32)


def _project(rows: list[tuple[np.ndarray, np.ndarray]], project: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), project.shape[1]), np.float32)
    for i, (at, w) in enumerate(rows):
        if len(at):
            out[i] = w @ project[at]
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, seen: np.ndarray, n: int, dims: int = DIMS, rounds: int = 8, block: int = 256) -> dict:
    """The leading singular vectors of the voters' terms by subspace iteration; only ``block`` voters are dense at a time.
    seen: in how many of n documents each term stands."""
    idf = (np.log((1 + n) / (1 + np.minimum(seen, n))) + 1).astype(np.float32)
    idf[SHAPES:] *= WORD_SHARE
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(TERMS, dims + 8)))[0].astype(np.float32)
    for _ in range(rounds):
        y = np.zeros_like(q)
        for a in range(0, len(rows), block):
            x = np.zeros((min(block, len(rows) - a), TERMS), np.float32)
            for i, (at, w) in enumerate(rows[a : a + block]):
                x[i, at] = w * idf[at]
            x = _unit(x)
            y += x.T @ (x @ q)
        q = np.linalg.qr(y)[0]
    project = (idf[:, None] * q[:, :dims]).astype(np.float32)
    return {"project": project, "voters": _unit(_project(rows, project)), "label": label.astype(np.float32)}


def vote(model: dict, texts: list[str | None], k: int, power: float, block: int = 256) -> np.ndarray:
    out = np.full(len(texts), 0.5)
    voters, label = model["voters"], model["label"]
    if not len(voters):
        return out
    share = np.array([max(1, (label == 0).sum()), max(1, (label == 1).sum())]) / len(label)
    k = min(k, len(label))
    for a in range(0, len(texts), block):
        cos = _unit(_project([terms(t) for t in texts[a : a + block]], model["project"])) @ voters.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        kth = np.take_along_axis(cos, near, 1).min(1)
        for i in np.flatnonzero((cos >= kth[:, None]).sum(1) > k):
            above = np.flatnonzero(cos[i] > kth[i])
            near[i] = np.concatenate([above, np.flatnonzero(cos[i] == kth[i])[: k - len(above)]])
        w = np.maximum(np.take_along_axis(cos, near, 1), 0) ** power
        one, zero = (w * label[near]).sum(1) / share[1], (w * (1 - label[near])).sum(1) / share[0]
        out[a : a + block] = np.where(one + zero > 0, one / np.maximum(one + zero, 1e-12), 0)
    return out


def train(docs: DataFrame, labels: DataFrame, neighbours_from: int = 4000, seed: int = 5) -> dict:
    known = labels.where(~held_out()).where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).join(known_ids(docs), "doc_id", "left_semi")
    label: dict[int, int] = {}
    for value in (0, 1):
        some = smallest(known.where(F.col("quality") == value), neighbours_from // 2, seed).select("doc_id").collect()
        label |= {r[0]: value for r in some}
    if not label:
        return {"project": np.zeros((TERMS, DIMS), np.float32), "voters": np.zeros((0, DIMS), np.float32), "label": np.zeros(0, np.float32)}
    ids = docs.sparkSession.createDataFrame([(i,) for i in label], "doc_id long")
    made = made_of(docs, ids, _packed)
    seen, n = bin_counts(docs.select("text"), lambda t: terms(t)[0], TERMS)
    return fit([_unpacked(x) for x in made.values()], np.array([label[i] for i in made]), seen, n)


def score(docs: DataFrame, model: dict, k: int = 15, power: float = 1.0, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = vote(shared.value, batch.column(2).to_pylist(), k, power)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], [id_col, "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), held_out(id_col).alias("held_out"), text_col).mapInArrow(run, f"{id_col} long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict, k: int = 15, power: float = 1.0, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def p(text):
        import pandas as pd

        return pd.Series(vote(shared.value, text.tolist(), k, power))

    return docs.where(p(F.coalesce(F.col(text_col), F.lit(""))) >= threshold)
