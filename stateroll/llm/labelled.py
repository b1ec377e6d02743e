"""What the two trained text scorers share: a bounded sample of labelled documents, held-out rows, and logistic weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stateroll.llm.common import column

#: Labelled documents that a model is fitted on, at most: those whose ids hash lowest.
MAX_TRAINING_DOCS = 20_000


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether a row's label is not to be learned from. A null id is never held out."""
    return F.coalesce(F.crc32(column(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, fold: int, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAINING_DOCS) -> DataFrame:
    """(text, label, part): `most` labelled documents at most that aren't held out; part is 0 to 2 by the id's hash.

    Ids with rows of both labels and null labels are left out; of documents that share an id one is taken.
    """
    known = labels.where(column(label_col).isin(0, 1) & column(id_col).isNotNull() & ~held_out(id_col, folds, fold)).groupBy(column(id_col).alias("label_id")).agg(F.min(column(label_col)).cast("int").alias("label"), F.max(column(label_col)).cast("int").alias("high"))
    known = known.where("label = high").orderBy(F.xxhash64("label_id"), "label_id").limit(most).select("label_id", "label")
    # at most `most` rows of two numbers: small enough to broadcast whatever the corpus
    texts = docs.select(column(id_col).alias("doc_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    # one row an id: ids that repeat add no training rows (the window's limit works before its shuffle, too)
    one = F.row_number().over(W.partitionBy("label_id").orderBy(F.xxhash64("text"), "text"))
    return texts.withColumn("n", one).where("n = 1").select("text", "label", F.pmod(F.xxhash64("label_id"), F.lit(3)).cast("int").alias("part"))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights by damped Newton steps; the first column of x is 1 and isn't shrunk. One class only: the smoothed rate."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -2.0
        return w
    shrink = np.full(len(w), l2)
    shrink[0] = 1e-6
    loss = np.inf
    for _ in range(rounds):
        z = np.clip(x @ w, -30, 30)
        p = 1 / (1 + np.exp(-z))
        grad = x.T @ (p - y) + shrink * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(w)), grad)
        scale = 1.0
        while scale > 1e-4:
            new = w - scale * step
            z = np.clip(x @ new, -30, 30)
            now = np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(shrink * new * new)
            if now <= loss:
                break
            scale /= 2
        if scale <= 1e-4 or loss - now < 1e-9:
            break
        w, loss = new, now
    return w


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
