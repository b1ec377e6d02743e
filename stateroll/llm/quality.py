"""Quality by a regularised quadratic discriminant.

Each text becomes a few transformed statistics (sizes, shares of letters, capitals, marks and symbols, repeated words
and lines). Each class has a mean and a covariance, shrunk towards the pooled covariance and its diagonal; a text's
score comes from the difference of the two Mahalanobis log-densities, for which the Cholesky factors are computed once
and sent with the model. The difference is brought to 0..1 by a logistic fit on labelled documents that the
densities weren't fitted on. Bounded sample (labelled.MAX_TRAINING_DOCS); texts are read whole; no input but the text;
no shuffle but the sample's.

Defined cases: null is empty; empty texts have statistics like any other; very long texts are read whole; no labels
or one class: score by base rate; a tie at the threshold is predicted 1; repeated rows get equal rows, and teach once;
an empty table gives none; only id and text are read, so no other column's name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stateroll.llm.common import map_texts, small_batches, steps, table, text_buffers, written
from stateroll.llm.labelled import held_out, logistic, probability, sample
from stateroll.llm.textarrays import LOWER, hashes, spans

FOLDS, FOLD, THRESHOLD = 4, 2, 0.7
#: Share of the pooled covariance in a class's, of the diagonal in both, and the least variance.
SHRINK, DIAGONAL, FLOOR = 0.3, 0.05, 1e-3
#: Standard deviations beyond which a statistic counts as that far.
CLIP = 6.0


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


UPPER, SPACE, DIGIT = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes(" \t\r\n\v\f"), _bytes("0123456789")
SMALL = _bytes("abcdefghijklmnopqrstuvwxyz")
MARKS = [_bytes("!"), _bytes("|"), _bytes("*#%$&"), _bytes(".,"), _bytes("<>{}[]@/=_\\~^`\"()"), _bytes("\n")]


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different h each doc has, and how often its most frequent one occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])])
    most = np.zeros(n)
    np.maximum.at(most, d[first], np.diff(np.r_[first, len(d)]))
    return np.bincount(d[first], minlength=n).astype(np.float64), most


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    begin, end = spans(~SPACE[data], offsets)
    doc = np.searchsorted(offsets, begin, "right") - 1
    words = np.bincount(doc, minlength=n).astype(np.float64)
    low = LOWER[data]
    h = hashes(low, begin, end)
    different, most = _distinct(doc, h, n)
    next_ = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1])) if len(h) else np.zeros(0, np.int64)
    again = np.bincount(doc[next_], minlength=n)
    pairs = np.flatnonzero(doc[1:] == doc[:-1]) if len(h) else np.zeros(0, np.int64)
    pair_different, _ = _distinct(doc[pairs], h[pairs] * np.uint64(3) + h[pairs + 1] if len(pairs) else h, n)
    n_pairs = np.maximum(np.bincount(doc[pairs], minlength=n), 1)
    line_begin, line_end = spans(data != 10, offsets)
    line_doc = np.searchsorted(offsets, line_begin, "right") - 1
    lines = np.bincount(line_doc, minlength=n).astype(np.float64)
    line_different, _ = _distinct(line_doc, hashes(low, line_begin, line_end), n)
    length = (end - begin).astype(np.float64)
    mean = np.bincount(doc, length, minlength=n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(doc, length * length, minlength=n) / np.maximum(words, 1) - mean * mean, 0))
    share = lambda x, of: np.log((x + 0.5) / (of - x + 0.5))  # noqa: E731  of shares: log-odds, so that small ones spread
    upper, small = _sums(UPPER[data], offsets), _sums(SMALL[data], offsets)
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(spread), share(upper, upper + small), share(_sums(SPACE[data], offsets), size), share(_sums(DIGIT[data], offsets), size),
        *(share(np.minimum(_sums(m[data], offsets), size), size) for m in MARKS),
        share(different, words), share(np.maximum(most - 1, 0), np.maximum(words, 1)), share(again, words + 1), share(pair_different, n_pairs), share(line_different, lines), np.log1p(lines), np.log1p(size / np.maximum(lines, 1)),
    ]
    return np.stack(columns, 1)


def statistics(texts: pa.Array) -> np.ndarray:
    texts = texts.fill_null("") if texts.null_count else texts
    out = [_statistics(*text_buffers(texts.slice(a, b - a))) for a, b in steps(np.array(pc.binary_length(texts), np.int64))]
    return np.concatenate(out) if out else np.zeros((0, 20))


class Discriminant:
    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.centre, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = self.transform(x)
        covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
        share = [(y == k).mean() for k in (0, 1)]
        pooled = share[0] * covs[0] + share[1] * covs[1]
        self.means = [z[y == k].mean(0) for k in (0, 1)]
        self.factors, self.constants = [], []
        for k in (0, 1):
            s = (1 - SHRINK) * covs[k] + SHRINK * pooled
            s = (1 - DIAGONAL) * s + DIAGONAL * np.diag(np.diag(s)) + FLOOR * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            self.factors.append(np.linalg.inv(factor))
            self.constants.append(np.log(share[k]) - np.log(np.diag(factor)).sum())

    def transform(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -CLIP, CLIP)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        z = self.transform(x)
        log = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return log[1] - log[0]


def squeezed(d: np.ndarray) -> np.ndarray:
    """1 and the difference, which densities overstate far out, on a signed log scale."""
    return np.stack([np.ones(len(d)), np.sign(d) * np.log1p(np.abs(d))], 1)


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, part: np.ndarray) -> None:
        fit = part > 0
        self.discriminant, self.weights = None, np.zeros(2)
        if min((y[fit] == 0).sum(), (y[fit] == 1).sum()) < 2:
            self.weights = logistic(np.ones((len(y), 2)), np.ones(len(y))) if len(y) and y.min() == y.max() == 1 else np.array([-2.0 if not len(y) or y.max() == 0 else 0.0, 0.0])
            self.weights[1] = 0
            return
        self.discriminant = Discriminant(x[fit], y[fit])
        self.weights = logistic(squeezed(self.discriminant.difference(x[~fit])), y[~fit])

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.discriminant is None:
            return np.full(len(texts), probability(self.weights[:1])[0])
        return probability(squeezed(self.discriminant.difference(statistics(texts))) @ self.weights)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, fold: int = FOLD) -> Model:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("part"), pa.array(list(statistics(b.column("text"))), pa.list_(pa.float64()))], names=["label", "part", "x"])

    small_batches(docs.sparkSession)
    known = sample(docs, labels, label_col, folds, fold, id_col, text_col)
    got = written(known.mapInArrow(rows, "label int, part int, x array<double>")).toPandas()
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, 20))
    return Model(x, got["label"].to_numpy(np.float64), got["part"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: its id, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(_, texts: pa.Array) -> dict:
            s = shared.value.score(texts)
            return {"score": pa.array(s), "predicted": pa.array((s >= THRESHOLD).astype(np.int32))}

        return run

    return map_texts(docs, id_col, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, "id").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", "predicted")
