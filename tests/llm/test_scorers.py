import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stateroll.llm import quality, toxicity
from stateroll.llm.labelled import held_out, logistic, sample
from stateroll.llm.queries import QUERIES
from tests.llm import oracle

BAD = ["blorg", "zniff", "krump", "réeuxt", "réeuxaq"]


def corpus(n, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "on", "ré", "th", "le"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for k in range(n):
        words = [word() + rng.choice(["", "", "", ".", ","]) for _ in range(rng.randint(5, 80))]
        toxic, low = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = " ".join(words)
        docs.append((k, "!! ".join(text.upper().split()) if low else text))
        labels.append((k, int(not low), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus(900)
    docs += [(None, "x"), (5000, None), (5001, ""), (5002, "a" * 300_000), (5003, ("blorg " * 3 + ". ") * 20_000)]
    labels += [(5000, None, None), (3, None, None), (None, 1, 1)]
    d = spark.createDataFrame([(i, t, 0.5, "s") for i, t in docs], "doc_id long, text string, score double, label string")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, (b, c)) for a, b, c in labels[:900])


@pytest.mark.parametrize(("op", "place", "folds", "fold"), [(toxicity, 1, 3, 1), (quality, 0, 4, 2)])
def test_held_out_accuracy(frames, op, place, folds, fold):
    docs, labels, truth = frames
    rows = op.score(docs, op.train(docs, labels)).select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", "predicted").collect()
    assert len(rows) == 905
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)
    known = [(truth[r.doc_id][place], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in known]) > 0.93
    if op is toxicity:
        assert next(r for r in rows if r.doc_id == 5003).predicted == 1
        kept = op.without_toxic(docs, op.train(docs, labels))
        assert kept.columns == docs.columns
        assert kept.count() == sum(r.predicted == 0 for r in rows)


def test_training_takes_no_held_out_label(frames):
    docs, labels, _ = frames
    for label in ("toxic", "quality"):
        got = sample(docs, labels, label, 3, 1)
        texts = {r.text for r in docs.where(held_out("doc_id", 3, 1)).select("text").collect()}
        assert not texts & {r.text for r in got.collect()}
    assert sample(docs, labels, "toxic", 3, 1, most=50).count() == 50


@pytest.mark.parametrize("op", [toxicity, quality])
def test_no_labels_one_class_no_documents(spark, frames, op):
    docs, labels, _ = frames
    none = op.score(docs.limit(5), op.train(docs, labels.limit(0))).collect()
    assert len(none) == 5 and all(r.predicted == 0 for r in none)
    one = op.score(docs.limit(5), op.train(docs, labels.selectExpr("doc_id", "1 AS quality", "1 AS toxic"))).collect()
    assert all(r.predicted == 1 for r in one)
    assert op.score(docs.limit(0), op.train(docs.limit(0), labels)).count() == 0


def test_grammar_kinds():
    t = toxicity

    def found(*symbols):
        return t.matches([(s if s >= 0 else -s, 2.0, s < 0) for s in symbols])  # below zero: a gap is before it

    assert found(t.TARGET, t.INSULT) == [(t.DIRECTED, 2.0)]
    assert found(t.TARGET, -t.INSULT) == [(t.PLAIN, 2.0)]
    assert found(t.INSULT, t.TARGET) == [(t.DIRECTED, 2.0)]
    assert found(t.INSULT, -t.TARGET) == [(t.PLAIN, 2.0)]
    assert found(t.NEGATION, t.INSULT) == [(t.PLAIN + 1, 2.0)]
    assert found(t.NEGATION, -t.INSULT) == [(t.PLAIN, 2.0)]
    assert found(t.INSULT, t.NEGATION) == [(t.PLAIN, 2.0)]
    assert found(t.REPORT, t.TARGET, t.INSULT, t.INSULT) == [(t.DIRECTED + 2, 2.0), (t.DIRECTED + 2, 2.0)]
    # a threat needs its target after it, and near
    assert found(t.THREAT, t.TARGET) == [(t.THREATS_MADE, t.THREAT_WEIGHT)]
    assert found(t.TARGET, t.THREAT) == found(t.THREAT, -t.TARGET) == found(t.THREAT) == []
    assert found(t.REPORT, t.NEGATION, t.THREAT, t.TARGET) == [(t.THREATS_MADE + 1, t.THREAT_WEIGHT)]


def test_clauses_by_kind():
    raw = b"blorg"
    h = toxicity.hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([5]))
    m = toxicity.Matcher(h, np.array([4.5]))
    f = m.features(pa.array(["You blorg! It is fine. They said you blorg, not that.", "blorg is fine", "no", None, "BLORG. blorg", "i will kill them", "they kill time", "not a blorg"]))
    kind = lambda row, k: f[row, 8 + k]
    one = np.log1p(4.5)
    assert kind(0, toxicity.DIRECTED) == one and kind(0, toxicity.DIRECTED + 2) == one and f[0, 1] == 4.5 and np.allclose(f[0, 2], one)
    assert kind(1, toxicity.PLAIN) == one and kind(1, toxicity.DIRECTED) == 0
    assert not f[2, 1:7].any() and f[3, 7] == 0
    assert np.allclose(f[4, 5], np.log1p(2)) and kind(4, toxicity.PLAIN) == np.log1p(9)
    assert kind(5, toxicity.THREATS_MADE) == np.log1p(toxicity.THREAT_WEIGHT)
    assert not f[6, 1:7].any() and not f[6, 8:].any()
    assert kind(7, toxicity.PLAIN + 1) == one and f[7, 1] == 0


@pytest.mark.parametrize("op", [toxicity, quality])
def test_repeated_rows_teach_once(frames, op):
    docs, labels, _ = frames
    again = docs.union(docs.where("doc_id % 7 = 3")).union(docs.where("doc_id = 10").crossJoin(docs.sparkSession.range(300)).drop("id"))
    label = "toxic" if op is toxicity else "quality"
    assert sample(again, labels, label, 3, 1).count() == sample(docs, labels, label, 3, 1).count()
    rows = lambda df: {(r.doc_id, r.score) for r in op.score(df, op.train(df, labels)).collect()}
    assert rows(again) == rows(docs)


def test_discriminant_uses_both_covariances():
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 1, (400, 3)), rng.normal(0, 4, (400, 3))]
    y = np.r_[np.zeros(400), np.ones(400)]
    d = quality.Discriminant(x, y).difference(x)
    assert ((d > 0) == y).mean() > 0.85  # equal means: only the covariances tell them apart


def test_logistic():
    rng = np.random.default_rng(1)
    x = np.c_[np.ones(500), rng.normal(size=500)]
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * x[:, 1]))).astype(float)
    assert 1.5 < logistic(x, y)[1] < 2.5


@pytest.mark.parametrize(("name", "label", "least"), [("op8_toxicity", "toxic", 0.9), ("op9_quality", "quality", 0.95)])
def test_query(spark, name, label, least):
    folder = f"{oracle.ROOT}/sf0.01"
    got = QUERIES[name](spark, folder)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    known = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r[label] for r in known]) > least
