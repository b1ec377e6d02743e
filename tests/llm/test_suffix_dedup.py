import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from stateroll.llm import suffix_dedup as op
from stateroll.llm.queries import QUERIES
from tests.llm import oracle


def brute(docs, width):
    seen = Counter(raw[i : i + width] for _, t in docs for raw in [(t or "").encode()] for i in range(len(raw) - width + 1))
    out = []
    for doc, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - width + 1):
            if seen[raw[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(raw) else 0
        out.append((doc, hashlib.sha256(kept).hexdigest(), len(raw), int(gone[: len(raw)].sum()), spans))
    return sorted(out, key=str)


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    passage = [" ".join(word() for _ in range(n)) for n in (40, 55, 60, 90)]
    docs = []
    for k in range(30):
        parts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passage)[rng.randint(0, 40) :])
        docs.append((k, " ".join(parts)))
    twice = " ".join(word() for _ in range(60))
    docs += [(40, twice + " x " + twice), (41, None), (42, ""), (43, "ab" * 200), (44, "ab" * 99), (45, docs[3][1]), (46, docs[3][1]), (7, docs[7][1]), (None, docs[5][1]), (47, docs[6][1][1:]), (48, "z" * 200), (49, "z" * 199)]
    docs += [(60 + k, passage[3][k:] + str(k)) for k in range(12)]
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute_force(spark, seed):
    docs = fixture(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_bytes long")
    assert oracle.frame(op.removals(df)) == brute(docs, 200)


def test_small_steps_and_large_grams(spark, monkeypatch):
    docs = fixture(4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(op, "STEP", 700)
    assert oracle.frame(op.removals(df)) == brute(docs, 200)
    monkeypatch.setattr(op, "KINDS", 2)
    assert oracle.frame(op.removals(df)) == brute(docs, 200)


def test_passage_of_many_surroundings(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    passage = word(260)
    docs = [(k, word(rng.randint(0, 150)) + passage + word(rng.randint(0, 150))) for k in range(60)]
    docs += [(100 + k, passage[k : k + 199] + word(40)) for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(op, "KINDS", 8)
    assert oracle.frame(op.removals(df)) == brute(docs, 200)


def test_very_long_texts(spark):
    rng = random.Random(10)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_500_000))
    docs = [(1, long), (2, "x" + long[1_048_000:1_049_000] + "y"), (3, long[2_000_000:2_000_199])]
    got = {r.doc_id: r for r in op.removals(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [(got[k].n_bytes, got[k].n_removed, got[k].n_spans) for k in (1, 2, 3)] == [(2_500_000, 1000, 1), (1002, 1000, 1), (199, 0, 0)]


def test_text_left(spark):
    shared = "é" * 150
    docs = [(1, "a" + shared + "bc"), (2, "xyz" + shared), (3, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS row", "'q' AS spans")
    got = op.without_repeats(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text, r.row) for r in got.collect()) == [(1, "abc", 7), (2, "xyz", 7), (3, "", 7)]


def test_spans_that_cut_characters():
    raw = "aéb".encode()
    assert op.whole_characters(raw, [(2, 4)]) == [(3, 4)]
    assert op.whole_characters(raw, [(0, 2)]) == [(0, 1)]
    assert op.whole_characters(raw, [(2, 3)]) == []


def test_least_in_window():
    rng = np.random.default_rng(1)
    for n, w in ((1, 1), (5, 5), (40, 7), (43, 7), (100, 1), (64, 8)):
        v = rng.integers(0, 6, n).astype(np.uint64)
        assert op.least_in_window(v, w).tolist() == [i + int(np.argmin(v[i : i + w])) for i in range(n - w + 1)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.removals(df).count() == 0


def test_query(spark):
    assert oracle.frame(QUERIES["op7_suffix_dedup"](spark, oracle.SF)) == brute(oracle.rows("SELECT doc_id, text FROM documents"), 200)


def test_repeated_rows_add_nothing_to_a_group(spark):
    docs = fixture(5)
    docs += [(3, docs[3][1])] * 40 + [(None, docs[5][1])] * 40
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for r in op.repeated_spans(op._keyed(df, "doc_id", "text")).collect():
        assert len(r.spans) == len(set(r.spans))
    assert oracle.frame(op.removals(df)) == brute(docs, 200)
