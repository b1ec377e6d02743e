"""Scores of whole tables against plain Python: words as bytes, dictionaries for counts, clauses read by rules."""

import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from stateroll.llm import quality, toxicity
from stateroll.llm.labelled import logistic
from stateroll.llm.queries import QUERIES
from tests.llm import oracle

FOLDER = f"{oracle.ROOT}/sf0.01"


def learned_from(texts, labels, folds, fold):
    """(text, label, part) of the labelled documents that aren't held out."""
    out = []
    for doc, label in sorted(labels.items()):
        if doc in texts and zlib.crc32(str(doc).encode()) % folds != fold:
            h = struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", doc), 42)))[0]
            out.append((texts[doc], label, h % 3))
    return out


def sigmoid(z):
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


@pytest.fixture(scope="module")
def known(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    return texts, labels


def held(spark, name, expected):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert len(rows) == len(expected) and {r.doc_id for r in rows} == set(expected)
    for r in rows:
        assert r.score == pytest.approx(expected[r.doc_id], abs=1e-6), r.doc_id


def facts(text):
    """The statistics of a text, one by one."""
    raw = text.encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    words, lines = ([w for w in re.split(blanks, low) if w] for blanks in (rb"[ \t\r\n\v\f]+", rb"\n"))
    share = lambda x, of: math.log((x + 0.5) / (of - x + 0.5))
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    size, n = len(raw), len(words)
    mean = sum(map(len, words)) / max(n, 1)
    spread = math.sqrt(max(sum(len(w) ** 2 for w in words) / max(n, 1) - mean * mean, 0))
    upper, small = (sum(a <= c <= b for c in raw) for a, b in (b"AZ", b"az"))
    pairs = list(zip(words, words[1:]))
    most = max(Counter(words).values(), default=0)
    return [
        math.log1p(size), math.log1p(n), math.log1p(mean), math.log1p(spread), share(upper, upper + small), share(count(b" \t\r\n\v\f"), size), share(count(b"0123456789"), size),
        *(share(count(m), size) for m in (b"!", b"|", b"*#%$&", b".,", b"<>{}[]@/=_\\~^`\"()", b"\n")),
        share(len(set(words)), n), share(max(most - 1, 0), max(n, 1)), share(sum(a == b for a, b in pairs), n + 1), share(len(set(pairs)), max(len(pairs), 1)), share(len(set(lines)), len(lines)), math.log1p(len(lines)), math.log1p(size / max(len(lines), 1)),
    ]


def test_quality_by_hand(spark, known):
    texts, labels = known
    rows = learned_from(texts, {r.doc_id: r.quality for r in labels}, 4, 2)
    x, y, part = np.array([facts(t) for t, _, _ in rows]), np.array([label for _, label, _ in rows]), np.array([p for _, _, p in rows])
    fit, centre, scale = part > 0, x[part > 0].mean(0), np.maximum(x[part > 0].std(0), 1e-6)
    z = lambda v: np.clip((np.array(v) - centre) / scale, -6, 6)
    of = [z(x[fit & (y == k)]) for k in (0, 1)]
    covs = [(c - c.mean(0)).T @ (c - c.mean(0)) / len(c) for c in of]
    pooled = sum(len(c) * s for c, s in zip(of, covs)) / fit.sum()
    shrunk = [0.7 * s + 0.3 * pooled for s in covs]
    shrunk = [0.95 * s + 0.05 * np.diag(np.diag(s)) + 0.001 * np.eye(len(s)) for s in shrunk]

    def squeezed(v):
        logs = []
        for c, s in zip(of, shrunk):
            gap = z(v) - c.mean(0)
            logs.append(math.log(len(c) / fit.sum()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * gap @ np.linalg.solve(s, gap))
        d = logs[1] - logs[0]
        return math.copysign(math.log1p(abs(d)), d)

    w = logistic(np.array([[1.0, squeezed(v)] for v in x[~fit]]), y[~fit].astype(float))
    held(spark, "op9_quality", {doc: sigmoid(w[0] + w[1] * squeezed(facts(t))) for doc, t in texts.items()})


WORD = re.compile(rb"[a-z\x80-\xff]+|[.!?;:\n]|[^a-z\x80-\xff.!?;:\n]+")
LISTS = {w.encode(): kind for kind, words in (("threat", toxicity.THREATS), ("target", toxicity.TARGETS), ("negation", toxicity.NEGATIONS), ("report", toxicity.REPORTS)) for w in words.split()}


def clauses(text):
    out = [[]]
    for m in WORD.findall(text.lower().encode()):
        if m in (b".", b"!", b"?", b";", b":", b"\n"):
            out.append([])
        elif m[:1].isalpha() or m[0] >= 128:
            out[-1].append(m)
    return out


def arcs(word):
    return [] if len(word) < 3 else [(word, True), *((word[:n], False) for n in range(3, 11) if len(word) > n)]


def heard(clause, odds):
    """Kind to heaviest weight of a clause's matches, by rules over chains of words that are near each other."""
    marked = []
    for place, word in enumerate(clause):
        weight = max((odds.get(a, 0.0) for a in arcs(word)), default=0.0)
        kind = "insult" if weight > 0 else LISTS.get(word)
        if kind:
            marked.append((place, kind, weight))
    chains, said, out = [], False, Counter()
    for place, kind, weight in marked:
        if not chains or place - last > 5:  # more than four other words between
            chains.append([])
        chains[-1].append((kind, weight))
        last = place
    for chain in chains:
        targets = [k for k, (kind, _) in enumerate(chain) if kind == "target"]
        insults = [k for k, (kind, _) in enumerate(chain) if kind == "insult"]
        aimed = {k for k in insults if targets and k > targets[0]} | {max((k for k in insults if targets and k < targets[0]), default=None)}
        negated = deed = False
        for k, (kind, weight) in enumerate(chain):
            turned = 1 if negated else 2 if said else 0
            if kind == "insult":
                out[(3 if k in aimed else 0) + turned] = max(out[(3 if k in aimed else 0) + turned], weight)
            if kind == "target" and deed:
                out[6 + turned], deed = 3.0, False
            deed, negated, said = deed or kind == "threat", negated or kind == "negation", said or kind == "report"
    return {k: w for k, w in out.items() if w}


def features(text, odds):
    read = clauses(text)
    found, n = [heard(c, odds) for c in read], sum(map(len, read))
    told = [m[k] for m in found for k in (0, 3, 6) if k in m]
    return [1.0, max(told, default=0), math.log1p(sum(told)), *(math.log1p(sum(w > least for w in told)) for least in (2, 3, 4)), sum(told) / math.sqrt(n + 5), math.log1p(n) / 5, *(math.log1p(sum(m.get(k, 0) for m in found)) for k in range(9))]


def test_toxicity_by_hand(spark, known):
    texts, labels = known
    rows = learned_from(texts, {r.doc_id: r.toxic for r in labels}, 3, 1)
    taught = [(t, label) for t, label, part in rows if part > 0]
    docs, toxic = Counter(), Counter()
    for text, label in taught:
        have = {a for c in clauses(text) for w in c for a in arcs(w)}
        docs.update(have)
        toxic.update(have if label else ())
    n = [sum(label == k for _, label in taught) for k in (0, 1)]
    odds = {}
    for arc, t in toxic.items():
        a, b = t + 0.5, docs[arc] - t + 0.5
        value = math.log(a / (n[1] + 1)) - math.log(b / (n[0] + 1)) - math.sqrt(1 / a + 1 / b)
        if t >= 3 and value > 1.5:
            odds[arc] = value
    assert 0 < len(odds) < toxicity.MAX_ARCS
    rest = [(features(t, odds), label) for t, label, part in rows if part == 0]
    w = logistic(np.array([f for f, _ in rest]), np.array([float(label) for _, label in rest]))
    held(spark, "op8_toxicity", {doc: sigmoid(float(np.dot(features(t, odds), w))) for doc, t in texts.items()})


def test_clauses_by_rules_and_by_the_grammar():
    """Random clauses: what the composed transducers accept is what the rules say."""
    rng = np.random.default_rng(8)
    odds = {(b"blorg", True): 4.5, (b"znif", False): 2.5}
    words = [b"blorg", b"zniffy", b"you", b"kill", b"not", b"said", b"tree", b"tree", b"tree"]
    h = lambda raw: toxicity.hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]
    table = np.array([h(b"blorg"), h(b"znif") ^ toxicity.STEM])
    order = np.argsort(table)
    matcher = toxicity.Matcher(table[order], np.array([4.5, 2.5])[order])
    texts = [" ".join(words[k].decode() for k in rng.integers(0, len(words), rng.integers(0, 14))) + ". " + "Tree, blorg tree you!" * int(rng.integers(0, 2)) for _ in range(2000)]
    import pyarrow as pa

    got = matcher.features(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        assert np.allclose(row, features(text, odds), atol=1e-12), text
