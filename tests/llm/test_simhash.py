import random
import re

import pytest
import xxhash

from stateroll.llm import simhash as op
from stateroll.llm.components import components
from stateroll.llm.queries import QUERIES
from tests.llm import oracle


def plain(text):
    low = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(prints):
    """prints: (id, fp). The least id of each one's component, by all pairs."""
    label = {}
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    for i, f in prints:
        if i is not None:
            label[find(f)] = min(i, label.get(find(f), i))
    return [(i, f, label.get(find(f))) for i, f in prints]


def test_fingerprint():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "One", "one TWO", "a\x1cb\x85c d", "É é"] + ["".join(rng.choice("ab AB\n\té") for _ in range(rng.randint(1, 300))) for _ in range(50)]
    assert [op.fingerprint(t) for t in texts] == [plain(t) for t in texts]


def near_texts(seed):
    rng = random.Random(seed)
    base = [[rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 99)) for _ in range(60)] for _ in range(12)]
    out = []
    for k in range(160):
        w = list(base[k % 12])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            w[rng.randrange(60)] = f"new{rng.randint(0, 9)}"
        out.append((k, " ".join(w)))
    return out + [(200, None), (201, ""), (7, out[7][1]), (None, out[3][1]), (None, "alone entirely here now"), (202, "  ")]


@pytest.mark.parametrize("bucket", [1024, 2])
def test_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(op, "BUCKET", bucket)
    docs = near_texts(bucket)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, component long")
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component) for r in op.near_duplicates(df).collect()), key=str)
    want = sorted(groups([(i, plain(t)) for i, t in docs]), key=str)
    assert got == want
    kept = op.one_of_each_group(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted({c for _, _, c in want}, key=str)  # one of them null: the group that has no id
    assert kept.exceptAll(df).isEmpty()


@pytest.mark.parametrize("bucket", [1024, 8])
def test_links_of_a_dense_ball(spark, monkeypatch, bucket):
    monkeypatch.setattr(op, "BUCKET", bucket)
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & ((1 << 64) - 1) for c in centres for _ in range(120)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    rows = components(op.links(df)).collect()
    root = {r.node % (1 << 64): r.root for r in rows}
    want = groups(list(enumerate(fps)))
    ours = {f: root.get(f, f) for f in fps}
    assert len({ours[f] for f in fps}) == len({c for *_, c in want})
    by = {}
    for _, f, c in want:
        by.setdefault(c, set()).add(ours[f])
    assert all(len(x) == 1 for x in by.values())


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 50)] + [(300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 1 for k in range(1, 50)}


def test_one_row_stays_of_equal_ids_and_of_very_long_texts(spark):
    long = "word " * 300_000
    rows = [(None, None, "a"), (None, "", "b"), (0, "", "c"), (0, None, "d"), (5, long + "x", "e"), (6, long + "y", "f"), (6, long + "y", "g")]
    df = spark.createDataFrame(rows, "`doc.id` long, `the.text` string, row string")
    got = op.one_of_each_group(df, "doc.id", "the.text")
    assert got.columns == df.columns
    assert sorted(r["doc.id"] for r in got.collect()) == [0, 5]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.near_duplicates(df).count() == 0
    assert op.one_of_each_group(df).count() == 0


def test_query(spark):
    got = oracle.frame(QUERIES["op2_simhash"](spark, oracle.SF))
    docs = oracle.rows("SELECT doc_id, text FROM documents")
    want = sorted(((c, i, f"{f:016x}") for i, f, c in groups([(i, plain(t)) for i, t in docs])), key=str)
    assert got == want
