import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import stateroll.llm.spelling as module
from stateroll.llm.spelling import FmIndex, Shard, dealt, spelling_groups, suffix_order


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_force(docs):
    """docs: (id, text). By the definition, each word against all others of nearly its length."""
    lower = {c: c + 32 for c in range(65, 91)}
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 3}
    # words one edit apart share a word with one code point less, or are that word
    holes = {}
    for w in counts:
        for v in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            holes.setdefault(v, set()).add(w)
    near = {w: {x for v in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))} for x in holes[v] if one_edit(w, x)} for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def random_words(rng, letters, n, least=5, most=9):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(n)})


@pytest.mark.parametrize("letters", ["ab", "abcdé", "aàÿzþ×÷"])
def test_index_finds_all(letters):
    rng = random.Random(len(letters))
    words = random_words(rng, letters, 400)
    found = set()
    for half in (True, False):
        shard = Shard(half, [w.encode("latin-1") for w in words], [1] * len(words))
        for q in words:
            codes = shard.index.code[np.frombuffer(q.encode("latin-1"), np.uint8)].reshape(1, -1)
            exact = len(q) // 2 if half else len(q) - len(q) // 2
            who, got = shard.index.one_edit(codes[:, ::-1] if half else codes, exact)
            mine = [(q, words[k]) for k in got]
            assert len(set(mine)) == len(mine)
            end = q[:exact] if half else q[-exact:]
            assert set(mine) == {(q, x) for x in words if one_edit(q, x) and (x.startswith(end) if half else x.endswith(end)) and one_edit(q[exact:] if half else q[:-exact], x[exact:] if half else x[:-exact])}
            found |= set(mine)
    assert found == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_counts_are_sums_over_both_searches():
    rng = random.Random(9)
    words = random_words(rng, "abc", 700, 5, 7)
    n = {w: rng.randint(3, 6) for w in words}
    total, best = Counter(), {}
    for half in (True, False):
        shard = Shard(half, [w.encode() for w in words], [n[w] for w in words])
        for some, n_near, _, who in shard.near([w.encode() for w in words]):
            for w, k, b in zip(some, n_near.tolist(), who.tolist(), strict=True):
                total[w.decode()] += k
                if b >= 0:
                    best.setdefault(w.decode(), []).append(words[b])
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        assert total[w] == len(near)
        assert min(best.get(w, []), key=lambda x: (-n[x], x), default=None) == min(near, key=lambda x: (-n[x], x), default=None)


def test_queries_with_letters_that_no_word_has():
    index = FmIndex([b"abcde", b"abxde"])
    for q, want in ((b"abqde", [0, 1]), (b"qbcde", [0]), (b"qqcde", []), (b"abcdq", [])):
        who, got = index.one_edit(index.code[np.frombuffer(q, np.uint8)].reshape(1, -1), 2)
        assert got.tolist() == want


def test_suffix_order():
    rng = random.Random(4)
    words = random_words(rng, "ab", 60, 1, 40)
    raw = np.array([ord(c) - 96 if c != "$" else 0 for c in "$".join(words) + "$"])
    text = "".join(chr(96 + c) if c else "$" for c in raw)
    want = sorted(range(len(text)), key=lambda i: (text[i : text.index("$", i)], i))
    assert suffix_order(raw, 3).tolist() == want


def test_dealing():
    groups = dealt([(True, "aa", 5), (True, "ab", 5), (True, "ac", 25), (True, "ad", 1), (False, "aa", 9), (False, "ab", 2)], 10)
    assert groups == [(False, "aa", 0, 1), (False, "ab", 1, 1), (True, "aa", 2, 1), (True, "ab", 2, 1), (True, "ac", 3, 3), (True, "ad", 6, 1)]


def corpus(rng, n_docs, vocabulary):
    return [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for k in range(n_docs)]


@pytest.mark.parametrize("limit", [None, 60])
def test_frame(spark, monkeypatch, limit):
    """limit: shards so small that groups are dealt into several."""
    if limit:
        monkeypatch.setattr(module, "dealt", lambda sizes, _: dealt(sizes, limit))
    rng = random.Random(2)
    words = random_words(rng, "abcé", 150, 4, 7) + ["Straße", "straße", "STRASSE", "naïve", "naive", "Été-là", "x" * 4000, "x" * 3999, "日本abcde", "ABCDE"]
    docs = [*corpus(rng, 120, words), (None, None), (None, "abcde abcde"), (7, ""), (8, "aaaaa " * 50), (8, "aaaaa " * 50), (9, "aaaab " * 20), (10, "aaabb " * 9 + "aabbb " * 4)]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, n int, word string")
    got = rows(spelling_groups(df))
    assert got == brute_force(docs)
    assert any(r[2] != r[1] and r[1] for r in got) and any(len(r[0]) > 3000 for r in got)
    assert rows(spelling_groups(df.limit(0))) == []


def test_query(spark):
    from stateroll.llm.queries import QUERIES
    from tests.llm import oracle

    want = brute_force(oracle.rows("SELECT doc_id, text FROM documents"))
    assert rows(QUERIES["op12_spelling"](spark, oracle.SF)) == want and len(want) > 20
