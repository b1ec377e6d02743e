import random
import re

import pytest

from stateroll.llm import decontaminate as op
from stateroll.llm.queries import QUERIES, SQL
from tests.llm import oracle

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))


def brute(docs, items, n=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + min(n, len(w))]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[key]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def got(spark, docs, items):
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, item_id string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = op.contamination(d, b).select("row.doc_id", "found.n_words", "found.n_hit", "found.items").collect()
    kept = op.decontaminate(d, b)
    assert kept.columns == d.columns
    assert kept.count() == sum(not (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in found)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found), key=str)


def fixture(seed):
    rng = random.Random(seed)
    few = [rng.choice(["the", "of", "é", "Ab", "x1", "ab", "q"]) for _ in range(7)]
    text = lambda n: "".join(rng.choice(few) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 12, 13, 14, 30]))) for k in range(2, 14)] + [(2, "zebra " * 20), (None, text(15)), (40, None), (41, ""), (42, "..."), (7, text(16))]
    docs = [(k, text(rng.choice([0, 5, 40, 200])) + (items[k % 12][1] or "") * rng.choice([0, 1, 2]) + text(3)) for k in range(40)]
    return docs + [(50, None), (51, ""), (None, items[3][1]), (52, "zebra " * 13), (52, "zebra " * 13), (53, "zebra " * 12)], items


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    docs, items = fixture(seed)
    assert got(spark, docs, items) == brute(docs, items)


def test_only_long_items_blocks_and_shards(spark, monkeypatch):
    docs, items = fixture(3)
    items = [(i, t) for i, t in items if len(words(t)) > 11]
    want = brute(docs, items)
    assert got(spark, docs, items) == want
    monkeypatch.setattr(op, "BLOCK_BYTES", 100)
    assert len(op.blocks(spark.createDataFrame(items, "item_id long, text string"), op.shared_dir(spark), "item_id", "text", 13)) > 5
    assert got(spark, docs, items) == want
    monkeypatch.setattr(op, "SHARD_BYTES", 500)
    monkeypatch.setattr(op, "SHARD_WORDS", 50)
    assert got(spark, docs, items) == want


def test_parts_of_a_long_item(monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BYTES", 60)
    text = " ".join(f"w{k}" for k in range(100))
    parts = [p.split() for p in op.pieces(text, 13)]
    assert len(parts) > 4
    assert {tuple(p[i : i + 13]) for p in parts for i in range(len(p) - 12)} == {tuple(text.split()[i : i + 13]) for i in range(88)}
    assert min(map(len, parts)) >= 13


def test_very_long_texts(spark):
    rng = random.Random(5)
    some = lambda n: " ".join(f"v{rng.randint(0, 30000)}" for _ in range(n))
    items = [(k, some(20)) for k in range(50)]
    docs = [(k, f"{some(300_000)} {items[k][1]} {some(100_000)}") for k in range(4)] + [(9, " ".join(t for _, t in items) * 40)]
    assert got(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b")]) == []
    assert got(spark, [(1, "a b")], []) == [(1, 2, 0, [])]


def test_longest_match(spark):
    item = " ".join(f"w{k}" for k in range(30))
    doc = "x y " + " ".join(f"w{k}" for k in range(5, 28)) + " z"
    d = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    b = spark.createDataFrame([(9, item)], "item_id long, text string")
    r = op.contamination(d, b).select("found.*").first()
    assert (r.longest, r.longest_at, r.longest_item, r.hits) == (23, 2, "9", [2, 25])


def test_longest_match_below_a_window(spark):
    words = [f"w{k}" for k in range(30)]
    d = spark.createDataFrame([(1, " ".join(words[:8] + words[8:10] + words[3:12])), (2, "w1 w2 w3")], "doc_id long, text string")
    b = spark.createDataFrame([(9, " ".join(words[:10] + ["q"] + words[2:30])), (8, "w9 w3")], "item_id long, text string")
    r = {x.row.doc_id: x.found for x in op.contamination(d, b, window=15).collect()}
    assert (r[1].longest, r[1].longest_at, r[1].longest_item, r[1].n_hit) == (10, 0, "9", 2)
    assert r[2].longest == 3


def test_dotted_and_clashing_names(spark):
    d = spark.createDataFrame([("a b", 1, "x", 2)], "`my.text` string, found int, row string, `my.id` int")
    b = spark.createDataFrame([(1, "a b")], "`item.id` int, `item.text` string")
    got = op.contamination(d, b, "my.text", "item.id", "item.text")
    assert got.select("found.n_hit").first()[0] == 2
    assert op.decontaminate(d, b, "my.text", item_col="item.id", item_text_col="item.text").columns == d.columns


def test_query_against_sql(spark):
    assert oracle.frame(QUERIES["op1_decontaminate"](spark, oracle.SF)) == oracle.rows(SQL["op1_decontaminate"])
