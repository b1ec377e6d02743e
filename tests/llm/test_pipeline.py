import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
from stateroll.llm import simhash, toxicity
from tests.llm import oracle, test_decontaminate, test_simhash, test_suffix_dedup


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, oracle.SF)
        if name != "bpe":
            assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = ([tuple(r) for r in before.select("doc_id", "text").collect()], docs.collect())
    labels = spark.read.parquet(f"{oracle.SF}/labels.parquet")
    rows, kept = seen["toxicity"]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    import pyarrow as pa

    scores = model.score(pa.array([t for _, t in rows]))
    assert sorted(r.doc_id for r in kept) == sorted(i for (i, _), s in zip(rows, scores, strict=True) if s < 0.7)

    rows, kept = seen["simhash_near_dedup"]
    want = {c for *_, c in test_simhash.groups([(i, simhash.fingerprint(t)) for i, t in rows])}
    assert {r.doc_id for r in kept} == want and len(kept) == len(want)

    rows, kept = seen["suffix_array_dedup"]
    counts = Counter(raw[i : i + 200] for _, t in rows for raw in [t.encode()] for i in range(len(raw) - 199))
    left = {r.doc_id: r for r in kept}
    assert len(kept) == len(rows)
    for doc, text in rows:
        raw, gone = text.encode(), np.zeros(len(text.encode()), bool)
        for i in range(len(raw) - 199):
            if counts[raw[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0])).reshape(-1, 2).tolist()
        out, at = b"", 0
        for b, e in test_suffix_dedup.op.whole_characters(raw, [tuple(s) for s in spans]):
            out, at = out + raw[at:b], e
        assert left[doc].text == (out + raw[at:]).decode()
        assert left[doc].n_chars == len(left[doc].text)

    rows, kept = seen["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{oracle.SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, n, hit, _ in test_decontaminate.brute(rows, items) if hit and 20 * hit >= n}
    assert sorted(r.doc_id for r in kept) == sorted(i for i, _ in rows if i not in bad)

    rows, got = seen["bpe"]
    import public_tokenizers
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_nulls_repeats_long_texts_and_other_columns(spark, tmp_path):
    import shutil

    for name in ("labels", "benchmark"):
        shutil.copy(f"{oracle.SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    rng = np.random.default_rng(3)
    long = " ".join(f"w{k}" for k in rng.integers(0, 1 << 40, 150_000))
    texts = [(1, "a first text of some words"), (None, "a second text, of no id"), (3, None), (4, ""), (5, long), (6, long + " more"), (7, "a third one"), (7, "a third one"), (None, "a second text, of no id")]
    rows = [(i, t, "en", "s", len(t or ""), k, "x") for k, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, fp string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "fp"], name
    got = sorted(((r.doc_id, r.text, r.row in (1, 8)) for r in docs.collect()), key=str)
    assert got == sorted([(1, texts[0][1], False), (None, texts[1][1], True), (3, "", False), (5, long, False), (7, "a third one", False)], key=str)
    ids = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in ids) == ["1", "3", "5", "7", "None"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, oracle.SF)
    assert docs.count() == 0
