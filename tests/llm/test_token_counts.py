import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import stateroll.llm.token_counts as module  # noqa: E402
from stateroll.llm.common import text_buffers  # noqa: E402
from tests.llm.test_bpe import CONTENT, PATH, odd_texts  # noqa: E402


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(PATH)


def counted(texts):
    flat, offsets = text_buffers(pa.array(texts, pa.string()))
    return module.loaded(CONTENT).counts(flat, offsets).tolist()


def wanted(library, texts):
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_equals_library(library):
    texts = odd_texts()
    assert counted(texts) == wanted(library, texts)


def test_long_words(library):
    texts = ["a" * 5000, "xyz" * 3000, "abcdefg" * 1000 + " " + "é" * 3000, "\n" * 3000 + " x", "=" * 4000, "漢字" * 2000, " 12" * 900, "-=" * 800 + "'ll"]
    assert counted(texts) == wanted(library, texts)
    rng = random.Random(3)
    texts = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(500, 3000))) for _ in range(20)]
    assert counted(texts) == wanted(library, texts)


@pytest.mark.parametrize("piece", [1, 7, 64, 300])
def test_pieces(library, monkeypatch, piece):
    monkeypatch.setattr(module, "PIECE_BYTES", max(piece, 4))
    texts = [*odd_texts()[:120], "a" * 700 + " b'll", "<|endoftext|>" * 3 + " x" * 40]
    assert counted(texts) == wanted(library, texts)


def test_machine_starts_anew(library, monkeypatch):
    monkeypatch.setattr(module, "KEPT_STATES", 50)
    monkeypatch.setattr(module, "PIECE_BYTES", 100)
    texts = odd_texts()[:150]
    assert counted(texts) == wanted(library, texts)
    assert len(module.loaded(CONTENT).words.states) < 1000


def test_state_maps_compose():
    of_symbol, then_symbol, product, maps, identity = module.splitter_tables()
    rng = np.random.default_rng(1)
    for f, g in rng.integers(0, len(maps), (200, 2)):
        assert (maps[product[f, g]] == maps[g][maps[f]]).all()
    assert (maps[identity] == np.arange(8)).all()
    for s in range(2 * module.ANEW):
        assert [module.splitter_step(q, s)[0] for q in range(8)] == maps[of_symbol[s]].tolist()
        assert (then_symbol[:, s] == product[:, of_symbol[s]]).all()


def test_frame(spark, library):
    rows = [(1, "Hello  world", 5), (None, None, 1), (3, "", None), (3, "", None), (4, "<|endoftext|> ok", 9), (5, "x y " * 900, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(module.token_counts(df, PATH).collect(), key=lambda r: str(r.doc_id))
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)
    assert len(got) == 6
    assert module.token_counts(df.limit(0), PATH).count() == 0


def test_query(spark, library):
    from stateroll.llm.queries import QUERIES
    from tests.llm import oracle

    want = []
    for doc, text in oracle.rows("SELECT doc_id, text FROM documents"):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc, len((text or "").encode()), n, n > 1024))
    assert oracle.frame(QUERIES["op13_token_counts"](spark, oracle.SF)) == sorted(want, key=str)
