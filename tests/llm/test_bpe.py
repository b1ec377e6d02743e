import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from stateroll.llm.bpe import NOT_YET, ByteBpe, bpe_round_trip, loaded  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
with open(PATH, encoding="utf-8") as f:
    CONTENT = f.read()


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(7)
    letters = list("aaabc eEtT'sdmrl\n\t 019é한中́\x85\xa0\x1c\x00🙂ÅßſK<|>") + [chr(a) for a, _ in NOT_YET] + ["<|endoftext|>", "  ", "\r\n", "'ll", "the", " in"]
    out = ["", " ", "aaaaaaa", "a" * 300, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "don't we'll", " " * 50 + "x", "\n\n\n a", "é" * 90]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(600)]


def test_equals_library(library):
    bpe = loaded(CONTENT)
    texts = odd_texts()
    for text, got in zip(texts, bpe.encode(texts), strict=True):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert bpe.decode(got).decode() == library.decode(got.tolist(), skip_special_tokens=False)
    bpe.forget()
    assert [x.tolist() for x in bpe.encode(texts[:50])] == [library.encode(t, add_special_tokens=False).ids for t in texts[:50]]


def test_decodes_ids_that_are_not_utf8(library):
    bpe = loaded(CONTENT)
    for ids in ([1, 2, 3], [160, 161], [50256, 222, 5], []):
        assert bpe.decode(np.array(ids, np.uint32)).decode() == library.decode(ids, skip_special_tokens=False)


def test_long_text_in_pieces(library, monkeypatch):
    import stateroll.llm.bpe as module

    monkeypatch.setattr(module, "PIECE_WORDS", 7)
    text = "It's   a  long\n\n text, 123 words   \n" * 40
    assert loaded(CONTENT).encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_of_one_text_are_forgotten(library, monkeypatch):
    import stateroll.llm.bpe as module

    monkeypatch.setattr(module, "PIECE_WORDS", 50)
    monkeypatch.setattr(module, "REMEMBERED_WORDS", 100)
    text = " ".join(f"w{k}x{k * k}" for k in range(4000))
    bpe = module.ByteBpe(module.json.loads(CONTENT))
    got = bpe.encode(["a b", text, "b c"])
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in ("a b", text, "b c")]
    assert len(bpe.words) < 1000


def test_query(spark, library):
    from stateroll.llm.queries import QUERIES
    from tests.llm import oracle

    want = []
    for doc, text in oracle.rows("SELECT doc_id, text FROM documents"):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((hashlib.sha256(back.encode()).hexdigest(), doc, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), len(ids)))
    assert oracle.frame(QUERIES["op4_bpe"](spark, oracle.SF)) == sorted(want, key=str)


def test_frame(spark, library):
    rows = [(1, "Hello  world", 5), (None, None, 1), (3, "", None), (3, "", None), (4, "<|endoftext|> ok", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(bpe_round_trip(df, PATH, text=True).collect(), key=lambda r: str(r.doc_id))
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, text)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert len(got) == 5
    assert bpe_round_trip(df.limit(0), PATH).count() == 0


def test_merges_shared_words_once():
    assert isinstance(loaded(CONTENT), ByteBpe)
    assert loaded(CONTENT) is loaded(CONTENT)
