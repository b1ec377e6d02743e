import hashlib
import random
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("tiktoken")
import stateroll.llm.alignment as module  # noqa: E402
from tests.llm.test_bpe import PATH, odd_texts  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    import tokenizers

    first = tokenizers.Tokenizer.from_file(PATH)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute_force(libraries, docs):
    """By the definition: sets of ends, links one by one, counts in a dictionary."""
    from stateroll.llm.bpe import byte_letters

    first, second = libraries
    back = {c: b for b, c in byte_letters().items()}
    held = []
    for doc, text in docs:
        groups, links, n_a, n_b = [], [], 0, 0
        if text:
            want = b" " + text.encode()
            a = [(k, bytes(back[c] for c in first.id_to_token(k))) for k in first.encode(" " + text, add_special_tokens=False).ids]
            b = [(k, bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode()) for k in second.encode(text)]
            if b"".join(t for _, t in a) == b"".join(t for _, t in b) == want:
                n_a, n_b = len(a), len(b)
                ends_a, ends_b = np.cumsum([len(t) for _, t in a]).tolist(), np.cumsum([len(t) for _, t in b]).tolist()
                begin = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    mine_a = [k for (k, _), e in zip(a, ends_a, strict=True) if begin < e <= end]
                    mine_b = [k for (k, _), e in zip(b, ends_b, strict=True) if begin < e <= end]
                    groups.append(",".join(map(str, mine_a)) + "|" + ",".join(map(str, mine_b)))
                    links.append((mine_a[-1], mine_b[-1]))
                    begin = end
        held.append((doc, n_a, n_b, groups, links))
    counts = Counter(x for *_, links in held for x in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        ((doc, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc, n_a, n_b, groups, links in held),
        key=str,
    )


def rows(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 31, n))
        h = module.PerfectHash(keys)
        assert sorted(h(keys).tolist()) == list(range(len(keys)))
        part = module.Part(keys, None)
        part.counts = part.keys * 3
        other = np.setdiff1d(rng.integers(0, 1 << 31, 1000), keys)
        assert (part.found(keys) == keys * 3).all() and (part.found(other) == 0).all()


def test_parts_agree_with_spark(spark):
    pairs = np.array([0, 1, 31999, 50256 * 32000 + 31999, 123456789], np.int64)
    df = spark.createDataFrame([(int(p),) for p in pairs], "pair long")
    for parts in (1, 7, 1000):
        assert [r.part for r in df.select(module.part_column(parts)).collect()] == module.part_of(pairs, parts).tolist()


@pytest.mark.parametrize("small", [False, True])
def test_frame(spark, monkeypatch, libraries, small):
    """small: many parts, kept one at a time, and pairs sent on in many pieces."""
    if small:
        for name, value in (("PART_PAIRS", 100), ("HELD_PAIRS", 50), ("KEPT_BYTES", 1), ("FAN", 2), ("REMEMBERED_UNITS", 20), ("TOGETHER_UNITS", 9), ("PIECE_CHARS", 30)):
            monkeypatch.setattr(module, name, value)
    rng = random.Random(1)
    texts = [*odd_texts()[:150], "the cat sat on the mat", "the cat sat", "ａ①fi", "a▁b", "<s> <|endoftext|> <unk>", "  two  spaces ", " ", "   ", "a ", "a\n b\n  c \t d\u3000 e\x1c f ", "it 's a's 're", "long ok text " * 9 + "a▁b " + "more text " * 9, "x" * 3000, "été " * 500]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, None), (None, "the cat"), (3, ""), (7, "the dog"), (7, "the dog")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, n_a int, pair string").repartition(5)
    assert rows(module.alignment(df, PATH, PIECES)) == brute_force(libraries, docs)
    assert rows(module.alignment(df.limit(0), PATH, PIECES)) == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows(module.alignment(nothing, PATH, PIECES)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_units_add_up_to_the_whole(libraries):
    """Cut where a blank follows what is no white space, both tokenizers give the ids of the whole text."""
    first, second = libraries
    by = module.Aligner(open(PATH, encoding="utf-8").read(), open(PIECES, "rb").read())
    assert by.apart
    for text in odd_texts():
        units = by.split(" " + text) if text else []
        a = [k for u in units for k in first.encode(u, add_special_tokens=False).ids]
        b = [k for u in units for k in second.encode(u[1:]) or [by.blank]]
        assert a == (first.encode(" " + text, add_special_tokens=False).ids if text else []) and b == second.encode(text)


def test_query(spark, libraries):
    from stateroll.llm.queries import QUERIES
    from tests.llm import oracle

    want = brute_force(libraries, oracle.rows("SELECT doc_id, text FROM documents"))
    assert rows(QUERIES["op11_alignment"](spark, oracle.SF)) == want
