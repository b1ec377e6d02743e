"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The words of a batch that a worker hasn't met are encoded together: the symbols of all of them lie in one flat
array, and each round finds every word's lowest-rank adjacent pair by a binary search over the sorted pair keys and
merges all its occurrences, left to right, in all words at once. Words are remembered in a table of bounded size.
The pass has no shuffle; a task holds one Arrow batch.

Defined cases: null text is empty; empty texts have no ids; a text of any length is read in pieces of words, and the
table of words stays bounded within it; of equal ranks the leftmost pair is merged first; repeated rows give equal
rows; an empty table gives none; only id and text are read, so no other column's name can clash.
"""

from __future__ import annotations

import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stateroll.llm.common import map_texts, steps, table

#: Words that a worker remembers before it starts anew; words longer than this many characters aren't remembered.
REMEMBERED_WORDS, REMEMBERED_CHARS = 200_000, 40
#: Words of one text that are looked up at a time.
PIECE_WORDS = 200_000

# How the byte-level vocabulary splits texts into words.
LETTERS, NUMBERS = r"\p{L}", r"\p{N}"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s\p{L}\p{N}{X}]+|\s+(?!\S)|\s+"
# Code points that newer Unicode tables call letters or numbers, and the vocabulary's library doesn't.
NOT_YET = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary file: itself if it prints in Latin-1, else the next letter from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class Words(dict):
    """Words to their number in the table; a word not met yet gets the next number."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class ByteBpe:
    def __init__(self, vocabulary: dict) -> None:
        import regex

        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        ids = dict(vocabulary["model"]["vocab"])
        self.added = {a["content"]: a["id"] for a in vocabulary["added_tokens"]}
        self.size = max([*ids.values(), *self.added.values()]) + 1
        text = [b""] * self.size
        for token, n in ids.items():
            text[n] = bytes(byte_of[c] for c in token)
        for token, n in self.added.items():
            text[n] = token.encode()
        self.token_bytes = text
        self.of_byte = np.array([ids[letters[b]] for b in range(256)], np.int64)
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in vocabulary["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], order
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        newer = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NOT_YET)
        usual = PATTERN.replace("{L}", LETTERS).replace("{N}", NUMBERS).replace("{X}", "")
        other = r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}--[{X}]]+| ?[\p{N}--[{X}]]+| ?(?:[^\s\p{L}\p{N}]|[{X}])+|\s+(?!\S)|\s+".replace("{X}", newer)
        self.split, self.split_newer = regex.compile(usual), regex.compile(other, flags=regex.V1)
        self.newer = regex.compile(f"[{newer}]")
        self.specials = regex.compile("|".join(sorted(map(regex.escape, self.added), key=len, reverse=True))) if self.added else None
        self.forget()

    def forget(self) -> None:
        self.words, self.flat, self.start, self.length = Words(), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known = 0

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each has (0 for an empty one)."""
        size = np.array([len(w) for w in words], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.merged)
        while len(symbols):
            # the rank of the pair that begins at each symbol; none for the last of a word
            left = np.flatnonzero(word[:-1] == word[1:])
            keys = symbols[left] * self.size + symbols[left + 1]
            at = np.minimum(np.searchsorted(self.pair_keys, keys), none - 1)
            rank = np.full(len(symbols), none, np.int64)
            rank[left] = np.where(self.pair_keys[at] == keys, self.pair_rank[at], none)
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.r_[begins, len(symbols)]))
            live = least < none
            done.append((word[~live], symbols[~live]))
            symbols, word, rank, least = symbols[live], word[live], rank[live], least[live]
            if not len(symbols):
                break
            hit = np.flatnonzero(rank == least)
            # of pairs that overlap (a run of one symbol), the first, third and so on
            first = np.r_[True, np.diff(hit) != 1]
            since = np.arange(len(hit)) - np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            hit = hit[since % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            symbols, word = symbols[stay], word[stay]
        if not done:
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def learn(self) -> None:
        """Encode the words that have a number and no ids yet."""
        new = [w.encode() for w in itertools.islice(self.words, self.known, None)]
        if not new:
            return
        ids, n = self.merge_rounds(new)
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(n) - n]
        self.length, self.flat, self.known = np.r_[self.length, n], np.r_[self.flat, ids], len(self.words)

    def pieces(self, text: str):
        """Lists of words, with the numbers of special tokens between them."""
        pattern = self.split_newer if self.newer.search(text) else self.split
        at = 0
        for m in [*(self.specials.finditer(text) if self.specials else ()), None]:
            part = text[at : m.start() if m else len(text)]
            if len(part) <= 4 * PIECE_WORDS:
                yield pattern.findall(part)
            else:
                found = pattern.finditer(part)
                while piece := [x.group() for x in itertools.islice(found, PIECE_WORDS)]:
                    yield piece
            if m:
                yield self.added[m.group()]
                at = m.end()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.words) > REMEMBERED_WORDS:
            self.forget()
        parts: list[list] = []
        for text in texts:
            own = []
            for piece in self.pieces(text) if text else ():
                if isinstance(piece, int):
                    own.append(np.array([piece], np.uint32))
                elif piece:
                    if max(map(len, piece)) > REMEMBERED_CHARS:  # words of any length are encoded, and not kept
                        for long, run in itertools.groupby(piece, lambda w: len(w) > REMEMBERED_CHARS):
                            own.append(self.merge_rounds([w.encode() for w in run])[0] if long else np.fromiter(map(self.words.__getitem__, run), np.int64))
                    else:
                        own.append(np.fromiter(map(self.words.__getitem__, piece), np.int64, len(piece)))
                if len(self.words) > 2 * REMEMBERED_WORDS:
                    self.settle([*parts, own])
                    self.forget()
            parts.append(own)
        self.settle(parts)
        return [np.concatenate(own) if own else np.zeros(0, np.uint32) for own in parts]

    def settle(self, parts: list[list[np.ndarray]]) -> None:
        """Ids in place of the words' numbers."""
        self.learn()
        for own in parts:
            own[:] = [x if x.dtype == np.uint32 else self.gather(x) for x in own]

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        n = self.length[numbers]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[numbers] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, as UTF-8: what isn't UTF-8 becomes U+FFFD."""
        out = b"".join(map(self.token_bytes.__getitem__, ids.tolist()))
        return out if _is_utf8(out) else out.decode("utf-8", "replace").encode()


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


#: One encoder a worker, of the vocabulary it used last: its words serve the tasks that follow.
_LOADED: dict[str, ByteBpe] = {}


def loaded(vocabulary: str) -> ByteBpe:
    """The encoder of a vocabulary file's content."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(json.loads(vocabulary))
    return _LOADED[key]


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, text: bool = False) -> DataFrame:
    """A row a document: its id, n_tokens, `ids` if asked for, `decoded` text if asked for, and SHA-256 of both.

    vocabulary: path of a byte-level BPE vocabulary file on the driver; its content, some megabytes whatever the corpus,
    is broadcast. Special tokens' strings in a text become their ids, and their text again.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    if text:
        fields.append(T.StructField("decoded", T.StringType()))

    def make():
        bpe = loaded(shared.value)

        def run(_, texts: pa.Array) -> dict:
            out = {f.name: [] for f in fields}
            for a, b in steps(np.array(pc.fill_null(pc.binary_length(texts), 0), np.int64)):
                for got in bpe.encode([x or "" for x in texts.slice(a, b - a).to_pylist()]):
                    back = bpe.decode(got)
                    out["n_tokens"].append(len(got))
                    out["ids_sha256"].append(hashlib.sha256(got.astype("<u4").tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                    if ids:
                        out["ids"].append(got.astype(np.int32))
                    if text:
                        out["decoded"].append(back.decode())
            return out

        return run

    return map_texts(docs, id_col, text_col, fields, make, keep="id").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)
