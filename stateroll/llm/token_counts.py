"""Token counts of whole texts by finite-state transducers that are compiled from a byte-level BPE vocabulary.

Two deterministic machines run one after the other:

- The splitter reads a text's characters as symbols (a letter, a number, white space that ends here, an apostrophe
  before a contraction, ...) and marks where words begin. It has eight states. All maps of states to states that any
  text can bring about form a small monoid; it is compiled with its table of products, so the state map of a chunk is
  one byte and two maps are composed by one look-up. Chunks of a text are mapped side by side, their maps are composed by
  a parallel prefix scan, and the scan gives each chunk's entry state.
- The word machine reads bytes from each word's begin. Its transitions are annotated with the change in the number of
  tokens that the bytes so far are encoded as, so a text's count is the sum of the annotations. A state holds, for
  each place from which a token may still go on, the place in the tree of tokens, the last token before it and that
  token's count: all that later bytes depend on. Transitions are compiled when a text first needs them, and kept in a
  table of bounded size. A word that is longer than a chunk is cut: the state maps of its chunks, over the entry states
  that can come about, are computed side by side and composed.

The encoding of bytes t[:k] is that of a shorter t[:j] and one token more, the one token t[j:k] that may follow the
last token of t[:j]; two tokens may be neighbours if the encoding of their bytes together is just the two.

The pass has no shuffle, and a task holds one Arrow batch and the machines.

Defined cases: null text is empty; empty texts have no tokens; texts of any length are read in pieces, with the machines'
states carried over; special tokens' strings in a text are one token each; repeated rows give equal rows; an empty
table gives none; only id and text are read, so no other column's name can clash.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stateroll.llm.bpe import LETTERS, NOT_YET, NUMBERS, ByteBpe
from stateroll.llm.common import map_texts, table

#: Bytes of a text that are read at a time; characters of a chunk of the splitter; bytes of a chunk of the word machine.
PIECE_BYTES, SPLIT_CHUNK, WORD_CHUNK = 1 << 20, 64, 256
#: Bytes before a cut within a word from which its first entry state is guessed.
WARM_UP = 48
#: States of the word machine that a worker keeps before it starts anew.
KEPT_STATES = 400_000
#: The count that a row is compared with.
LIMIT = 1024

# The splitter's symbols: what a character is and what follows it.
LETTER, NUMBER, OTHER, BLANK_BEFORE, SPACE_ON, SPACE_LAST, SHORT, LONG = range(8)
#: The symbol of a section's first character is raised by this: the splitter starts anew.
ANEW = 8
# Its states: between words, or within one of a kind. LEFT1 and LEFT2: so many letters of a contraction to come.
BETWEEN, LETTERS_RUN, NUMBERS_RUN, OTHERS_RUN, AFTER_BLANK, SPACES_RUN, LEFT1, LEFT2 = range(8)


def splitter_step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a word begins at this character."""
    if symbol >= ANEW:
        state, symbol = BETWEEN, symbol - ANEW
    run = {LETTER: LETTERS_RUN, NUMBER: NUMBERS_RUN, OTHER: OTHERS_RUN, SHORT: OTHERS_RUN, LONG: OTHERS_RUN}.get(symbol)
    if state == LEFT2:
        return LEFT1, False
    if state == LEFT1:
        return BETWEEN, False
    if run is not None and state in (run, AFTER_BLANK):
        return run, False
    if state == SPACES_RUN and symbol == SPACE_ON:
        return SPACES_RUN, False
    begun = {BLANK_BEFORE: AFTER_BLANK, SPACE_ON: SPACES_RUN, SPACE_LAST: BETWEEN, SHORT: LEFT1, LONG: LEFT2}
    return begun.get(symbol, run), True


@functools.cache
def splitter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Number of each symbol's map; product[f, symbol] (f, then the symbol); product[f, g]; the maps; the identity's number."""
    symbols = range(2 * ANEW)
    moves = [tuple(splitter_step(q, s)[0] for q in range(8)) for s in symbols]
    maps = [tuple(range(8))]
    number = {maps[0]: 0}
    for f in maps:  # grows while it is read: all products of symbols
        for g in moves:
            h = tuple(g[q] for q in f)
            if h not in number:
                number[h] = len(maps)
                maps.append(h)
    as_array = np.array(maps, np.uint8)
    product = np.array([[number[tuple(g[q] for q in f)] for g in maps] for f in maps], np.uint16)
    of_symbol = np.array([number[g] for g in moves], np.uint16)
    return of_symbol, product[:, of_symbol].copy(), product, as_array, 0


@functools.cache
def begins_table() -> np.ndarray:
    return np.array([[splitter_step(q, s)[1] for s in range(2 * ANEW)] for q in range(8)])


@functools.cache
def character_kinds() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE_ON (any white space) of each code point, as the vocabulary's library takes them."""
    import regex

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    places = np.array(points)
    kinds = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((LETTERS, LETTER), (NUMBERS, NUMBER), (r"\s", SPACE_ON)):
        for m in regex.finditer(f"{pattern}+", every):
            kinds[places[m.start() : m.end()]] = kind
    for a, b in NOT_YET:
        kinds[a : b + 1] = OTHER
    return kinds


def split(points: np.ndarray, section: np.ndarray, n: int, state: int) -> tuple[np.ndarray, int]:
    """Whether a word begins at each of the first n code points, and the state after them.

    section: whether a section (a text, or a part of one between special tokens) begins at each code point. points and
    section hold up to two more characters than n, which may decide about the last ones; what ends there ends its section.
    """
    if not n:
        return np.zeros(0, bool), state
    kind = character_kinds()[points]
    after = np.full(len(kind) + 2, 255, np.uint8)
    after[: len(kind)] = kind
    ends = np.r_[section, True, True]
    one = np.where(ends[1 : n + 1], 255, after[1 : n + 1])  # the next character's kind; 255 at a section's end
    symbol = kind[:n].copy()
    space = symbol == SPACE_ON
    last = space & (one != 255) & (one != SPACE_ON)  # white space before something else
    symbol[last] = np.where(points[:n][last] == ord(" "), BLANK_BEFORE, SPACE_LAST)
    quote = np.flatnonzero((points[:n] == ord("'")) & (one == LETTER))
    if len(quote):
        more = np.r_[points, 0, 0]
        x, y = more[quote + 1], np.where(ends[quote + 2], 0, more[quote + 2])
        symbol[quote[np.isin(x, [ord(c) for c in "stmd"])]] = SHORT
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        symbol[quote[np.logical_or.reduce([(x == a) & (y == b) for a, b in pairs])]] = LONG
    symbol[section[:n]] += ANEW
    of_symbol, then_symbol, product, maps, identity = splitter_tables()
    lanes = -(-n // SPLIT_CHUNK)
    padded = np.zeros(lanes * SPLIT_CHUNK, np.uint8)
    padded[:n] = symbol
    steps = np.ascontiguousarray(padded.reshape(lanes, SPLIT_CHUNK).T)
    within = np.empty((SPLIT_CHUNK, lanes), np.uint16)  # the map of a chunk's characters up to each of them
    within[0] = of_symbol[steps[0]]
    flat, width = then_symbol.ravel(), then_symbol.shape[1]
    for k in range(1, SPLIT_CHUNK):
        within[k] = flat[within[k - 1].astype(np.int64) * width + steps[k]]
    upto = within[-1].copy()  # prefix scan: the map of all chunks up to each of them
    gap = 1
    while gap < lanes:
        upto[gap:] = product[upto[:-gap], upto[gap:]]
        gap *= 2
    entry = maps[np.r_[np.uint16(identity), upto[:-1]], state]
    states = maps[within, entry[None, :]].T.ravel()[:n]
    return begins_table()[np.r_[np.uint8(state), states[:-1]], symbol], int(states[-1])


class WordMachine:
    """Bytes of a word to the change of its token count, compiled as texts need it."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe = bpe
        self.tree: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for n, text in enumerate(bpe.token_bytes):
            if not text or n in bpe.added.values():
                continue
            at = 0
            for b in text:
                if b not in self.tree[at]:
                    self.tree[at][b] = len(self.tree)
                    self.tree.append({})
                    self.token.append(-1)
                at = self.tree[at][b]
            self.token[at] = n
        self.ranks = {(int(k) // bpe.size, int(k) % bpe.size): (int(r), int(bpe.merged[r])) for k, r in zip(bpe.pair_keys, bpe.pair_rank, strict=True)}
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.resize(1 << 16)

    def resize(self, size: int) -> None:
        old = getattr(self, "keys", np.zeros(0, np.int64)) if len(self.states) > 1 else np.zeros(0, np.int64)
        held = np.flatnonzero(old >= 0)
        keys, values = old[held], self.values[held] if len(held) else ()
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys, self.values, self.size, self.held = np.full(size, -1, np.int64), np.zeros(size, np.int64), size, 0
        for k, v in zip(keys.tolist(), values.tolist() if len(held) else (), strict=True):
            self.put(k, v)

    def put(self, key: int, value: int) -> None:
        at = ((key * 0x9E3779B97F4A7C15) & (1 << 64) - 1) >> int(self.shift)
        while self.keys[at] >= 0:
            at = (at + 1) % self.size
        self.keys[at], self.values[at] = key, value
        self.held += 1

    def merged(self, text: bytes) -> list[int]:
        """The encoding of a few bytes by merging pairs, lowest rank first."""
        ids = [int(self.bpe.of_byte[b]) for b in text]
        while True:
            best = min(((self.ranks[p][0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.ranks), default=None)
            if best is None:
                return ids
            k = best[1]
            ids[k : k + 2] = [self.ranks[ids[k], ids[k + 1]][1]]

    def may_follow(self, a: int, b: int) -> bool:
        if a < 0:
            return self.merged(self.bpe.token_bytes[b]) == [b]
        if (a, b) not in self.neighbours:
            if len(self.neighbours) > KEPT_STATES:
                self.neighbours.clear()
            self.neighbours[a, b] = self.merged(self.bpe.token_bytes[a] + self.bpe.token_bytes[b]) == [a, b]
        return self.neighbours[a, b]

    def compile(self, key: int) -> int:
        """The transition of a state and a byte: the next state's number times 256, and the change of the count plus 128."""
        state, b = self.states[key >> 8], key & 255
        on, found = [], None
        for at, last, count in state:
            at = self.tree[at].get(b)
            if at is None:
                continue
            if self.token[at] >= 0 and found is None and self.may_follow(last, self.token[at]):
                found = self.token[at], count + 1
            if self.tree[at]:
                on.append((at, last, count))
        token, change = found
        to = (*((at, last, count - change) for at, last, count in on), (0, token, 0))
        if to not in self.number:
            self.number[to] = len(self.states)
            self.states.append(to)
        return self.number[to] << 8 | change + 128

    def step(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of the count, for a byte each."""
        keys = states << 8 | data
        while True:
            at = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
            got = self.keys[at]
            open_ = np.flatnonzero(got != keys)
            missing = []
            while len(open_):
                empty = got[open_] < 0
                missing.append(open_[empty])
                open_ = open_[~empty]
                at[open_] = (at[open_] + 1) % self.size
                got[open_] = self.keys[at[open_]]
                open_ = open_[got[open_] != keys[open_]]
            missing = np.concatenate(missing) if missing else ()
            if not len(missing):
                found = self.values[at]
                return found >> 8, (found & 255) - 128
            for key in np.unique(keys[missing]).tolist():
                self.put(key, self.compile(key))
                if self.held * 4 > self.size:
                    self.resize(self.size * 4)

    def run(self, data: np.ndarray, anew: np.ndarray, start: np.ndarray, end: np.ndarray, entry: np.ndarray, changes: np.ndarray | None = None) -> np.ndarray:
        """Exit states of the chunks data[start:end], side by side; a word begins where anew says so. Notes the changes of the count at each byte."""
        order = np.argsort(start - end, kind="stable")
        at, left, states = start[order], (end - start)[order], entry[order].copy()
        live = len(order)
        for k in range(int(left[0]) if live else 0):
            live = int(np.searchsorted(-left, -k, "left"))  # chunks of more than k bytes
            place = at[:live] + k
            states[:live], change = self.step(np.where(anew[place], 0, states[:live]), data[place])
            if changes is not None:
                changes[place] = change
        out = np.empty_like(states)
        out[order] = states
        return out

    def changes(self, data: np.ndarray, anew: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """The change of the count at each byte, and the state after the last; state: that before the first."""
        n = len(data)
        out = np.zeros(n, np.int16)
        if not n:
            return out, state
        begins = np.flatnonzero(anew)
        marks = begins[np.minimum(np.searchsorted(begins, np.arange(0, n, WORD_CHUNK)), len(begins) - 1)] if len(begins) else begins
        cuts = np.unique(np.r_[0, marks])
        size = np.diff(np.r_[cuts, n])
        # what is longer than two chunks is cut within its words too
        extra = [np.arange(a + WORD_CHUNK, a + s - WORD_CHUNK // 2, WORD_CHUNK) for a, s in zip(cuts[size > 2 * WORD_CHUNK].tolist(), size[size > 2 * WORD_CHUNK].tolist(), strict=True)]
        start = np.unique(np.concatenate([cuts, *extra]))
        end = np.r_[start[1:], n]
        entry = np.where(start == 0, state, 0)
        unknown = np.flatnonzero(~anew[start] & (start > 0))
        if len(unknown):
            self.enter(data, anew, start, end, entry, unknown)
        last = self.run(data, anew, start, end, entry, out)
        return out, int(last[-1])

    def enter(self, data: np.ndarray, anew: np.ndarray, start: np.ndarray, end: np.ndarray, entry: np.ndarray, unknown: np.ndarray) -> None:
        """Fill in the entry states of the chunks that begin within a word, from the state maps of those before them."""
        before = np.unique(unknown - 1)
        maps: dict[int, dict[int, int]] = {int(c): {} for c in before}
        guess = self.run(data, anew, np.maximum(start[unknown] - WARM_UP, 0), start[unknown], np.zeros(len(unknown), np.int64))
        ask = {(int(c), int(entry[c])) for c in before if c not in set(unknown.tolist())}
        ask |= {(int(c), int(g)) for c, g in zip(unknown, guess, strict=True) if int(c) in maps}
        inside = set(unknown.tolist())
        while ask:
            lanes, states = (np.array(x, np.int64) for x in zip(*sorted(ask), strict=True))
            exits = self.run(data, anew, start[lanes], end[lanes], states)
            new = set()
            for c, q, to in zip(lanes.tolist(), states.tolist(), exits.tolist(), strict=True):
                maps[c][q] = to
                if c + 1 in maps and c + 1 in inside:
                    new.add((c + 1, to))
            ask = {(c, q) for c, q in new if q not in maps[c]}
        for c in unknown.tolist():
            entry[c] = maps[c - 1][int(entry[c - 1])]


class Counter:
    """Token counts by both machines."""

    def __init__(self, vocabulary: dict) -> None:
        self.bpe = ByteBpe(vocabulary)
        self.words = WordMachine(self.bpe)
        self.special = [s.encode() for s in sorted(self.bpe.added, key=len, reverse=True) if s]

    def specials(self, data: bytes, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where special tokens lie in the texts: leftmost first, none over two texts."""
        out = []
        if not self.special or not any(s in data for s in self.special):
            return out
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            at = a
            while found := min(((k, -len(s)) for s in self.special if (k := data.find(s, at, b)) >= 0), default=None):
                at = found[0] - found[1]
                out.append((found[0], at))
        return out

    def counts(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text; flat: their UTF-8 bytes; offsets: where they begin, and the end of the last."""
        data = flat.tobytes()
        extra = np.zeros(len(offsets) - 1, np.int64)
        starts = offsets[:-1]
        if cut := self.specials(data, offsets):
            a, b = np.array(cut).T
            np.add.at(extra, np.searchsorted(offsets, a, "right") - 1, 1)
            inside = np.zeros(len(flat) + 1, np.int64)
            np.add.at(inside, a, 1)
            np.add.at(inside, b, -1)
            keep = np.cumsum(inside)[:-1] == 0
            moved = np.r_[0, np.cumsum(keep)]
            flat, starts, offsets = flat[keep], moved[np.r_[starts, b]], moved[offsets]
            data = flat.tobytes()
        n = len(flat)
        anew = np.zeros(n + 1, bool)
        anew[starts] = True
        total = np.zeros(n + 1, np.int64)
        at, split_state, word_state = 0, BETWEEN, 0
        while at < n:
            if len(self.words.states) > KEPT_STATES:
                kept = self.words.states[word_state]
                self.words.forget()
                if kept != self.words.states[0]:
                    word_state = 1
                    self.words.states.append(kept)
                    self.words.number[kept] = 1
            end = at + PIECE_BYTES
            while end < n and flat[end] & 0xC0 == 0x80:
                end -= 1
            end = min(end, n)
            more = end
            for _ in range(2):  # two characters more, which may decide about the last ones
                more += 1
                while more < n and flat[more] & 0xC0 == 0x80:
                    more += 1
            more = min(more, n)
            places = np.flatnonzero(flat[at:more] & 0xC0 != 0x80)
            points = np.frombuffer(data[at:more].decode().encode("utf-32-le"), np.uint32)
            within = int(np.searchsorted(places, end - at))
            begins, split_state = split(points, anew[at:more][places], within, split_state)
            marks = np.zeros(end - at, bool)
            marks[places[:within][begins]] = True
            total[at + 1 : end + 1], word_state = self.words.changes(flat[at:end].astype(np.int64), marks, word_state)
            at = end
        total = np.cumsum(total)
        return extra + total[offsets[1:]] - total[offsets[:-1]]


#: One counter a worker, of the vocabulary it used last: its machines serve the tasks that follow.
_LOADED: dict[str, Counter] = {}


def loaded(vocabulary: str) -> Counter:
    """The counter of a vocabulary file's content."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Counter(json.loads(vocabulary))
    return _LOADED[key]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: its id, n_bytes, n_tokens, and whether these are more than limit.

    vocabulary: path of a byte-level BPE vocabulary file on the driver; its content, some megabytes whatever the corpus,
    is broadcast.
    """
    from stateroll.llm.common import text_buffers

    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        counter = loaded(shared.value)

        def run(_, texts: pa.Array) -> dict:
            flat, offsets = text_buffers(texts)
            return {"n_bytes": pa.array(np.diff(offsets)), "n_tokens": pa.array(counter.counts(flat, offsets))}

        return run

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    counted = map_texts(docs, id_col, text_col, fields, make, keep="id").withColumnRenamed("id", id_col)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
