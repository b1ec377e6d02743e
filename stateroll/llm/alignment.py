"""Alignment of two tokenizers over a corpus: links between their tokens, counted over a minimal perfect hash of the pairs.

Two passes read the texts; neither shuffles them. A text is aligned unit by unit: where a blank follows what is no white
space, both tokenizers begin a new token whatever stands around (the second, if none of its pieces goes on over a
blank; else a text is one unit). A worker keeps the alignments of units in a table of bounded size, so that each
different one is tokenised once, and works with their numbers.

1. Each task aligns its texts and writes its different pairs of linked ids, with their counts. The distinct pairs of all
   tasks are dealt into parts of some PART_PAIRS by a hash, and a task builds each part's minimal perfect hash: levels
   of bits, where a key takes the bit that no other key of its level fell on and else goes to the next level; a key's
   index is the rank of its bit. The counts are then vectors, dense by that index: each counting task, of as many rows
   as there are pairs at least, sums a vector a part, and vectors are added up a tree, FAN to one at a time.
   A part's keys, counts and hash are a file in the shared folder.
2. Each task aligns its texts again and looks up the counts of a batch's different pairs, part after part; the key at an
   index is compared with the pair, so that no other key's count is taken. Files stay in memory up to KEPT_BYTES.

What is sent to all tasks is bounded by the vocabularies: a best count for each id of the second, and the files' names
(one for PART_PAIRS of at most all pairs of ids).

Defined cases: null and empty texts have no tokens, and neither have texts that a tokenizer doesn't give back byte by byte
(a normalised character, say); strings of special tokens are plain text; very long texts are read in pieces of whole
units; of counts that tie for an id's highest, each is the best; repeated rows count again; an empty table gives none;
only id and text are read, so no other column's name can clash.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import json
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stateroll.llm.bpe import ByteBpe, Words
from stateroll.llm.common import column, file_system, shared_dir, small_batches, table, written
from stateroll.llm.textarrays import expand, mix

#: Pairs of one part; pairs that a task holds before it sends them on; bytes of parts that a worker keeps; vectors added to one at a time.
PART_PAIRS, HELD_PAIRS, KEPT_BYTES, FAN = 1 << 18, 1 << 20, 256 << 20, 8
# How the byte-level vocabulary splits texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units that a worker remembers before it starts anew; units, and characters of one text, that are handled together.
REMEMBERED_UNITS, TOGETHER_UNITS, PIECE_CHARS = 400_000, 500_000, 1 << 20
#: New units that are tokenised together.
BLOCK_UNITS = 2_000
#: Where a text may be cut.
CUT = re.compile(r"(?<=\S)(?= )")
#: Bits for each key of a level of the hash.
SPARSE = 1.5
#: How a pair's part is drawn from it: a product below 2**63, whose middle bits are taken.
SPREAD, DROPPED = 1779033703, 20


class Aligner:
    """Both tokenizers. vocabulary: content of the byte-level BPE file; pieces: content of the model of pieces."""

    def __init__(self, vocabulary: str, pieces: bytes) -> None:
        import sentencepiece
        import tiktoken

        first = ByteBpe(json.loads(vocabulary))
        ranks = {t: n for n, t in enumerate(first.token_bytes) if t and n not in first.added.values()}
        self.first = tiktoken.Encoding("first", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        n = self.second.get_piece_size()
        self.bytes_a = first.token_bytes
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(map(self.second.id_to_piece, range(n)))]
        self.size_a, self.size_b = len(self.bytes_a), n
        self.length_a, self.length_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        #: An id's decimal form before each of the marks that may follow it.
        self.text = [f"{k}{mark}" for size, marks in ((self.size_a, ",|"), (self.size_b, ",;")) for mark in marks for k in range(size)]

        self.blank = self.second.piece_to_id("▁")
        self.apart = not any(re.search("[^▁]▁", self.second.id_to_piece(k)) for k in range(n))
        self.texts = False
        self.forget()

    def with_texts(self, texts: bool) -> "Aligner":
        """Whether the groups of units are kept as texts."""
        if texts and not self.texts:
            self.forget()
        self.texts = texts or self.texts
        return self

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.units, self.known, self.groups = Words(), 0, []
        self.n_a, self.n_b, self.n_links, self.start, self.pairs, self.fit = none, none, none, none, none, np.zeros(0, bool)

    def numbers(self, units: Iterator[str], n: int) -> np.ndarray:
        """Each unit's number in the table; new ones are aligned."""
        out = np.fromiter(map(self.units.__getitem__, units), np.int64, n)
        new = list(itertools.islice(self.units, self.known, None))
        if new:
            got = self.aligned(new)
            self.n_a, self.n_b, self.fit = np.r_[self.n_a, got.n_a], np.r_[self.n_b, got.n_b], np.r_[self.fit, got.n_a > 0]
            self.start = np.r_[self.start, len(self.pairs) + np.cumsum(got.n_links) - got.n_links]
            self.n_links, self.pairs = np.r_[self.n_links, got.n_links], np.r_[self.pairs, got.pairs]
            if self.texts:
                self.groups += got.groups()
            self.known = len(self.units)
        return out

    def aligned(self, units: list[str]) -> "Aligned":
        """units: each begins with a blank. One that a tokenizer doesn't give back has no tokens.

        Units of a block are given to the first tokenizer as one text, and what both give back is compared at once; only where that
        isn't the block, each unit is looked at.
        """
        parts = []
        for at in range(0, len(units), BLOCK_UNITS):
            block = units[at : at + BLOCK_UNITS]
            lists = [b or [self.blank] for b in self.second.encode([u[1:] for u in block], num_threads=1)]
            parts.append(self._whole(block, lists) or self._each(block, lists))
        return Aligned(self, *(np.concatenate(x) for x in zip(*parts, strict=True)))

    def _whole(self, units: list[str], lists: list[list[int]]) -> tuple[np.ndarray, ...] | None:
        text = "".join(units)
        data = text.encode()
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        if len(data) > len(text):
            sizes = np.fromiter((len(u.encode()) for u in units), np.int64, len(units))
        a = self.first.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(n_b.sum()))
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != data or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != data:
            return None
        ends, end_a, end_b = np.cumsum(sizes), np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        upto = np.searchsorted(end_a, ends)
        if (end_a[np.minimum(upto, len(end_a) - 1)] != ends).any() or (end_b[np.cumsum(n_b) - 1] != ends).any():
            return None
        return a, b, np.diff(np.r_[0, upto + 1]), n_b, sizes

    def _each(self, units: list[str], lists: list[list[int]]) -> tuple[np.ndarray, ...]:
        a_parts, b_parts, sizes = [], [], []
        for unit, b in zip(units, lists, strict=True):
            data = unit.encode()
            a = self.first.encode_to_numpy(unit, disallowed_special=()).astype(np.int64)
            if b"".join(map(self.bytes_b.__getitem__, b)) != data or b"".join(map(self.bytes_a.__getitem__, a.tolist())) != data:
                a, b, data = a[:0], [], b""
            a_parts.append(a)
            b_parts.append(np.array(b, np.int64))
            sizes.append(len(data))
        count = lambda x: np.array([len(y) for y in x], np.int64)
        return np.concatenate(a_parts), np.concatenate(b_parts), count(a_parts), count(b_parts), np.array(sizes, np.int64)

    def pieces(self, text: str) -> Iterator[str]:
        """The text after a blank, cut between units where it is long."""
        text, at = f" {text}", 0
        while at < len(text):
            cut = CUT.search(text, at + PIECE_CHARS) if self.apart else None
            end = cut.start() if cut else len(text)
            yield text[at:end] if at or cut else text
            at = end

    def split(self, piece: str) -> list[str]:
        return CUT.split(piece) if self.apart else [piece]

    def fits(self, piece: str) -> bool:
        if len(self.units) > REMEMBERED_UNITS:
            self.forget()
        units = self.split(piece)
        return bool(self.fit[self.numbers(iter(units), len(units))].all())

    def read(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The row and the number of each unit of texts that both tokenizers give back; rows ascend. Numbers hold until the next are asked for."""
        held, size = [], 0

        def told() -> tuple[np.ndarray, np.ndarray]:
            if len(self.units) > REMEMBERED_UNITS:
                self.forget()
            number = self.numbers(itertools.chain.from_iterable(u for _, u in held), size)
            row = np.repeat([r for r, _ in held], [len(u) for _, u in held])
            bad = np.unique(row[~self.fit[number]])
            keep = ~np.isin(row, bad) if len(bad) else slice(None)
            return row[keep], number[keep]

        for row, text in enumerate(texts):
            text = text.as_py()
            if not text:
                continue
            if self.apart and len(text) > PIECE_CHARS and not all(map(self.fits, self.pieces(text))):
                continue  # a text of several pieces is known to fit before the first of them counts
            for piece in self.pieces(text):
                units = self.split(piece)
                held.append((row, units))
                size += len(units)
                if size > TOGETHER_UNITS:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    def pairs_of(self, units: np.ndarray) -> np.ndarray:
        return self.pairs[expand(self.start[units], self.n_links[units])]


class Aligned:
    """The tokens of some units, and which of them end together."""

    def __init__(self, by: Aligner, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, size: np.ndarray) -> None:
        """a, b: ids of all units; n_a, n_b: how many each unit has; size: its bytes."""
        self.by, self.rows = by, len(size)
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        # units follow each other, so that the ends of all tokens ascend
        self.end_a, self.end_b = np.cumsum(by.length_a[self.a]), np.cumsum(by.length_b[self.b])
        # no token is empty, so a place ends one token of each
        there = np.minimum(np.searchsorted(self.end_b, self.end_a), max(len(b) - 1, 0))
        self.at_a = np.flatnonzero(self.end_b[there] == self.end_a) if len(b) else np.zeros(0, np.int64)
        self.at_b, self.common = there[self.at_a], self.end_a[self.at_a]
        self.pairs = self.a[self.at_a] * by.size_b + self.b[self.at_b]
        self.row = np.searchsorted(np.cumsum(size), self.common)  # of each link
        self.n_links = np.bincount(self.row, minlength=self.rows)

    def groups(self) -> list[str]:
        """Each unit's groups, as ids of the first and of the second tokenizer."""
        by = self.by
        group_a, group_b = np.searchsorted(self.common, self.end_a), np.searchsorted(self.common, self.end_b)
        before_a = np.searchsorted(group_a, np.arange(len(self.common) + 1))  # tokens before each group
        before_b = np.searchsorted(group_b, np.arange(len(self.common) + 1))
        out = np.empty(len(self.a) + len(self.b), np.int64)
        mark_a, mark_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        mark_a[self.at_a], mark_b[self.at_b] = 1, 1
        out[np.arange(len(self.a)) + before_b[group_a]] = self.a + mark_a * by.size_a
        out[np.arange(len(self.b)) + before_a[group_b + 1]] = self.b + 2 * by.size_a + mark_b * by.size_b
        words = list(map(by.text.__getitem__, out.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(words[s:e])[:-1] for s, e in zip([0, *ends], ends, strict=False)]


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their sums of n."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(n, begin) if len(keys) else n


class PerfectHash:
    """Distinct keys to 0, 1, ... without gaps; other keys to some index or -1."""

    def __init__(self, keys: np.ndarray) -> None:
        marks, self.offsets, left = [], [0], keys
        while len(left):
            size = -(-max(64, int(SPARSE * len(left))) // 64) * 64
            place = self._place(left, len(marks), size)
            alone = np.bincount(place, minlength=size) == 1
            marks.append(alone)
            self.offsets.append(self.offsets[-1] + size)
            left = left[~alone[place]]
        bits = np.concatenate(marks) if marks else np.zeros(0, bool)
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.ranks = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (start, end) in enumerate(zip(self.offsets, self.offsets[1:], strict=False)):
            if not len(open_):
                break
            at = start + self._place(keys[open_], level, end - start)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = self.ranks[at[hit] >> 6] + below[hit]
            open_ = open_[~hit]
        return out


def part_of(pairs: np.ndarray, parts: int) -> np.ndarray:
    return (pairs * SPREAD >> DROPPED) % parts


def part_column(parts: int):
    return (F.shiftright(F.col("pair") * F.lit(SPREAD), DROPPED) % F.lit(parts)).cast("int").alias("part")


class Part:
    """A part's keys by index, their counts, and its hash; as a file in the shared folder."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray | None = None, hash_: PerfectHash | None = None) -> None:
        if hash_ is None:
            hash_ = PerfectHash(keys)
            placed = np.empty_like(keys)
            placed[hash_(keys)] = keys
            keys = placed
        self.hash, self.keys, self.counts = hash_, keys, counts

    def found(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of pairs; 0 for one that isn't a key here."""
        at = self.index(pairs)
        return np.where(at >= 0, self.counts[np.maximum(at, 0)], 0) if len(self.keys) else np.zeros(len(pairs), np.int64)

    def index(self, pairs: np.ndarray) -> np.ndarray:
        at = self.hash(pairs)
        return np.where((at >= 0) & (self.keys[np.maximum(at, 0)] == pairs), at, -1) if len(self.keys) else at

    @property
    def bytes(self) -> int:
        return 2 * self.keys.nbytes + self.hash.words.nbytes + self.hash.ranks.nbytes

    def save(self, folder: str) -> str:
        """The file's name: a new one each time, so that a task run twice overwrites nothing."""
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        name, data = uuid.uuid4().hex, io.BytesIO()
        counts = np.zeros(0, np.int64) if self.counts is None else self.counts
        np.savez(data, keys=self.keys, counts=counts, words=self.hash.words, ranks=self.hash.ranks, offsets=np.array(self.hash.offsets))
        with store.open_output_stream(f"{base}/{name}") as out:
            out.write(data.getvalue())
        return name


_KEPT: OrderedDict[str, Part] = OrderedDict()


def part(folder: str, name: str) -> Part:
    """A part's file; the parts used last stay in memory."""
    if name not in _KEPT:
        store, base = file_system(folder)
        with store.open_input_stream(f"{base}/{name}") as source:
            data = np.load(io.BytesIO(source.read()))
        hash_ = PerfectHash.__new__(PerfectHash)
        hash_.words, hash_.ranks, hash_.offsets = data["words"], data["ranks"], data["offsets"].tolist()
        got = Part(data["keys"], data["counts"], hash_)
        while _KEPT and sum(x.bytes for x in _KEPT.values()) + got.bytes > KEPT_BYTES:
            _KEPT.popitem(last=False)
        _KEPT[name] = got
    _KEPT.move_to_end(name)
    return _KEPT[name]


_LOADED: dict[str, Aligner] = {}


def aligner(files: tuple[str, bytes]) -> Aligner:
    key = hashlib.sha256(files[0].encode() + files[1]).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(*files)
    return _LOADED[key]


def _pairs(files):
    """Each task's different pairs and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(files.value)
        none = np.zeros(0, np.int64)
        held = (none, none)
        for b in batches:
            for _, number in by.read(b.column(0)):
                n = np.bincount(number, minlength=by.known)
                used = np.flatnonzero(n)
                held = summed(np.r_[held[0], by.pairs_of(used)], np.r_[held[1], np.repeat(n[used], by.n_links[used])])
                if len(held[0]) > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["pair", "n"])
                    held = (none, none)
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["pair", "n"])

    return run


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of one part after another (column 0)."""
    now, held = None, []
    for b in batches:
        numbers = np.array(b.column(0))
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s < e:
                if numbers[s] != now:
                    if held:
                        yield now, held
                    now, held = int(numbers[s]), []
                held.append(b.slice(s, e - s))
    if held:
        yield now, held


def _hashes(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _by_part(batches):
            name = Part(np.concatenate([np.array(b.column(1)) for b in rows])).save(folder)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([name])], names=["part", "name"])

    return run


def _vectors(folder: str, names):
    """A part's vector of counts, in each task that holds pairs of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        source = TaskContext.get().partitionId()
        now, counts = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([source], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["part", "source", "counts"])

        for b in batches:  # sorted by part: one vector at a time
            for number, rows in _by_part(iter([b])):
                if number != now:
                    if now is not None:
                        yield row()
                    now, counts = number, np.zeros(len(part(folder, names.value[number]).keys), np.int64)
                for x in rows:
                    at = part(folder, names.value[number]).index(np.array(x.column(1)))
                    np.add.at(counts, at, np.array(x.column(2)))
        if now is not None:
            yield row()

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one part and source, which follow each other, added up."""
    now, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "source", "counts"])

    for b in batches:
        for number, source, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            vector = np.frombuffer(counts.as_buffer(), np.int64)
            if (number, source) == now:
                total += vector
            else:
                if now is not None:
                    yield row()
                now, total = (number, source), vector.copy()
    if now is not None:
        yield row()


def _tables(folder: str, names, size_b: int):
    """Each part with its counts, as a file; a row for each id of the second tokenizer in it, with its highest count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, counts in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                old = part(folder, names.value[number])
                new = Part(old.keys, np.frombuffer(counts.as_buffer(), np.int64), old.hash)
                name = new.save(folder)
                ids = new.keys % size_b
                best = np.zeros(size_b, np.int64)
                np.maximum.at(best, ids, new.counts)
                ids = np.unique(ids)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int32()), pa.array([name] * len(ids)), pa.array(ids), pa.array(best[ids])], names=["part", "name", "id", "best"])

    return run


def _rows(files, folder: str, parts: int, names, best):
    def counted(pairs: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs, part after part."""
        out, of = np.zeros(len(pairs), np.int64), part_of(pairs, parts)
        order = np.argsort(of, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else ():
            out[some] = part(folder, names.value[of[some[0]]]).found(pairs[some])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(files.value).with_texts(True)
        for b in batches:
            n = b.num_rows
            n_a, n_b, n_links, n_best, total = (np.zeros(n, np.int64) for _ in range(5))
            digests = [None] * n
            for row, number in by.read(b.column(1)):
                used, at = np.unique(number, return_inverse=True)
                links = by.pairs_of(used)
                pairs, of = np.unique(links, return_inverse=True)
                count = counted(pairs)
                is_best = count == best.value[pairs % by.size_b]
                unit = np.repeat(np.arange(len(used)), by.n_links[used])
                sums, bests = np.zeros(len(used), np.int64), np.zeros(len(used), np.int64)
                np.add.at(sums, unit, count[of])
                np.add.at(bests, unit, is_best[of])
                for out, of_unit in ((n_a, by.n_a[used]), (n_b, by.n_b[used]), (n_links, by.n_links[used]), (n_best, bests), (total, sums)):
                    np.add.at(out, row, of_unit[at])
                texts = list(map(by.groups.__getitem__, number.tolist()))
                cuts = np.flatnonzero(np.diff(row, prepend=-1)).tolist() if len(row) else []
                for s, e in zip(cuts, [*cuts[1:], len(row)], strict=True):
                    r = int(row[s])
                    more, text = digests[r] is not None, ";".join(texts[s:e])
                    digests[r] = digests[r] or hashlib.sha256()
                    digests[r].update((";" + text if more else text).encode())
            columns = [pa.array(x) for x in (n_a, n_b, n_links, n_links, n_best, total)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array([d.hexdigest() if d else "" for d in digests], pa.string())], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def alignment(docs: DataFrame, vocabulary: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    vocabulary, pieces: paths of the two tokenizers' files on the driver; their content, some megabytes whatever the
    corpus, is broadcast. docs is read twice.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, encoding="utf-8") as f, open(pieces, "rb") as g:
        content = f.read(), g.read()
    by = Aligner(*content)
    files = spark.sparkContext.broadcast(content)
    text = column(text_col).cast("string").alias("text")
    partial = written(docs.select(text).mapInArrow(_pairs(files), "pair long, n long"))
    keys = written(partial.select("pair").distinct())
    n_rows, n_keys = partial.count(), keys.count()
    parts = max(1, -(-n_keys // PART_PAIRS))
    folder = shared_dir(spark)
    dealt = keys.select(part_column(parts), "pair").repartition(parts, "part").sortWithinPartitions("part")
    made = written(dealt.mapInArrow(_hashes(folder), "part int, name string"))
    found = {r.part: r.name for r in made.collect()}
    names = spark.sparkContext.broadcast(found)
    sources = max(1, n_rows // max(n_keys, 1))
    rows = partial.select(part_column(parts), "pair", "n").coalesce(sources).sortWithinPartitions("part")
    vectors = rows.mapInArrow(_vectors(folder, names), "part int, source int, counts binary")
    while True:
        sources = -(-sources // FAN)
        moved = vectors.select("part", (F.col("source") / FAN).cast("int").alias("source"), "counts")
        vectors = moved.repartition(parts * sources, "part", "source").sortWithinPartitions("part", "source").mapInArrow(_sums, "part int, source int, counts binary")
        if sources == 1:
            break
    counted = written(vectors.mapInArrow(_tables(folder, names, by.size_b), "part int, name string, id long, best long"))
    final = spark.sparkContext.broadcast({r.part: r.name for r in counted.select("part", "name").distinct().collect()})
    best = np.zeros(by.size_b, np.int64)
    for r in counted.groupBy("id").agg(F.max("best").alias("best")).collect():  # as many rows as the second has ids, at most
        best[r.id] = r.best
    schema = "id {}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string".format(docs.schema[id_col].dataType.simpleString())
    out = docs.select(column(id_col).alias("id"), text).mapInArrow(_rows(files, folder, parts, final, spark.sparkContext.broadcast(best)), schema)
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
