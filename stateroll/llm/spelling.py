"""Spelling variants: words one edit apart, found in FM-indexes by search schemes, and grouped under their commonest form.

Words are counted in one pass with partial sums. Two words that differ by one edit agree in the first or in the last half
of either, so there are two searches: match the last half of a word exactly, anchored at the delimiter that ends
each word, and extend to the left across the other half, allowing one error; and the mirror image of it, from the
delimiter before a word to the right. The first runs in FM-indexes of the delimited words, the second in FM-indexes of
the delimited reversed words: the two directions of a bidirectional index, each of which a scheme of two parts needs in one
direction only. A search is an interval of suffix ranks; all words of a batch are extended together, one symbol a step,
and an error branches into the symbols that the interval's suffixes have before them.

The vocabulary is dealt into shards by the two characters next to the anchor, which both words of a pair share: by the
last two for the first search, by the first two for the second. A group of words that is larger than a shard is dealt
into several by hash, and its words are searched in each of them; no group is cut short. A pair that both searches
would find is kept by the first only, so that counts are sums. Nothing is collected but the sizes of the groups of two
characters, of which the alphabet allows 2 * 90 * 90.

A word's form is its commonest near word, if that is common enough; forms grow along a chain, so roots follow by pointer
doubling in as many rounds as the logarithm of the longest chain.

Defined cases: null texts have no words, a null id is the empty string where runs are hashed; empty texts have none; a text or a run of any
length is read whole; of near words equally frequent the smallest in code-point order is the form; repeated rows count
again; an empty table gives none; only id and text are read, so no other column's name can clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stateroll.llm.common import column, drop_written, shared_dir, small_batches, table, written
from stateroll.llm.textarrays import expand

#: Code points a word has at least, its occurrences at least, and how many times a word's count its form has at least.
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 5, 3, 2
#: A run whose hash this divides loses a code point.
SLIP = 97
#: Code points of a shard's words at most (a longer word is a shard of its own), and words searched at a time.
SHARD_CHARS, BATCH_WORDS = 1 << 20, 4096
#: Different words that a counting task holds before it sends them on.
HELD_WORDS = 200_000


def runs_of(text: str, least: int) -> list[bytes]:
    """Runs of the letters A-Z, a-z and U+00C0 to U+00FF, of `least` at least, A-Z in lower case; a byte stands for a code point."""
    return re.findall(rb"[a-z\xc0-\xff]{%d,}" % least, text.encode("latin-1", "replace").lower())


def slipped(doc_id: object, run: bytes) -> bytes:
    """The run, without one code point if its hash with the document's id says so."""
    h = zlib.crc32(b"%s:%s" % (b"" if doc_id is None else str(doc_id).encode(), run if run.isascii() else run.decode("latin-1").encode()))
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all texts that are long and frequent enough."""
    small_batches(docs.sparkSession)

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for word, n in Counter(runs_of(text.as_py() or "", LEAST_LENGTH)).items():
                    word = slipped(doc_id, word)
                    if len(word) >= LEAST_LENGTH:
                        counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield batch(counts)
                    counts.clear()
        if counts:
            yield batch(counts)

    found = docs.select(column(id_col).cast("string").alias("id"), column(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class FmIndex:
    """Suffix ranks of words, each ended by a delimiter (symbol 0), searched from the words' ends to the left."""

    def __init__(self, words: list[bytes]) -> None:
        raw = np.frombuffer(b"\x00".join(words) + b"\x00", np.uint8)
        used = np.unique(raw)
        self.code = np.full(256, len(used), np.int64)  # a symbol that no word has: its intervals are empty
        self.code[used] = np.arange(len(used))
        self.symbols, self.size, self.words = len(used) - 1, len(raw), len(words)
        text = self.code[raw]
        order = suffix_order(text, len(used))
        before = text[order - 1]
        by_symbol = np.argsort(before, kind="stable")
        #: Symbol before a suffix, and the suffix's rank, in this order: where a pair would go in is the rank it is extended to.
        self.table = before[by_symbol] * self.size + by_symbol
        self.before = before
        self.text, self.start = text, np.r_[0, np.flatnonzero(text == 0)[:-1] + 1]
        self.word_of = np.searchsorted(self.start, order[by_symbol[: self.words]])  # of the suffixes that are whole words

    def extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = symbol * self.size
        return np.searchsorted(self.table, base + low), np.searchsorted(self.table, base + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of an interval, and a symbol that may stand before it, for each such pair."""
        wide = np.flatnonzero(high - low > self.symbols)
        close = np.flatnonzero(high - low <= self.symbols)
        width = self.symbols + 1
        near = np.unique(np.repeat(close, (high - low)[close]) * width + self.before[expand(low[close], (high - low)[close])])
        near = near[near % width > 0]
        return np.r_[np.repeat(wide, self.symbols), near // width], np.r_[np.tile(np.arange(1, width), len(wide)), near % width]

    def one_edit(self, queries: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for each word that has the last `exact` symbols of a query and before them exactly one error. queries: a row each."""
        n, length = queries.shape
        who, low, high = np.arange(n), np.zeros(n, np.int64), np.full(n, self.words, np.int64)
        none = np.zeros(0, np.int64)
        erred = (none, none, none)
        for at in range(length - 1, -2, -1):
            if at < length - exact:
                k, symbol = self.branches(low, high)
                a, b = self.extended(symbol, low[k], high[k])
                held = a < b
                k, symbol, a, b = k[held], symbol[held], a[held], b[held]
                erred = tuple(np.r_[x, y] for x, y in zip(erred, (who[k], a, b), strict=True))  # a symbol more
            if at < 0:
                break
            c, a2, b2 = erred
            a2, b2 = self.extended(queries[c, at], a2, b2)
            live = a2 < b2
            erred = (c[live], a2[live], b2[live])
            if at < length - exact:
                other = symbol != queries[who[k], at]
                # another symbol; a symbol less
                erred = tuple(np.concatenate(x) for x in zip(erred, (who[k][other], a[other], b[other]), (who, low, high), strict=True))
            low, high = self.extended(queries[who, at], low, high)
            live = low < high
            who, low, high = who[live], low[live], high[live]
            if not len(who) and not len(erred[0]):
                break
        who, low, high = erred
        first, last = np.searchsorted(self.table, low), np.searchsorted(self.table, high)
        whole = first < last  # the suffix is a word: a delimiter comes before it, and words are distinct
        pairs = np.unique(who[whole] * self.words + self.word_of[first[whole]])
        return pairs // self.words, pairs % self.words

    def ends_with(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each word's last symbols are those of its row of ends."""
        stop = np.r_[self.start[1:], self.size] - 1
        out = np.ones(len(words), bool)
        for k in range(ends.shape[1]):
            place = stop[words] - 1 - k
            out &= (place >= self.start[words]) & (self.text[np.maximum(place, 0)] == ends[:, -1 - k])
        return out

    def begins_with(self, words: np.ndarray, begins: np.ndarray) -> np.ndarray:
        out = np.ones(len(words), bool)
        for k in range(begins.shape[1]):  # a delimiter differs from all symbols, so no word is overrun
            out &= self.text[np.minimum(self.start[words] + k, self.size - 1)] == begins[:, k]
        return out


def suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Begins of the suffixes, sorted by their symbols up to the first delimiter (0), then by place."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the delimiter
    bits = max(1, int(symbols).bit_length())
    depth = min(62 // bits, int(left.max()) + 1)
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = key << bits | np.where(left >= k, text[np.minimum(np.arange(n) + k, n - 1)], 0)
    rank = np.unique(key, return_inverse=True)[1]
    while depth <= left.max() and rank.max() + 1 < n:
        after = np.where(left >= depth, rank[np.minimum(np.arange(n) + depth, n - 1)], 0)
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
        depth *= 2
    return np.argsort(rank, kind="stable")


class Shard:
    """A shard's words, its index, and the near words of others."""

    def __init__(self, first_half: bool, words: list[bytes], n: list[int]) -> None:
        self.first_half = first_half
        self.words, self.n = words, np.array(n, np.int64)
        self.index = FmIndex([w[::-1] for w in words] if first_half else words)
        self.place = np.empty(len(words), np.int64)
        self.place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))

    def near(self, queries: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """Queries of one length, with their number of near words, and the count and number here of the commonest (-1: none)."""
        by_length: dict[int, list[bytes]] = {}
        for q in queries:
            by_length.setdefault(len(q), []).append(q)
        for length, every in by_length.items():
            size = max(1, min(BATCH_WORDS, SHARD_CHARS // length))
            for at in range(0, len(every), size):
                some = every[at : at + size]
                codes = self.index.code[np.frombuffer(b"".join(some), np.uint8)].reshape(len(some), length)
                if self.first_half:
                    codes = codes[:, ::-1]
                    who, word = self.index.one_edit(codes, length // 2)
                    # those that share the last half are the other search's
                    other = self.index.begins_with(word, codes[who][:, : length - length // 2])
                    who, word = who[~other], word[~other]
                else:
                    who, word = self.index.one_edit(codes, length - length // 2)
                order = np.lexsort((self.place[word], -self.n[word], who))
                who, word = who[order], word[order]
                first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else who
                best = np.full(len(some), -1, np.int64)
                best[who[first]] = word[first]
                yield some, np.bincount(who, minlength=len(some)), np.where(best >= 0, self.n[best], 0), best


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one shard after another: first its own words (role 0), then words that are only searched (role 1)."""
    held: list[tuple[bytes, int]] = []
    shard, now, half = None, None, False

    def answers(rows: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        counts = dict(rows)
        for some, n_near, near_n, best in shard.near(list(counts)):
            near = [shard.words[k].decode("latin-1") if k >= 0 else None for k in best.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in some], pa.string()), pa.array([counts[w] for w in some], pa.int64()), pa.array(n_near, pa.int64()), pa.array(near_n, pa.int64()), pa.array(near, pa.string())], names=["word", "n", "n_near", "near_n", "near"])

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal shard, held
        if shard is None and held:
            shard = Shard(half, [w for w, _ in held], [n for _, n in held])
            yield from answers(held)
            held = []

    for b in batches:
        numbers, roles = np.array(b.column(0)), np.array(b.column(1))
        cuts = [0, *(np.flatnonzero((numbers[1:] != numbers[:-1]) | (roles[1:] != roles[:-1])) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            if numbers[s] != now:
                yield from settle()
                shard, held, now, half = None, [], numbers[s], b.column(2)[s].as_py()
            rows = [(w.encode("latin-1"), n) for w, n in zip(b.column(3).slice(s, e - s).to_pylist(), b.column(4).slice(s, e - s).to_pylist(), strict=True)]
            if roles[s] == 0:
                held += rows
            else:
                yield from settle()
                if shard is not None:
                    yield from answers(rows)
    yield from settle()


def dealt(sizes: list[tuple[bool, str, int]], limit: int) -> list[tuple[bool, str, int, int]]:
    """For each group (side, key, size): its first shard and how many it has. Small groups of a side share a shard."""
    out, shard, fill, side = [], -1, 0, None
    for half, key, size in sorted(sizes):
        if size > limit:
            many = -(-size // limit)
            out.append((half, key, shard + 1, many))
            shard, fill = shard + many, limit
            side = half
            continue
        if half != side or fill + size > limit:
            shard, fill, side = shard + 1, 0, half
        out.append((half, key, shard, 1))
        fill += size
    return out


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, and the commonest near word with its count (null: none), for words with their counts. words is read twice."""
    spark = words.sparkSession
    sides = F.explode(F.array(F.struct(F.lit(True).alias("half"), F.substring("word", 1, 2).alias("key")), F.struct(F.lit(False).alias("half"), F.substring("word", -2, 2).alias("key"))))
    both = words.select("word", "n", sides.alias("side")).select("word", "n", "side.half", "side.key")
    # at most 2 * 90 * 90 rows: what the alphabet allows
    sizes = [tuple(r) for r in both.groupBy("half", "key").agg(F.sum(F.length("word") + 1)).collect()]
    limit = max(1 << 13, min(SHARD_CHARS, sum(s for _, _, s in sizes) // (4 * spark.sparkContext.defaultParallelism)))
    groups = dealt(sizes, limit)
    shards = groups[-1][2] + groups[-1][3] if groups else 1
    deal = F.broadcast(spark.createDataFrame(groups, "half boolean, key string, first int, many int"))
    placed = both.join(deal, ["half", "key"]).withColumn("own", F.pmod(F.xxhash64("word"), F.col("many")).cast("int"))
    copies = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("k"))
    rows = copies.select((F.col("first") + F.col("k")).alias("shard"), F.when(F.col("k") == F.col("own"), 0).otherwise(1).alias("role"), "half", "word", "n")
    found = rows.repartition(shards, "shard").sortWithinPartitions("shard", "role").mapInArrow(_search, "word string, n long, n_near long, near_n long, near string")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("w"))))
    merged = found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n", "n_near", F.col("best.w").alias("near"), (-F.col("best.k")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain. links: word, to; a row a word that has a next one."""
    spark, path, now = links.sparkSession, None, links
    while True:
        ahead = now.select(F.col("word").alias("to"), F.col("to").alias("next"))
        new_path = shared_dir(spark)
        step = written(now.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), new_path)
        if path:
            drop_written(spark, path)
        now, path = step.select("word", "to"), new_path
        if step.where("moved").isEmpty():
            return now.withColumnRenamed("to", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a word: word, form, root, n, n_near, form_n."""
    words = written(word_counts(docs, id_col, text_col))
    near = near_words(words)
    has_form = F.col("near_n") >= FORM_RATIO * F.col("n")
    formed = written(near.select("word", F.when(has_form, F.col("near")).alias("form"), "n", "n_near", F.when(has_form, F.col("near_n")).alias("form_n")))
    ends = roots(formed.where("form IS NOT NULL").select("word", F.col("form").alias("to")))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))
