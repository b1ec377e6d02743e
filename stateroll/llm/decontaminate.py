"""Benchmark decontamination with training suffix arrays.

A task reads its documents in Arrow batches. Of SHARD_BYTES of rows, a shard, it keeps of each text the runs of words
that can hold a benchmark window: consecutive words whose adjacent pairs all occur in the benchmark (held against the
words themselves, not only their hashes); a word outside such runs can't be part of a match of a window. The kept runs
are the training text of the shard, and its suffix array is built by prefix doubling. Every benchmark suffix whose
first two words stand in the shard is searched in it by binary search, word by word, which gives the longest verbatim
match and all its places. Windows of `window` words found there mark the words that they cover.

No shuffle: a row stays in its task, and results are of whole rows. The benchmark is cut into blocks of at most
BLOCK_BYTES of text (a longer item into parts that overlap by all words of a window but one), which Spark's tasks
index and write into the shared folder; a scanning task opens one after another for each of its shards, in one pass,
and holds KEPT_BLOCKS at most. Nothing of the benchmark but the blocks' names goes through the driver.

Defined cases: null texts have no words; a document of no words isn't contaminated; an item of fewer than `window`
words is one window, one of none has no window; items of null id mark words but aren't listed; rows with the same
item id are one item; repeated documents get equal rows; very long texts are searched whole (a longest match that
goes across parts of a cut item counts by its part); an empty benchmark hits nothing, and an empty table gives none;
rows are carried as one struct, so columns of any name stay.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stateroll.llm.common import column, file_system, shared_dir, small_batches, steps, table, text_buffers, with_row, written
from stateroll.llm.textarrays import LOWER, expand, hashes, member, spans

WINDOW = 13
#: Benchmark text in one block, and blocks that a worker keeps.
BLOCK_BYTES, KEPT_BLOCKS = 16 << 20, 2
#: Kept words of one suffix array, and bytes of rows that are searched together.
SHARD_WORDS, SHARD_BYTES = 1 << 20, 32 << 20
#: Bytes that are word bytes: everything but ASCII that is neither letter nor digit.
WORD = np.ones(256, bool)
WORD[[b for b in range(128) if not chr(b).isalnum()]] = False

FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType(), False)), T.StructField("items", T.ArrayType(T.StringType(), False)),
    T.StructField("longest", T.LongType()), T.StructField("longest_at", T.LongType()), T.StructField("longest_item", T.StringType()),
]


class Suffixes:
    """Which suffixes begin with a key."""

    def __init__(self, keys: np.ndarray, suffix: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.suffix = suffix[order]
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.r_[self.first, len(keys)]

    def at(self, keys: np.ndarray) -> np.ndarray:
        k = member(keys, self.keys)
        k = k[k >= 0]
        return self.suffix[expand(self.first[k], self.first[k + 1] - self.first[k])]


class Benchmark:
    """A block of the benchmark: its words as numbers, its windows and its word pairs."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int) -> None:
        texts = pa.array([t for _, t in rows], pa.large_string())
        data, offsets = text_buffers(texts)
        data = LOWER[data]
        begin, end = spans(WORD[data], offsets)
        raw = data.tobytes()
        words = [raw[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
        self.numbers = {w: k for k, w in enumerate(sorted(set(words)))}
        item = np.searchsorted(offsets, begin, "right") - 1
        size = np.bincount(item, minlength=len(rows)) if len(item) else np.zeros(len(rows), np.int64)
        first = np.cumsum(size) - size
        self.symbols = np.array([self.numbers[w] for w in words], np.int64)
        self.item = item
        self.item_id = [i for i, _ in rows]
        self.left = (first + size)[item] - np.arange(len(item)) if len(item) else item  # words of the item from here on
        need = np.minimum(size, window)[item] if len(item) else item
        self.window = np.where(self.left >= need, need, 0)  # words of the window that begins here, 0 for none
        self.least = int(self.window[self.window > 0].min()) if len(item) else 1
        v = len(self.numbers) + 1
        pairs = np.flatnonzero(self.left > 1) if len(item) else item
        self.paired = Suffixes(self.symbols[pairs] * v + self.symbols[pairs + 1], pairs)
        alone = np.flatnonzero(self.window == 1)
        self.single = Suffixes(self.symbols[alone], alone)
        spelled = b"".join(self.numbers)
        ends = np.cumsum([len(w) for w in self.numbers]).astype(np.int64)
        h = hashes(np.frombuffer(spelled, np.uint8), np.r_[0, ends][:-1].astype(np.int64), ends) if len(ends) else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hashes, self.number_of = h[order], order


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The suffixes of symbols in order, by prefix doubling. Symbols below 0 differ from each other and end a match."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    order = np.argsort(rank, kind="stable")
    while step < n:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        held = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, held[1:] != held[:-1]])
        rank = new
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    return order


def search(text: np.ndarray, order: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, ...]:
    """The benchmark suffixes whose first two words stand in the text (or whose item is one word that does), and for each: words of its longest match, the range of `order` that matches so far, and the range for its window."""
    n = len(order)
    v = len(bench.numbers) + 1
    next_to = np.flatnonzero((text[:-1] >= 0) & (text[1:] >= 0))
    live = np.sort(np.r_[bench.paired.at(np.unique(text[next_to] * v + text[next_to + 1])), bench.single.at(np.unique(text[text >= 0]))])
    suffix = live
    m = len(live)
    low, high = np.zeros(m, np.int64), np.full(m, n, np.int64)
    depth = np.zeros(m, np.int64)
    window_low, window_high = np.zeros(m, np.int64), np.zeros(m, np.int64)
    padded = np.r_[text, -(1 << 62)]
    live = np.arange(m)
    d = 0
    while len(live):
        live = live[bench.left[suffix[live]] > d]
        if not len(live):
            break
        want = bench.symbols[suffix[live] + d]
        ends = []
        for above in (False, True):  # the first place at or above, and the first place above, the wanted word
            a, b = low[live].copy(), high[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                got = padded[np.minimum(order[np.minimum(mid, n - 1)] + d, n)]
                less = open_ & ((got <= want) if above else (got < want))
                a, b = np.where(less, mid + 1, a), np.where(open_ & ~less, mid, b)
            ends.append(a)
        found = ends[0] < ends[1]
        live = live[found]
        low[live], high[live] = ends[0][found], ends[1][found]
        d += 1
        depth[live] = d
        whole = live[bench.window[suffix[live]] == d]
        window_low[whole], window_high[whole] = low[whole], high[whole]
    return suffix, depth, low, high, window_low, window_high


def deepest(n: int, depth: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each place of `order`, which match of the most words it has, or -1. Ranges lie within each other or apart, so deeper ones overwrite."""
    out = np.full(n, -1, np.int64)
    by_range = np.lexsort((-depth, high, low))
    first = np.r_[True, (low[by_range][1:] != low[by_range][:-1]) | (high[by_range][1:] != high[by_range][:-1])] if len(depth) else np.zeros(0, bool)
    one = by_range[first]
    one = one[depth[one] > 0]
    for k in one[np.argsort(depth[one], kind="stable")].tolist():
        out[low[k] : high[k]] = k
    return out


class Found:
    """What is known of a row: spans of hit words, items, and its longest match."""

    def __init__(self) -> None:
        self.hits: list[tuple[int, int]] = []
        self.items: set[str] = set()
        self.longest: tuple[int, int | None, str | None] = (0, None, None)

    def match(self, words: int, at: int, item: str | None) -> None:
        if words > self.longest[0] or words == self.longest[0] and words and at < self.longest[1]:
            self.longest = (words, at, item)


class Shard:
    """Rows of a task that are searched together, of SHARD_BYTES at most (but for one Arrow batch)."""

    def __init__(self) -> None:
        self.batches: list[tuple[pa.RecordBatch, pa.Array]] = []
        self.bytes = 0

    def add(self, batch: pa.RecordBatch, texts: pa.Array) -> None:
        self.batches.append((batch, texts))
        self.bytes += batch.nbytes

    def results(self, blocks: list[str], folder: str) -> Iterator[tuple[pa.RecordBatch, dict[str, list]]]:
        """Each waiting batch with its rows' results; one block of the benchmark after another."""
        counts = [np.concatenate([np.zeros(0, np.int64), *(words_of(*text_buffers(texts.slice(a, b - a)))[2] for a, b in _steps(texts))]) for _, texts in self.batches]
        per_row: dict[tuple[int, int], Found] = {}
        for name in blocks:
            self._scan(loaded(folder, name), per_row)
        none = Found()
        for i, (batch, _) in enumerate(self.batches):
            rows = [per_row.get((i, k), none) for k in range(batch.num_rows)]
            yield batch, {
                "n_words": counts[i].tolist(), "hits": [[x for span in united(r.hits) for x in span] for r in rows], "items": [sorted(r.items) for r in rows],
                "longest": [r.longest[0] for r in rows], "longest_at": [r.longest[1] for r in rows], "longest_item": [r.longest[2] for r in rows],
            }
        self.batches, self.bytes = [], 0

    def _scan(self, bench: Benchmark, per_row: dict[tuple[int, int], Found]) -> None:
        """Suffix arrays of SHARD_WORDS words at most (a longer run of one text is one of its own)."""
        runs, size = [], 0
        for i, (_, texts) in enumerate(self.batches):
            for a, b in _steps(texts):
                for row, at, ids in candidates(bench, *text_buffers(texts.slice(a, b - a))):
                    if runs and size + len(ids) > SHARD_WORDS:
                        _match(bench, runs, per_row)
                        runs, size = [], 0
                    runs.append(((i, a + row), at, ids))
                    size += len(ids)
        if runs:
            _match(bench, runs, per_row)


def _steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    return steps(np.array(pc.fill_null(pc.binary_length(texts), 0), np.int64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and how many each text has."""
    begin, end = spans(WORD[data], offsets)
    return begin, end, np.diff(np.searchsorted(begin, offsets))


def candidates(bench: Benchmark, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Each run of words that may hold a window: its text, its first word's place there, and the words' numbers."""
    data = LOWER[data]
    begin, end, _ = words_of(data, offsets)
    if not len(begin) or not len(bench.numbers):
        return []
    first = np.searchsorted(begin, offsets)  # the number of words before each text
    at = member(hashes(data, begin, end), bench.hashes)
    known = np.flatnonzero(at >= 0)
    if not len(known):
        return []
    ids = bench.number_of[at[known]]
    row = np.searchsorted(first, known, "right") - 1
    v = len(bench.numbers) + 1
    linked = (known[1:] == known[:-1] + 1) & (row[1:] == row[:-1])
    linked[linked] = member((ids[:-1] * v + ids[1:])[linked], bench.paired.keys) >= 0
    cut = np.flatnonzero(~linked) + 1
    run_begin, run_end = np.r_[0, cut], np.r_[cut, len(known)]
    long = run_end - run_begin >= bench.least
    out = []
    for b, e in zip(run_begin[long].tolist(), run_end[long].tolist(), strict=True):
        k = known[b:e]
        raw = data[begin[k[0]] : end[k[-1]]].tobytes()
        low = int(begin[k[0]])
        exact = np.array([bench.numbers.get(raw[x - low : y - low], -1) for x, y in zip(begin[k].tolist(), end[k].tolist(), strict=True)], np.int64)
        out.append((int(row[b]), int(k[0] - first[row[b]]), exact))
    return out


def _match(bench: Benchmark, runs: list[tuple[tuple[int, int], int, np.ndarray]], per_row: dict[tuple[int, int], Found]) -> None:
    """Search the benchmark in the suffix array of the runs, and add what is found to their rows."""
    size = np.array([len(ids) + 1 for *_, ids in runs])
    begin = np.cumsum(size) - size
    text = np.full(size.sum(), -1, np.int64)
    text[expand(begin, size - 1)] = np.concatenate([ids for *_, ids in runs])
    gaps = np.flatnonzero(text < 0)
    text[gaps] = -1 - np.arange(len(gaps))
    order = suffix_array(text)
    suffix, depth, low, high, window_low, window_high = search(text, order, bench)
    run_of = np.repeat(np.arange(len(runs)), size)
    hit = np.zeros(len(text) + 1, np.int64)
    held = np.flatnonzero(window_high > window_low)
    words, item = bench.window[suffix], bench.item[suffix]
    # equal windows share a range: their places are walked once, and their items listed together
    keys = np.stack([window_low[held], words[held]], 1) if len(held) else np.zeros((0, 2), np.int64)
    _, one, group = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    items = np.unique(np.stack([group.ravel(), item[held]], 1), axis=0) if len(held) else np.zeros((0, 2), np.int64)
    edge = np.searchsorted(items[:, 0], np.arange(len(one) + 1))
    for g, w in enumerate(held[one].tolist()):
        places = order[window_low[w] : window_high[w]]
        np.add.at(hit, places, 1)
        np.add.at(hit, places + words[w], -1)
        names = {bench.item_id[k] for k in items[edge[g] : edge[g + 1], 1].tolist()} - {None}
        for r in np.unique(run_of[places]).tolist():
            per_row.setdefault(runs[r][0], Found()).items.update(names)
    span_begin, span_end = spans(np.cumsum(hit[:-1]) > 0, np.r_[begin, len(text)])
    for r, b, e in zip(run_of[span_begin].tolist(), span_begin.tolist(), span_end.tolist(), strict=True):
        row, at, _ = runs[r]
        per_row.setdefault(row, Found()).hits.append((at + b - int(begin[r]), at + e - int(begin[r])))
    best = np.full(len(text), -1, np.int64)
    best[order] = deepest(len(text), depth, low, high)
    deep = np.where(best >= 0, depth[best], 0) if len(depth) else np.zeros(len(text), np.int64)
    most = np.maximum.reduceat(deep, begin)
    for r in np.flatnonzero(most).tolist():
        row, at, ids = runs[r]
        place = int(begin[r] + np.argmax(deep[begin[r] : begin[r] + len(ids)]))
        per_row.setdefault(row, Found()).match(int(most[r]), at + place - int(begin[r]), bench.item_id[bench.item[suffix[best[place]]]])


def united(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without overlaps."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(found):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def pieces(text: str | None, window: int) -> Iterator[str | None]:
    """A text of BLOCK_BYTES at most as it is; a longer one in parts of whole words that overlap by all words of a window but one."""
    raw = (text or "").encode()
    if len(raw) <= BLOCK_BYTES:
        yield text
        return
    begin, end, _ = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    at = 0
    while at < len(begin):
        stop = max(int(np.searchsorted(end, begin[at] + BLOCK_BYTES, "right")), min(at + window, len(begin)))
        yield raw[begin[at] : end[stop - 1]].decode()
        if stop == len(begin):
            break
        at = stop - window + 1


def _written_blocks(folder: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        held, size = [], 0

        def done() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(pickle.dumps(Benchmark(held, window), protocol=5))
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

        for b in batches:
            for item, text in zip(b.column(0), b.column(1), strict=True):
                for piece in pieces(text.as_py(), window):
                    n = len((piece or "").encode())
                    if held and size + n > BLOCK_BYTES:
                        yield done()
                        held, size = [], 0
                    held.append((item.as_py(), piece))
                    size += n
        if held:
            yield done()

    return run


def blocks(benchmark: DataFrame, folder: str, item_col: str, text_col: str, window: int) -> list[str]:
    """The benchmark as files of the folder, of BLOCK_BYTES of text at most, made by Spark's tasks; their names, which alone come to the driver."""
    small_batches(benchmark.sparkSession)
    rows = benchmark.select(column(item_col).cast("string").alias("item"), column(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    made = written(rows.coalesce(max(1, -(-size // BLOCK_BYTES))).mapInArrow(_written_blocks(folder, window), "name string"))
    return [r.name for r in made.collect()]


#: The blocks that a worker read last: one block, as benchmarks usually have, is read once.
_LOADED: dict[str, Benchmark] = {}


def loaded(folder: str, name: str) -> Benchmark:
    if name not in _LOADED:
        while len(_LOADED) >= KEPT_BLOCKS:
            del _LOADED[next(iter(_LOADED))]
        store, base = file_system(folder)
        with store.open_input_stream(f"{base}/{name}") as source:
            _LOADED[name] = pickle.loads(source.read())
    return _LOADED[name]


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Every row of docs as the struct `row`, and its `found` struct.

    n_words; hits: begin and end of each span of hit words; n_hit; items: those with a window here, as sorted strings;
    longest: words of the longest match in a run that could hold a window (0 if there is none), longest_at the number
    of its first word in the document, longest_item the item it belongs to.
    """
    out = with_row(docs)
    schema = T.StructType([out.schema["row"], T.StructField("found", T.StructType(FIELDS))])
    folder = shared_dir(docs.sparkSession)
    out = out.mapInArrow(_scan(blocks(benchmark, folder, item_col, item_text_col, window), folder, text_col), schema)
    n_hit = F.aggregate("found.hits", F.lit(0).cast("long"), lambda total, x: x - total)  # begin and end in turn: differences of differences
    return out.withColumn("found", F.col("found").withField("n_hit", n_hit))


def _scan(names: list[str], folder: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = pa.struct([pa.field(f.name, to_arrow_type(f.dataType)) for f in FIELDS])
        shard = Shard()

        def done() -> Iterator[pa.RecordBatch]:
            for batch, got in shard.results(names, folder):
                columns = [pa.array(got[f.name], kind.field(f.name).type) for f in FIELDS]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(columns, fields=list(kind))], names=["row", "found"])

        for batch in batches:
            if batch.num_rows:
                row = batch.column(0)
                shard.add(batch, row.flatten()[row.type.get_field_index(text_col)].cast(pa.string()))
                if shard.bytes >= SHARD_BYTES:
                    yield from done()
        yield from done()

    return run


def is_contaminated(n_hit, n_words):
    """A document is contaminated if at least a twentieth of its words are hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of docs that aren't contaminated, as they are."""
    found = contamination(docs, benchmark, text_col, **kwargs)
    return found.where(~is_contaminated(F.col("found.n_hit"), F.col("found.n_words"))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("found.items"), ","), 256).alias("items_sha256"),
        is_contaminated(F.col("found.n_hit"), F.col("found.n_words")).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM d, sizes WHERE len(w) >= n),
m AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
