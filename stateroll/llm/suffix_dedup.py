"""Repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered by most-significant-digit passes, `width` (200) bytes deep and no deeper; those that end in one
group are exactly the repeated windows. The first pass is a shuffle and needs a digit that spreads well and keeps
partners together: each window's digit is its anchor, the gram of GRAM bytes within it whose hash is least (the
leftmost of equals). Equal windows have equal anchors at equal places, and some 70 windows in a row share one anchor,
so a row of the shuffle is an anchor, with the stretch of text that its windows cover, and not a window.

  1. Anchors are counted by their gram. A gram that occurs once has no repeated window: most stop here.
  2. Stretches of a gram that are equal are one kind; a kind that occurs twice repeats whole. If all stretches of a
     gram are of one kind, they need no further pass.
  3. Else one stretch of each kind is fetched. A task sorts the windows of a gram's kinds: passes of 8 bytes, which
     split groups and drop the windows that are alone, until the depth is reached.
  4. A group of more than KINDS kinds is first dealt by its next digit: each stretch is cut in two halves by how many
     bytes its windows have before the anchor, and all windows of a half share a core longer than the gram. Equal
     halves repeat whole and go on as one; the others meet in groups of their core, which are sorted as in 3 or dealt
     again. A half of one window is all core, so this ends after eight passes, and a passage that a third of all rows
     share costs a few rows each of them, not one for each window.

In steps 3 and 4 bytes are compared. In step 2 stretches of one gram are held equal if XXH3 of their bytes agrees,
seeded by the anchor's place: a hash of another family than the grams' sum, so that no text is built alike for both.
Two that differ are taken for one with a chance of 2**-64 a pair of one gram.
Everything is judged on the input. Texts go through in steps of bounded size: where a stretch is cut by the end of a
step, it is another kind, and step 3 resolves it.

Defined cases: null is empty; texts shorter than `width` keep all; very long texts go through in overlapping pieces;
the rows of a repeated (id, text) get equal results and count as repeats of each other; rows of null id are rows like
any other; an empty table gives none; matches never cross documents; columns of any name stay, as operators work on
id and text alone and rows are carried as one struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stateroll.llm.common import drop_written, shared_dir, small_batches, steps, table, text_buffers, with_row, written
from stateroll.llm.textarrays import BASE, INVERSE, kept_powers, mix

WIDTH = 200
GRAM = 64
#: Slices of one group that a task sorts; larger groups get another pass of the shuffle first.
KINDS = 500
#: Bytes of texts handled at a time.
STEP = 1 << 20


def least_in_window(values: np.ndarray, w: int) -> np.ndarray:
    """Where the least of values[i:i+w] is, for each i (the leftmost of equals). By blocks of w: least so far from either side."""
    n = len(values)
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    at = np.arange(m).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1)
    new = np.ones(blocks.shape, bool)
    new[:, 1:] = blocks[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    back = blocks[:, ::-1]
    behind = np.minimum.accumulate(back, axis=1)
    new[:, 1:] = back[:, 1:] <= behind[:, :-1]
    behind_at = np.minimum.accumulate(np.where(new, at[:, ::-1], m), axis=1)[:, ::-1].ravel()
    behind, ahead, ahead_at = behind[:, ::-1].ravel(), ahead.ravel(), ahead_at.ravel()
    k = n - w + 1
    left, right = slice(0, k), slice(w - 1, w - 1 + k)
    return np.where(behind[left] <= ahead[right], behind_at[left], ahead_at[right])


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Of texts in one array: for each anchor its text, the begin and end of its stretch and its own place there, and its hashes."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    none = {"text": empty, "begin": empty, "end": empty, "gram": empty, "kind": empty, "place": empty}
    if n < width:
        return none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * kept_powers(n, BASE), out=sums[1:])
    back = kept_powers(n + 1, INVERSE)
    grams = mix((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    at = least_in_window(grams, width - gram + 1)
    whole = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= width)
    whole[offsets[long]] += 1
    whole[offsets[long + 1] - width + 1] -= 1
    start = np.flatnonzero(np.cumsum(whole[:-1], dtype=np.int8)[: len(at)])
    if not len(start):
        return none
    at = at[start]
    text = np.searchsorted(offsets, start, "right") - 1
    cut = np.flatnonzero((at[1:] != at[:-1]) | (text[1:] != text[:-1])) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(start)] - 1
    begin, end, place = start[first], start[last] + width, at[first]
    raw = data.tobytes()
    kinds = (xxhash.xxh3_64_intdigest(raw[b:e], p) for b, e, p in zip(begin.tolist(), end.tolist(), (place - begin).tolist(), strict=True))
    kind = np.fromiter(kinds, np.uint64, len(begin))
    return {"text": text[first], "begin": begin, "end": end, "gram": grams[place].view(np.int64), "kind": kind.view(np.int64), "place": place}


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Keys of 96 bits over id and text: rows that share them are equal in both."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = F.col(f"`{id_col}`").cast("string")
    return docs.select(F.xxhash64(own, text).alias("k1"), F.hash(text, own).alias("k2"), text.alias("text"))


ANCHOR = "k1 long, k2 int, begin int, size short, place short, gram long, kind long"


def _anchor_rows(keyed: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, texts = b.column(0), b.column(1), b.column(2)
            data, offsets = text_buffers(texts)
            for s, e in steps(np.diff(offsets), STEP):
                low, high = int(offsets[s]), int(offsets[e])
                # a text longer than a step goes through in pieces that overlap by all but one byte of a window
                for at in range(low, max(high - width + 1, low + 1), STEP if e == s + 1 else max(1, high - low)):
                    stop = min(high, at + STEP + width - 1) if e == s + 1 else high
                    own = np.array([0, stop - at]) if e == s + 1 else offsets[s : e + 1] - low
                    got = anchors(data[at:stop], own, width, gram)
                    if len(got["text"]):
                        base = (offsets[s + got["text"]] - at).astype(np.int64)
                        rows = pa.array(s + got["text"])
                        yield pa.RecordBatch.from_arrays(
                            [
                                k1.take(rows), k2.take(rows), pa.array((got["begin"] - base).astype(np.int32)), pa.array((got["end"] - got["begin"]).astype(np.int16)),
                                pa.array((got["place"] - got["begin"]).astype(np.int16)), pa.array(got["gram"]), pa.array(got["kind"]),
                            ],
                            names=["k1", "k2", "begin", "size", "place", "gram", "kind"],
                        )

    return keyed.mapInArrow(run, ANCHOR)


def repeated_windows(flat: np.ndarray, start: np.ndarray, digit: np.ndarray, width: int) -> np.ndarray:
    """Which of the windows flat[start:start+width] equal another of the same first digit: passes of 8 bytes, most significant first."""
    live = np.arange(len(start))
    group = np.unique(digit, return_inverse=True)[1].ravel()
    at = 0
    while True:
        order = np.argsort(group, kind="stable")
        live, group = live[order], group[order]
        edge = np.r_[True, group[1:] != group[:-1], True]
        alone = edge[:-1] & edge[1:]
        live, group = live[~alone], group[~alone]
        if not len(live) or at >= width:
            break
        n = min(8, width - at)
        value = np.zeros(len(live), np.uint64)
        for k in range(n):
            value = value << np.uint64(8) | flat[start[live] + at + k].astype(np.uint64)
        order = np.lexsort((value, group))
        live, group, value = live[order], group[order], value[order]
        group = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])])
        at += n
    out = np.zeros(len(start), bool)
    out[live] = True
    return out


def _runs(rep: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of flags in consecutive parts (first, size): the part, and begin and end (within it) of each run of True."""
    offsets = np.r_[first, first[-1] + size[-1]] if len(first) else np.zeros(1, np.int64)
    inside = rep.copy()
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[first] = inside[first]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[offsets[1:] - 1] = inside[offsets[1:] - 1]
    b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    part = np.searchsorted(offsets, b, "right") - 1
    return part, b - first[part], e - first[part]


#: A slice of a stretch: its group, whose stretch it is, where it begins there, the anchor's place in it, the range of bytes before the anchor that its windows have, and whether all of it is known to repeat.
SLICE = "group long, gram long, kind long, at short, place short, low short, high short, done boolean, bytes binary"
SLICE_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int16(), pa.int16(), pa.bool_(), pa.binary())
NAMES = [f.split()[0] for f in SLICE.split(", ")]


def _sorted_slices(width: int):
    """Over slices that lie by group: (gram, kind, low, high), the runs of repeated windows of each that isn't done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            groups, grams, kinds, at, place = (t.column(c).to_numpy() for c in NAMES[:5])
            known = t.column("done").to_numpy()
            whole = t.column("bytes").combine_chunks().cast(pa.large_binary())
            off = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
            flat = np.frombuffer(whole.buffers()[2], np.uint8)
            cut = np.r_[0, np.flatnonzero(groups[1:] != groups[:-1]) + 1, len(groups)]
            # several groups at a time, so that the arrays of a step stay near STEP bytes
            for a, b in steps(off[cut[1:]] - off[cut[:-1]], STEP // 8):
                r = slice(cut[a], cut[b])
                size = off[r.start + 1 : r.stop + 1] - off[r] - width + 1
                first = np.cumsum(size) - size
                row = np.repeat(np.arange(len(size)), size)
                within = np.arange(len(row)) - first[row]
                before = place[r].astype(np.int64)[row] - within  # bytes before the anchor
                number = np.cumsum(np.r_[0, groups[r][1:] != groups[r][:-1]])[row]
                rep = repeated_windows(flat, off[r][row] + within, number * (width + 1) + before, width)
                part, low, high = _runs(rep, first, size)
                new = ~known[r][part]
                part, low, high = part[new], low[new] + at[r][part[new]], high[new] + at[r][part[new]]
                yield pa.RecordBatch.from_arrays([pa.array(grams[r][part]), pa.array(kinds[r][part]), pa.array(low.astype(np.int16)), pa.array(high.astype(np.int16))], names=["gram", "kind", "low", "high"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch])
            groups = t.column("group").to_numpy()
            cut = int(np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])[-1])  # the last group may go on
            if cut:
                yield from done(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    return run


def _halved(width: int):
    """Each slice in two, by how many bytes its windows have before the anchor; all windows of a half share its core, the digit of the next pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                rows = []
                for group, gram, kind, at, place, low, high, done, raw in zip(*(b.slice(s, 1000).column(c).to_pylist() for c in NAMES), strict=True):
                    middle = (low + high) // 2
                    for least, most in ((low, middle), (middle, high)):
                        first, last = max(0, place - most + 1), min(len(raw) - width, place - least)
                        if least < most and first <= last:
                            core = raw[place - least : place - most + 1 + width]
                            digit = xxhash.xxh3_64_intdigest(core, (group + least * 0x9E3779B1 + most) & (1 << 64) - 1)
                            rows.append((digit - (1 << 64) if digit >> 63 else digit, gram, kind, at + first, place - first, least, most, done, raw[first : last + width]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(NAMES), SLICE_TYPES, strict=True)], names=NAMES)

    return run


def _fetch(depth: int):
    """From rows (text, wanted): the slices of the wanted stretches, one of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[tuple[int, int], tuple] = {}
            for text, wanted in zip(b.column("text"), b.column("wanted").to_pylist(), strict=True):
                raw = text.as_py().encode()
                for w in wanted:
                    out.setdefault((w["gram"], w["kind"]), (w["gram"], w["gram"], w["kind"], 0, w["place"], 0, depth, w["n"] > 1, raw[w["begin"] : w["begin"] + w["size"]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out.values(), strict=True) if out else [[]] * len(NAMES), SLICE_TYPES, strict=True)], names=NAMES)

    return run


def _repeated_runs(slices: DataFrame, width: int) -> DataFrame:
    """Of slices in groups: (gram, kind, low, high), runs of windows that repeat in their group. Groups of more than KINDS are dealt by their next digit, until none is left."""
    found = None
    while True:
        sizes = written(slices.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("done")).alias("open")).where("n > 1 AND open > 0"))
        few = slices.join(sizes.where(F.col("n") <= KINDS).select("group"), "group", "left_semi").select(NAMES)
        runs = few.repartition("group").sortWithinPartitions("group").mapInArrow(_sorted_slices(width), "gram long, kind long, low short, high short")
        found = runs if found is None else found.union(runs)
        large = sizes.where(F.col("n") > KINDS).select("group")
        if large.isEmpty():
            return found
        dealt = written(slices.join(large, "group", "left_semi").select(NAMES).mapInArrow(_halved(width), SLICE))
        same = ["group", "low", "high", "place", "bytes"]
        # equal slices repeat whole, and one of them stands for all in what follows; a last range is one window, so that equal ones are all there is
        content = written(dealt.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("gram", "kind", "at")).alias("own"), F.max("done").alias("seen")))
        whole = dealt.where("NOT done").join(content.where("n > 1").select(same), same).select("gram", "kind", F.col("at").alias("low"), (F.col("at") + F.length("bytes") - (width - 1)).cast("short").alias("high"))
        found = found.union(whole)
        slices = content.select("group", "own.gram", "own.kind", "own.at", "place", "low", "high", (F.col("seen") | (F.col("n") > 1)).alias("done"), "bytes")


def repeated_spans(keyed: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """From (k1, k2, text): a row (k1, k2, spans) for each text with repeated bytes; spans may touch and overlap."""
    path = shared_dir(keyed.sparkSession)
    rows = written(_anchor_rows(keyed, width, gram), path)
    again = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high")).where("n > 1").select(F.col("gram").alias("g"), (F.col("low") == F.col("high")).alias("single"))
    # a table: the join then shuffles both sides itself, and adaptive execution can split a gram that is everywhere
    met = written(rows.join(written(again), F.col("gram") == F.col("g")).drop("g"))
    drop_written(keyed.sparkSession, path)

    kinds = written(met.where("NOT single").groupBy("gram", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("k1").alias("own")))
    same = (F.col("gram") == F.col("g")) & (F.col("kind") == F.col("k"))
    wanted = met.where("NOT single").join(kinds.select(F.col("gram").alias("g"), F.col("kind").alias("k"), "n", "own"), same & (F.col("k1") == F.col("own")))
    fields = F.struct(*[F.col(c).cast("long").alias(c) for c in ("begin", "size", "place", "gram", "kind", "n")])
    # sets: rows that repeat in id and text share their key, and add nothing to the group
    wanted = wanted.groupBy(F.col("k1").alias("w1"), F.col("k2").alias("w2")).agg(F.collect_set(fields).alias("wanted"))
    fetched = written(keyed.join(wanted, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))).select("text", "wanted").mapInArrow(_fetch(width - gram + 1), SLICE))
    # rows that repeat in id and text fetch the same stretches: one of each is enough, and only kinds that repeat have several
    slices = fetched.where("NOT done").union(fetched.where("done").dropDuplicates(["gram", "kind"]))

    part = written(_repeated_runs(slices, width).groupBy(F.col("gram").alias("g"), F.col("kind").alias("k")).agg(F.collect_list(F.struct("low", "high")).alias("runs")))
    whole = kinds.where("n > 1").select(F.col("gram").alias("g"), F.col("kind").alias("k"))
    begin = F.col("begin").cast("long")
    full = F.struct(begin.alias("b"), (begin + F.col("size")).alias("e"))
    spans = met.where("single").select("k1", "k2", full.alias("span"))
    spans = spans.union(met.where("NOT single").join(whole, same, "left_semi").select("k1", "k2", full.alias("span")))
    partly = met.where("NOT single").join(part, same).select("k1", "k2", "begin", F.explode("runs").alias("r"))
    spans = spans.union(partly.select("k1", "k2", F.struct((begin + F.col("r.low")).alias("b"), (begin + F.col("r.high") - 1 + width).alias("e")).alias("span")))
    return spans.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in spans:
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the characters that they cover in part."""
    out = []
    for b, e in spans:
        while b < e and raw[b] & 0xC0 == 0x80:
            b += 1
        while e > b and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if b < e:
            out.append((b, e))
    return out


def _cut(text_col: str | None):
    """Over rows (row or doc id, text, spans). text_col None: figures of the bytes; else the text that whole characters leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lists = b.column("text"), b.column("spans")
            flat = lists.flatten()
            begin, end = (x.to_numpy(zero_copy_only=False) for x in flat.flatten()) if len(flat) else (np.zeros(0), np.zeros(0))
            size = np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            at = np.cumsum(size) - size
            out: list[list] = [[], [], [], []]
            for k, text in enumerate(texts):
                raw = (text.as_py() or "").encode()
                spans = _merged(sorted(zip(begin[at[k] : at[k] + size[k]].tolist(), end[at[k] : at[k] + size[k]].tolist(), strict=True))) if size[k] else []
                if text_col:
                    spans = whole_characters(raw, spans)
                kept = b"".join(raw[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(x for x, _ in spans), len(raw)], strict=True)) if spans else raw
                if text_col:
                    out[0].append(kept.decode())
                else:
                    for column, v in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()), strict=True):
                        column.append(v)
            if text_col:
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out[0], pa.string())], names=["row", "text"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _joined(docs: DataFrame, id_col: str, text_col: str, width: int, first: str) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col)
    spans = written(repeated_spans(keyed, width).withColumnsRenamed({"k1": "s1", "k2": "s2"}))
    rows = with_row(docs).select("row", F.col(f"row.`{id_col}`").alias("id"), F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")).alias("text"))
    own = F.col("id").cast("string")
    rows = rows.select(first, "text", F.xxhash64(own, "text").alias("k1"), F.hash("text", own).alias("k2"))
    return rows.join(spans, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left").select(first, "text", "spans")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """A row a document: its id, n_bytes, n_removed, n_spans and kept_sha256, the digest of the bytes that stay."""
    joined = _joined(docs, id_col, text_col, width, "id")
    schema = T.StructType([joined.schema["id"], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string")])
    return joined.mapInArrow(_cut(None), schema).withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with the repeated bytes taken out of their texts; a character that is covered in part stays. Null texts become empty."""
    joined = _joined(docs, id_col, text_col, width, "row")
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType())])
    got = joined.mapInArrow(_cut(text_col), schema)
    return got.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents").select("doc_id", "text"))
