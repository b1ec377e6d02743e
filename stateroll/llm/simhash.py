"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into SEGMENTS = 2 halves. Two fingerprints that differ in 3 bits or fewer differ in at
most one bit of one half. So each distinct fingerprint is a row of two tables (one a half) and probes each table with
its half and all halves one bit away; every pair within reach meets in some bucket of one half's value. To find each
pair once, a fingerprint probes only values that have one bit more than its own half.

A bucket's pairs aren't emitted: a task verifies the complete distances of a bucket's members and returns a spanning
forest of the links (at most one row a member). Buckets of more than BUCKET members are dealt again by the same
method within the half that it doesn't fix (in two quarters, then in two eighths, when 8 free bits are left), so
buckets stay small and none is cut short. Exact copies are one
fingerprint before all this. Components follow from the links by large-star/small-star.

Defined cases: null and empty texts have fingerprint zero, linked like any other; fewer words than a shingle's are one
shingle; repeated rows get equal rows, and one of them stays; a null doc_id takes the component's least id, and is
null where all are; very long texts are counted in blocks of shingles; an empty table gives none; rows are carried as
one struct, so columns of any name stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stateroll.llm.common import column, map_texts, table, with_row, written
from stateroll.llm.components import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Members of a bucket that one task compares with each other.
BUCKET = 1024
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 bits as an unsigned number: a bit is 1 if it is set in over half of the shingles' XXH64."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    begins = np.r_[0, ends[: n - 1] + 1].tolist()
    of = xxhash.xxh64_intdigest
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.fromiter((of(joined[b:e], SEED) for b, e in zip(begins[at : at + BLOCK], last[at : at + BLOCK], strict=True)), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def row_key(own: Column, text: Column) -> Column:
    """128 bits over id (null is one of its own) and text (null is empty), the same for rows that are equal in both."""
    own, text = own.cast("string"), F.coalesce(text.cast("string"), F.lit(""))
    return F.struct(F.xxhash64(own.isNull(), own, text).alias("k1"), F.xxhash64(text, F.lit(SEED), own, own.isNull()).alias("k2"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """A row a document: id, key (see row_key) and fp, the fingerprint's bits as a signed long."""

    def make():
        def run(_, texts: pa.Array) -> dict:
            return {"fp": pa.array(np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64).view(np.int64))}

        return run

    keyed = docs.select(F.struct(column(id_col).alias("id"), row_key(column(id_col), column(text_col)).alias("key")).alias("own"), column(text_col).alias("text"))
    return map_texts(keyed, "own", "text", [T.StructField("fp", T.LongType())], make, keep="id").select("id.id", "id.key", "fp")


def _bits(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a)


def forest(fps: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs within distance join; a pair has one own member (a table row) at least."""
    label = np.arange(len(fps))
    left, right = [], []
    for k in np.flatnonzero(own).tolist():
        near = np.flatnonzero(_bits(fps ^ fps[k]) <= distance)
        new = np.unique(label[near])
        new = new[new != label[k]]
        if len(new):
            _, first = np.unique(label[near], return_index=True)
            ends = near[first]
            ends = ends[label[ends] != label[k]]
            left.append(np.full(len(ends), fps[k]))
            right.append(fps[ends])
            label[np.isin(label, new)] = label[k]
    if not left:
        return fps[:0], fps[:0]
    return np.concatenate(left), np.concatenate(right)


def _forests(distance: int):
    """Over rows (key, own, fp) that lie by key: the links of each key's members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, own, fp = (t.column(c).to_numpy() for c in ("key", "own", "fp"))
            cut = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            a, b = [], []
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if e - s > 1:
                    x, y = forest(fp[s:e].view(np.uint64), own[s:e], distance)
                    a.append(x.view(np.int64))
                    b.append(y.view(np.int64))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch])
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if cut:
                yield from done(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    return run


def _deal(rows: DataFrame, shift: int, width: int) -> DataFrame:
    """Rows (salt, fp) as table rows and probes of both halves of the `width` bits from `shift` on: (key, own, fp, salt, part).

    A probe's key has one more bit set than the fingerprint.
    """
    half = width // 2
    out = None
    for part in (0, 1):
        at = shift + part * half
        value = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << half) - 1))
        flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda bit: value.bitwiseAND(bit) == 0)
        keys = F.concat(F.array(value), F.transform(flips, lambda bit: value.bitwiseOR(bit)))
        one = rows.select("salt", "fp", F.posexplode(keys).alias("k", "value")).select(F.xxhash64("salt", F.lit(part), "value").alias("key"), (F.col("k") == 0).alias("own"), "fp", F.lit(part).alias("part"))
        out = one if out is None else out.union(one)
    return out


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints fps(fp) that join whatever distance joins; a table.

    A key is a 64-bit hash of the bucket, so two buckets may share one by chance: distances are verified in full, so
    that only adds comparisons.
    """
    if distance > 3:
        raise ValueError("two halves with one flipped bit reach a distance of 3")
    rows = fps.select(F.lit(0).cast("long").alias("salt"), "fp").distinct()
    level, found = [(0, 64)], None
    while True:
        dealt = None
        for shift, width in level:
            own = rows if len(level) == 1 else rows.where(F.col("part") == level.index((shift, width)))
            one = _deal(own, shift, width)
            one = one.withColumn("part", F.col("part") + 2 * level.index((shift, width)))
            dealt = one if dealt is None else dealt.union(one)
        sizes = written(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("own_n")).where("n > 1 AND own_n > 0"))
        last = level[0][1] <= 16
        small = sizes if last else sizes.where(F.col("n") <= BUCKET)
        near = dealt.join(small.select("key"), "key", "left_semi").repartition("key").sortWithinPartitions("key").select("key", "own", "fp")
        here = written(near.mapInArrow(_forests(distance), "a long, b long"))
        found = here if found is None else found.union(here)
        large = sizes.where(F.col("n") > BUCKET)
        if last or large.isEmpty():
            return found
        # the bits that a bucket's key doesn't hold: the other part of what was cut
        level = [(s + (0 if p else w // 2), w // 2) for s, w in level for p in (0, 1)]
        rows = written(dealt.join(large.select("key"), "key", "left_semi").select(F.col("key").alias("salt"), "fp", "part"))


def _rooted(docs: DataFrame, id_col: str, text_col: str, distance: int) -> tuple[DataFrame, DataFrame]:
    """fingerprints(docs), as a table; and of each distinct fp its component's root, which is an fp too."""
    prints = written(fingerprints(docs, id_col, text_col))
    distinct = prints.select("fp").distinct()
    roots = components(links(distinct, distance))
    return prints, written(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """A row a document: its id, fp, and component, the least id that links reach from it (itself included)."""
    prints, roots = _rooted(docs, id_col, text_col, distance)
    least = prints.groupBy("fp").agg(F.min("id").alias("least")).join(roots, "fp")
    of = least.groupBy("root").agg(F.min("least").alias("component"))
    named = written(least.join(of, "root").select("fp", "component"))
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of docs of each group, as it is: that with the least id (null last), and of equal ids any one."""
    prints, roots = _rooted(docs, id_col, text_col, distance)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    of_print = prints.groupBy("fp").agg(first)  # copies meet here, before the components do
    kept = of_print.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("kept_key"))
    kept = written(kept.join(prints.groupBy("key").agg(F.count(F.lit(1)).alias("n")), F.col("kept_key") == F.col("key")).select("kept_key", "n"))
    rows = with_row(docs).select("row", row_key(F.col("row")[id_col], F.col("row")[text_col]).alias("key"))
    own = F.col("key") == F.col("kept_key")
    stay = rows.join(kept.where("n = 1"), own, "left_semi").select("row.*")
    again = kept.where("n > 1")
    if again.isEmpty():
        return stay
    return stay.union(rows.join(again, own, "left_semi").dropDuplicates(["key"]).select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
