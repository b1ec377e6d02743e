"""Readers: Parquet, CSV, JSON exports and archives of them, with chunk ids from paths."""

from __future__ import annotations

import io
import itertools
import json
import re
import struct
import tarfile
import urllib.parse
import zipfile
from collections.abc import Iterator
from typing import IO

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, paths: str | list[str], columns: T.StructType | None = None, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """With `columns`, exactly those: what files lack is null, what they have more is not read."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    paths = [paths] if isinstance(paths, str) else paths
    return reader.schema(columns).parquet(*paths) if columns else reader.option("mergeSchema", True).parquet(*paths)


def read_csv(spark: SparkSession, paths: str | list[str], sep: str = ",", schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep)
    return reader.schema(schema).csv(paths) if schema else reader.option("inferSchema", True).csv(paths)


def read_json(spark: SparkSession, paths: str | list[str], array: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """A document a line (also gzipped), or with `array` whole-file arrays of documents."""
    reader = spark.read.option("multiLine", array)
    return (reader.schema(schema) if schema else reader).json(paths)


#: Lines, and characters of them, that a task hands on at a time.
BATCH_LINES, BATCH_CHARS = 10_000, 8 << 20
#: Bytes, or characters, that are read at a time.
READ_SIZE = 1 << 20
MEMBERS = "path string, member string, start long, packed long, size long, crc long, method int"
LINES = "path string, member string, line_no long, line string"
#: Schemes of stores that pyarrow opens.
OPENED = ("file", "hdfs", "s3", "s3a", "s3n", "gs", "abfs", "abfss")
BLANKS = re.compile(r"[ \t\r\n]*")
NO_BREAKS = {10: " ", 13: " "}


def _opened(path: str) -> IO[bytes]:
    """A file of any store that pyarrow knows, read in ranges of READ_SIZE; the path is as Spark gives it, without escapes."""
    uri = urllib.parse.quote(path, safe=":/@")
    uri = re.sub("^file:/(?!/)", "file:///", re.sub("^s3[an]:", "s3:", uri))
    store, name = fs.FileSystem.from_uri(uri)
    return io.BufferedReader(store.open_input_file(name), READ_SIZE)


def _is_export(name: str) -> bool:
    return name.endswith((".json", ".ndjson"))


def _directory(path: str, file: IO[bytes] | None = None) -> list[tuple]:
    """MEMBERS of an archive: of a .zip its directory's, of others one row without a name, as they can be read from the front only."""
    if not path.endswith(".zip"):
        return [(path, None, 0, 0, 0, 0, 0)]
    with file or _opened(path) as f, zipfile.ZipFile(f) as z:
        found = [m for m in z.infolist() if _is_export(m.filename)]
    if locked := [m.filename for m in found if m.flag_bits & 1]:
        raise ValueError(f"encrypted members of {path}: {locked[:5]}")
    return [(path, m.filename, m.header_offset, m.compress_size, m.file_size, m.CRC, m.compress_type) for m in found]


def _listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in MEMBERS.split(", ")]
    for part in parts:
        for path in part["path"]:
            yield pd.DataFrame(_directory(path), columns=columns)


class _Forward(io.RawIOBase):
    """A file that is asked for its next bytes only."""

    def __init__(self, file: IO[bytes]):
        self.file = file

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.file.read(len(into))
        into[: len(got)] = got
        return len(got)


def _unpacked(file: IO[bytes], member: str | None, start: int, packed: int, size: int, crc: int, method: int) -> Iterator[tuple[str, IO[bytes]]]:
    """Open members, by name: the one at a place of a .zip, or all of an archive that is read from the front."""
    if member is None:
        with tarfile.open(fileobj=file, mode="r|*") as t:
            for m in t:
                if m.isfile() and _is_export(m.name):
                    yield m.name, io.BufferedReader(_Forward(t.extractfile(m)))
                t.members = []  # else it keeps them all
        return
    file.seek(start)
    name, extra = struct.unpack("<26xHH", file.read(30))
    file.seek(start + 30 + name + extra)
    info = zipfile.ZipInfo(member)
    info.compress_type, info.compress_size, info.file_size, info.CRC = method, packed, size, crc
    yield member, zipfile.ZipExtFile(file, "r", info)  # checks the CRC at its end


def _elements(text: IO[str]) -> Iterator[str]:
    """The elements of a JSON array after its bracket, as they are written, a line each; text is read as far as the next one needs."""
    scan = json.JSONDecoder().raw_decode
    held, at, step, first = "", 0, READ_SIZE, True
    while True:
        at = BLANKS.match(held, at).end()
        if first and held.startswith("]", at):
            at += 1
            break
        try:
            end = scan(held, at)[1]
            after = BLANKS.match(held, end).end()
            mark = held[after : after + 1]
        except ValueError:
            mark = ""
        if mark and mark in ",]":  # else a number may go on
            yield held[at:end].translate(NO_BREAKS)
            at, step, first = after + 1, READ_SIZE, False
            if mark == "]":
                break
            continue
        if not (more := text.read(step)):
            raise ValueError(f"no JSON array: {held[at : at + 80]!r}")
        held, at, step = held[at:] + more, 0, 2 * step  # doubled, so that a long element is scanned few times
    rest = held[at:] or text.read(READ_SIZE)
    while rest:
        if rest.strip():
            raise ValueError(f"text after a JSON array: {rest.strip()[:80]!r}")
        rest = text.read(READ_SIZE)


def _documents(raw: IO[bytes]) -> Iterator[str]:
    """A member's documents, a line each: an array's elements, or its lines that aren't blank."""
    text = io.TextIOWrapper(raw, encoding="utf-8-sig", newline=None)
    while (head := text.read(1)) and not head.strip():
        pass
    if head == "[":
        yield from _elements(text)
    elif head:
        for line in itertools.chain([head + text.readline()], text):
            if line.strip():
                yield line.rstrip("\n")


def _batches(path: str, file: IO[bytes], *place) -> Iterator[pd.DataFrame]:
    for member, raw in _unpacked(file, *place):
        held, first, chars = [], 0, 0
        for line in itertools.chain(_documents(raw), [None]):
            if line is None or len(held) == BATCH_LINES or chars > BATCH_CHARS:
                yield pd.DataFrame({"path": path, "member": member, "line_no": np.arange(first, first + len(held)), "line": pd.Series(held, dtype=object)})
                held, first, chars = [], first + len(held), 0
            if line is not None:
                held.append(line)
                chars += len(line)


def _lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for path, member, *place in part.itertuples(index=False):
            with _opened(path) as file:
                yield from _batches(path, file, None if pd.isna(member) else member, *place)


def _lines_of_contents(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for path, content in part[["path", "content"]].itertuples(index=False):
            for _, *place in _directory(path, io.BytesIO(content)):
                yield from _batches(path, io.BytesIO(content), *place)


def archive_lines(spark: SparkSession, paths: str | list[str], tasks: int | None = None) -> DataFrame:
    """(path, member, line_no, line) of .zip, .tar.gz and .tgz archives; no archive or member is held whole.

    Directories of .zip archives are read first, and their members dealt evenly to `tasks` (the session's shuffle
    partitions): each is read by its range of bytes and unpacked as a stream, so one archive is as many tasks as it has
    members. Compressed tar archives have no directory and can be read from the front only, a task each. Elements of
    a JSON array are told one by one, as they are written. A line or an element is held whole.
    From a store that only Spark can open (none of OPENED), archives come as rows of up to 2 GB, a task each.
    """
    files = spark.read.format("binaryFile").load(paths)
    at = spark._jvm.org.apache.hadoop.fs.Path(paths if isinstance(paths, str) else paths[0])
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() not in OPENED:
        return files.select("path", "content").mapInPandas(_lines_of_contents, LINES)
    members = files.select("path")  # without their content
    members = members.mapInPandas(_listed, MEMBERS).repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return members.mapInPandas(_lines, LINES)


def read_archives(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    return archive_lines(spark, paths).select(F.from_json("line", schema).alias("r")).select("r.*")


def chunk_id(pattern: str | None = None, path: Column | None = None) -> Column:
    """The pattern's first match in the file's path (groups joined by `-`), else the file's name."""
    path = F.col("_metadata.file_path") if path is None else path
    name = F.element_at(F.split(path, "/"), -1)
    if not pattern:
        return name
    n = re.compile(pattern).groups
    found = F.regexp_extract(path, pattern, 0) if n == 0 else F.concat_ws("-", *[F.regexp_extract(path, pattern, k) for k in range(1, n + 1)])
    return F.when(path.rlike(pattern), found).otherwise(name)


def discovered(spark: SparkSession, root: str, glob: str, pattern: str | None = None, by_folder: bool = False, fallback: str | None = None) -> DataFrame:
    """Chunks under a root, newest first: chunk_id, n_files, n_bytes, modified, and a fingerprint of path, size and time of its files.

    fallback: the glob to take where no file matches the first one (for JSON exports, `*.json`).
    """
    listed = lambda g: spark.read.format("binaryFile").option("pathGlobFilter", g).option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    files = listed(glob)
    if fallback and files.isEmpty():
        files = listed(fallback)
    own = F.element_at(F.split(F.col("path"), "/"), -2) if by_folder else chunk_id(pattern, F.col("path"))
    marks = F.sort_array(F.collect_list(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))))
    got = files.groupBy(own.alias("chunk_id")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"), F.max("modificationTime").alias("modified"), F.sha2(F.array_join(marks, "\n"), 256).alias("fingerprint"))
    return got.orderBy(F.desc("modified"), F.desc("chunk_id"))


def probe(df: DataFrame, limit: int = 10, chunk: Column | None = None) -> dict:
    """What a transformed source looks like: schema, files, calendar columns, a few rows, and its different chunks (by an expression, else by file name)."""
    calendar = [c for c in df.columns if c in ("Hour", "Day", "Week", "Month", "Quarter", "Year")]
    return {"schema": [(f.name, f.dataType.simpleString()) for f in df.schema], "files": len(df.inputFiles()), "calendar": calendar, "rows": df.limit(limit), "chunks": df.select((chunk_id() if chunk is None else chunk).alias("chunk_id")).distinct()}
