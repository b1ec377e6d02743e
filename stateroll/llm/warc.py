"""WARC archives with an index: written once, read back by coalesced byte ranges.

Each page is a record of its own gzip member in a .warc.gz archive: a response, or a revisit of the page with the same
payload and the smallest id. Tasks write archives side by side into the shared folder, in the order their rows come
in, and return the index: archive, offset, length, id, URL and digest of each record. The index is a table; an
archive counts only through it, so what a lost or repeated attempt leaves is never read. Readers take any selection of
the index, sort it by archive and offset, and fetch records that lie near each other with one range read.

Payloads aren't shuffled to find copies: digests are grouped (with partial sums on the map side), and only revisits
are joined back to the pages, by id and digest.

Defined cases: null html is an empty payload; null ids are written as such and are never referred to (a group of null
ids only is all responses); repeated rows of the smallest id are all responses; null URLs have no Target-URI; very long payloads are
records like any other (an Arrow batch and a range read of their own); an empty table gives no archive and no record;
of the pages only the three named columns are read, so no other column's name can clash.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stateroll.llm.common import column, file_system, shared_dir, small_batches, table, written

#: Shorter payloads are always written out.
LEAST_BYTES = 100
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Bytes that a range read may skip between two records, and its size at most (a larger record is a range of its own).
GAP, RANGE = 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"

INDEX = "archive string, offset long, length long, id string, url string, digest string"
RECORD = "id string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def urn(page: str | None) -> str:
    return "<urn:page-none:0>" if page is None else f"<urn:page:{quote(page, safe='')}>"


def of_urn(name: str) -> str | None:
    return None if name.startswith("<urn:page-none") else unquote(name[len("<urn:page:") : -1])


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """One record, uncompressed. A revisit has the response's HTTP headers, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of RECORD from one record; payload_digest is computed from a response's payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length")))
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "id": of_urn(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "payload_bytes": size if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
        "refers_to": of_urn(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        out, name, at = None, "", 0
        for b in batches:
            rows: list[tuple] = []
            for page, url, html, digest, refers_to in zip(*(c for c in b.columns), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(name, compression=None)
                body = (html.as_py() or "").encode()
                first = refers_to.as_py()
                raw = record(page.as_py(), url.as_py(), body, digest.as_py(), first, first is not None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = pack.compress(raw) + pack.flush()
                out.write(packed)
                rows.append((name, at, len(packed), page.as_py(), url.as_py(), digest.as_py()))
                at += len(packed)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "offset", "length", "id", "url", "digest"])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write the archives into folder (one that all executors reach), and give their index, a table."""
    small_batches(pages.sparkSession)
    body = F.coalesce(column(body_col).cast("string"), F.lit(""))
    all_ = pages.select(column(id_col).alias("id"), column(url_col).cast("string").alias("url"), body.alias("html"), F.sha2(body.cast("binary"), 256).alias("digest"))
    light = all_.where(F.octet_length("html") >= LEAST_BYTES).select("id", "digest")
    first = light.groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("d", "first")
    again = light.join(written(first), F.col("digest") == F.col("d")).where("id IS NULL OR id <> first").select(F.col("id").alias("again_id"), "d", "first").distinct()
    again = written(again)
    typed = all_.join(again, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("d")), "left")
    rows = typed.select(F.col("id").cast("string").alias("id"), "url", "html", "digest", F.col("first").cast("string").alias("first"))
    return written(rows.mapInArrow(_writer(folder), INDEX))


def ranges(offsets: list[int], lengths: list[int]) -> list[tuple[int, int]]:
    """Of records sorted by offset: from which to which (exclusive) one range read goes."""
    out, at = [], 0
    for k in range(1, len(offsets) + 1):
        if k == len(offsets) or offsets[k] - (offsets[k - 1] + lengths[k - 1]) > GAP or offsets[k] + lengths[k] - offsets[at] > RANGE:
            out.append((at, k))
            at = k
    return out


def _reader(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        kinds = {"id": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.string(), "payload": pa.binary()}
        name, source = None, None
        for b in batches:
            archives, offsets, lengths = (b.column(c).to_pylist() for c in ("archive", "offset", "length"))
            cuts = [0, *(k for k in range(1, len(archives)) if archives[k] != archives[k - 1]), len(archives)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if archives[s] != name:
                    name = archives[s]
                    source = store.open_input_file(name)
                for x, y in ranges(offsets[s:e], lengths[s:e]):
                    low = offsets[s + x]
                    raw = source.read_at(offsets[s + y - 1] + lengths[s + y - 1] - low, low)
                    got = [parse(zlib.decompress(raw[offsets[k] - low : offsets[k] - low + lengths[k]], 31)) for k in range(s + x, s + y)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] if payloads or c != "payload" else None for r in got], k) for c, k in kinds.items()], names=list(kinds))

    return run


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that index (or any selection of its rows) names: id, record_type, payload_bytes, payload_digest, refers_to, payload."""
    n = max(1, index.select("archive").distinct().count())  # a task an archive: the index is far smaller than what it points to
    return index.select("archive", "offset", "length").repartition(n, "archive").sortWithinPartitions("archive", "offset").mapInArrow(_reader(folder, payloads), RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    pages = table(spark, sf_dir, "pages")
    index = write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    got = read_records(index, folder, payloads=False)
    return got.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))



SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest, min(page_id) OVER (PARTITION BY sha256(html)) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM d
"""
