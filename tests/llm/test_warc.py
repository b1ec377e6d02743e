import gzip
import hashlib
import os

from pyspark.sql import functions as F

from stateroll.llm import warc as op
from stateroll.llm.queries import QUERIES, SQL
from tests.llm import oracle

LONG = "<p>é\r\n\r\nWARC/1.1</p>" * 10
PAGES = [
    (5, "http://a/ü?q=1 2", LONG), (3, "http://b/\r\nX: y", LONG), (3, "http://b", LONG), (9, None, LONG), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""),
    (None, "n", LONG), (None, "n", LONG + "!"), (None, "n", LONG + "!"), (7, "z", "x" * 99), (8, "z", "x" * 99), (10, "z", "y" * 100), (11, "z", "y" * 100),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")


def want():
    out = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(ids) if ids and len(raw) >= 100 else None
        again = first is not None and page != first
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/archives"
    index = op.write_archives(frame(spark), folder)
    got = op.read_records(index, folder).collect()
    num = lambda x: None if x is None else int(x)
    assert sorted(((num(r.id), r.payload_bytes, r.payload_digest, r.record_type, num(r.refers_to)) for r in got), key=str) == want()
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    one = op.read_records(index.where("id IN ('5', '10', '4')"), folder).collect()
    assert sorted(r.id for r in one) == ["10", "4", "5"]
    names = [f"{tmp_path}/archives/{n}" for n in os.listdir(tmp_path / "archives")]
    raw = [gzip.open(n).read() for n in names]
    assert sum(r.count(b"WARC-Record-ID") for r in raw) == len(PAGES)
    assert all(r.startswith(b"WARC/1.1\r\n") for r in raw)
    for row in index.collect():
        with open(row.archive, "rb") as f:
            f.seek(row.offset)
            assert gzip.decompress(f.read(row.length)).startswith(b"WARC/1.1")


def test_many_archives(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/small"
    index = frame(spark).coalesce(1)
    monkeypatch.setattr(op, "ARCHIVE_BYTES", 1)
    index = op.write_archives(index, folder)
    assert index.select("archive").distinct().count() == len(PAGES)
    assert op.read_records(index, folder, payloads=False).where(F.col("payload").isNull()).count() == len(PAGES)


def test_ranges(monkeypatch):
    monkeypatch.setattr(op, "GAP", 10)
    monkeypatch.setattr(op, "RANGE", 100)
    assert op.ranges([0, 20, 45, 90, 300], [20, 20, 30, 20, 900]) == [(0, 3), (3, 4), (4, 5)]
    assert op.ranges([], []) == []


def test_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert op.read_records(op.write_archives(frame(spark, []), folder), folder).count() == 0


def test_query(spark):
    assert oracle.frame(QUERIES["op6_warc"](spark, oracle.SF)) == oracle.rows(SQL["op6_warc"])
