"""Golden values and properties of the operators, on small frames."""

import datetime as dt
import io
import json
import math
import tarfile
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stateroll.functions import exprs, stats
from stateroll.operators import frequency, metrics, profile, rfm, shape, transforms
from stateroll.operators import processors as P
from stateroll.operators import query as Q
from stateroll.operators import states as S
from stateroll.operators.states import State
from stateroll.plans import registry
from stateroll.sources import readers, sinks
from stateroll.streaming import incremental


def test_pooled_variance_golden(spark):
    df = spark.createDataFrame([("a", 2, 1.5, 0.5), ("a", 2, 3.5, 0.5), ("b", 1, 9.0, None)], "k string, n long, mean double, var double")
    states = [State("n", "count", "x"), State("mean", "pooled_mean", "x", weight="n"), State("var", "pooled_variance", "x", mean="mean", weight="n")]
    got = {r.k: r for r in S.merge(df, ["k"], states).collect()}
    assert got["a"].n == 4 and got["a"]["mean"] == 2.5 and math.isclose(got["a"]["var"], 5 / 3)
    assert got["b"]["var"] is None


EXACT = [State("n", "count"), State("k", "count", "x"), State("s", "value_sum", "x"), State("lo", "min", "x"), State("hi", "max", "x"), State("m", "pooled_mean", "x", weight="k"), State("v", "pooled_variance", "x", mean="m", weight="k")]


@pytest.mark.parametrize("seed", range(3))
def test_merge_of_parts_equals_whole(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(0, 3)), int(rng.integers(0, 5)), None if rng.random() < 0.2 else float(rng.integers(-50, 50))) for _ in range(200)]
    df = spark.createDataFrame(rows, "g int, part int, x double")
    whole = {r.g: r for r in S.build(df, ["g"], EXACT).collect()}
    for r in S.merge(S.build(df, ["g", "part"], EXACT), ["g"], EXACT).collect():
        for name in ("n", "k", "s", "lo", "hi", "m", "v"):
            a, b = r[name], whole[r.g][name]
            assert (a is None and b is None) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_two_arm_goldens(spark):
    df = spark.createDataFrame([("Test", 30, 70), ("Control", 20, 80)], "v string, Positives long, Negatives long")
    r = metrics.variant_compare(df, [], "v", "Test", "Control").first()
    assert math.isclose(r.Lift, 0.5, abs_tol=1e-9) and math.isclose(r.Lift_CI_Low, -0.0840392, abs_tol=1e-6) and math.isclose(r.Lift_CI_High, 1.4564369, abs_tol=1e-6)
    assert math.isclose(r.AbsoluteRateDifference_CI_Low, -0.0698803, abs_tol=1e-6) and math.isclose(r.AbsoluteRateDifference_CI_High, 0.2624816, abs_tol=1e-6)
    assert math.isclose(r.Lift_Z_Score, 1.632993, abs_tol=1e-6) and math.isclose(r.Lift_P_Val, 0.10247, abs_tol=1e-5)
    k = metrics.contingency_test(df, [], "v").first()
    assert math.isclose(k.chi2, 2.666667, abs_tol=1e-6) and math.isclose(k.g_stat, 2.680713, abs_tol=1e-6)
    assert math.isclose(max(k.odds_ratio, 1 / k.odds_ratio), 1.714286, abs_tol=1e-6) and math.isclose(k.chi2_p, 0.10247, abs_tol=1e-5)
    none = spark.createDataFrame([("Test", 3, 7), ("Control", 0, 100)], "v string, Positives long, Negatives long")
    z = metrics.variant_compare(none, [], "v", "Test", "Control").first()
    assert (z.Lift, z.Lift_CI_Low, z.Lift_CI_High, z.Lift_Z_Score, z.Lift_P_Val) == (0, 0, 0, 0, 0)
    alone = metrics.variant_compare(df.where("v = 'Test'"), [], "v", "Test", "Control").first()
    assert alone.TestCTR is None


def test_chi2_tail():
    for x, dof, want in ((3.841458821, 1, 0.05), (5.991464547, 2, 0.05), (0.5, 4, 0.9735009788), (30.0, 10, 0.0008566412)):
        assert math.isclose(stats.chi2_tail(x, dof), want, rel_tol=1e-6)


def test_frequency_window_cap_and_runner(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("c", f"i{k}", "a", "p", 1, "Impression", at(24 * k), 0.5, 1.0) for k in range(9)]
    rows += [("c", "i3", "b", "p", 2, "Pending", at(72), 0.25, 2.0), ("c", "i3", "d", "p", 3, "Pending", at(72), 0.9, 9.0), ("c", "i5", "a", "p", 1, "Clicked", at(121), 0.7, 1.0), (None, "x", "a", "p", 1, "Impression", at(1), 0.1, 1.0)]
    df = spark.createDataFrame(rows, "cu string, i string, a string, p string, r int, o string, t timestamp, pr double, pi double")
    make = lambda **kw: frequency.FrequencyResponse("cu", "i", "a", "p", "r", "o", "t", ["Clicked"], ["Impression"], ["Pending"], "pr", "pi", **kw)
    got = {r.interaction: r for r in make().responses(df).collect()}
    assert [got[f"i{k}"].frequency for k in range(9)] == [1, 2, 3, 4, 5, 6, 7, 7, 7]  # exactly 168 h old: outside
    assert got["i5"].clicked and got["i3"].comparable and got["i3"].runner_propensity == 0.25 and not got["i4"].runner_available
    daily = {r.interaction: r.frequency for r in make().responses(df, daily=True).collect()}
    assert daily == {k: r.frequency for k, r in got.items()}
    seen = frequency.with_history(df.where(F.col("t") >= at(96)), df.where(F.col("t") < at(96)))
    assert {r.interaction: r.frequency for r in make().responses(seen).collect()} == {f"i{k}": min(k + 1, 7) for k in range(4, 9)}


@pytest.mark.parametrize("width", [None, 1, 10])
def test_asof_join_by_bucket(spark, width):
    rng = np.random.default_rng(5)
    left = [(n, None if k == 9 else int(k), int(at)) for n, (k, at) in enumerate(zip(rng.choice([0, 0, 0, 1, 2, 9], 200), rng.integers(0, 60, 200), strict=True))]
    right = {(int(k), int(at)): None if v < 2 else int(v) for k, at, v in zip(rng.choice([0, 1], 25), rng.integers(5, 60, 25), rng.integers(0, 9, 25), strict=True)}
    l, r = spark.createDataFrame(left, "n int, k int, at int"), spark.createDataFrame([(*k, v) for k, v in right.items()], "k int, at int, v int")
    bucket = None if width is None else F.floor(F.col("at") / width)
    got = {x.n: x.v for x in frequency.asof_join(l, r, ["k"], "at", ["v"], bucket).collect()}
    last = lambda k, at: max(((t, right[g, t]) for g, t in right if g == k and t <= at), default=(0, None), key=lambda x: x[0])[1]
    assert got == {n: last(k, at) for n, k, at in left}


def test_rfm_duplicate_cuts_take_the_lowest_label(spark):
    df = spark.createDataFrame([(k, 1 if k < 4 else 6, 10.0, dt.date(2024, 1, 1), dt.date(2024, 1, 1 + k)) for k in range(5)], "k int, unique_holdings long, lifetime_value double, MinPurchasedDate date, MaxPurchasedDate date")
    got = {r.k: r for r in rfm.lifecycle_summary(df).collect()}
    assert got[0].f_quartile == "1" and got[4].f_quartile == "4" and got[0].monetary_value == 0.0
    assert got[4].recency == 0 and got[0].recency == 4 and got[0].r_quartile == "1"
    with pytest.raises(ValueError):
        rfm.segments(df, "other")


def test_names_and_patterns():
    assert transforms.capitalized(["pyname", "pxoutcometime", "customerid", "name"]) == ["Pyname".replace("Pyname", "PyName"), "OutcomeTime", "CustomerID", "Name"]
    assert exprs.pattern("%Y%m%dT%H%M%S.%3f %Z") == "yyyyMMdd'T'HHmmss.SSS z"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("2.json", json.dumps([{"a": 3}, {"a": 4}]))
        z.writestr("1.ndjson", '{"a": 1}\n\n{"a": 2}\n')
        z.writestr("skip.txt", "no")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        raw = b'{"a": 5}\n'
        info = tarfile.TarInfo("x.json")
        info.size = len(raw)
        t.addfile(info, io.BytesIO(raw))
    assert sorted(r.a for r in readers.read_archives(spark, f"{tmp_path}/*", "a int").collect()) == [1, 2, 3, 4, 5]
    assert [r.line_no for r in readers.archive_lines(spark, f"{tmp_path}/b.zip").where("member = '1.ndjson'").collect()] == [0, 1]
    found = readers.discovered(spark, str(tmp_path), "*.zip", r"b")
    assert [(r.chunk_id, r.n_files) for r in found.collect()] == [("b", 1)]


def test_archive_members_are_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a b%20.zip", "w") as z:
        for k, how in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA) * 2):
            z.writestr(f"{k}.json", json.dumps([{"a": k * 10_000 + i, "s": "x\u2028\n"} for i in range(9_000)], indent=k % 3 or None, ensure_ascii=False), how)
    with tarfile.open(tmp_path / "c.tgz", "w:gz") as t:
        for name, raw in (("d.json", b" \n[]\n"), ("e.ndjson", b"\xef\xbb\xbf" + b'{"a": -1}\n' * 12_000), ("e.ndjson", b'{"a": -2}'), ("f.json", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    longest = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10")  # no archive may become a row
    try:
        lines = readers.archive_lines(spark, f"{tmp_path}/*").withColumn("task", F.spark_partition_id()).cache()
        assert lines.where("path LIKE '%zip'").select("task").distinct().count() == 4
        assert lines.select("path", "member", "line_no").where("path LIKE '%zip'").distinct().count() == 72_000
        rows = lines.select(F.from_json("line", "a int, s string").alias("r")).select("r.*")
        assert rows.where("a >= 0").agg(F.sum("a"), F.count_distinct("a"), F.min("s"), F.max("s")).first()[:] == (sum(k * 10_000 + i for k in range(8) for i in range(9_000)), 72_000, "x\u2028\n", "x\u2028\n")
        assert rows.where("a < 0").groupBy("a").count().orderBy("a").collect() == [(-2, 1), (-1, 12_000)]
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", longest)
    other = f"viewfs://other{tmp_path}"  # a store that only Spark opens
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.other.link./" + tmp_path.parts[1], f"file:///{tmp_path.parts[1]}")
    same = readers.archive_lines(spark, f"{other}/*").select("member", "line_no", "line")
    assert same.exceptAll(lines.select(same.columns)).isEmpty() and same.count() == lines.count() == 84_001
    lines.unpersist()


def test_array_elements_in_small_reads(monkeypatch):
    values = [12, -1.5e-3, 0, True, None, "a,]\\\"[", [], [1, [2]], {"k": {"l": [3]}}, "\u00e9" * 50, 7]
    for size in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(readers, "READ_SIZE", size)
        for indent in (None, 1):
            text = json.dumps(values, indent=indent, ensure_ascii=False)
            assert [json.loads(x) for x in readers._elements(io.StringIO(text[1:] + " \n"))] == values
        assert list(readers._elements(io.StringIO("1.00000000000000000001 , 12345678901234567890]"))) == ["1.00000000000000000001", "12345678901234567890"]
        assert list(readers._elements(io.StringIO(" ]"))) == []
        for bad in ("1, ", "1,]", "1 2]", "1] 2", "{]", ""):
            with pytest.raises(ValueError):
                list(readers._elements(io.StringIO(bad)))


def test_damaged_archives_fail(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.ndjson", '{"a": 1}\n' * 10)
    raw = (tmp_path / "x.zip").read_bytes()
    (tmp_path / "x.zip").write_bytes(raw.replace(b'{"a": 1}', b'{"a": 2}', 1))
    with pytest.raises(Exception, match="CRC"):
        readers.archive_lines(spark, f"{tmp_path}/x.zip").collect()


def test_sink_refuses_rows_without_period_and_mixed_chunks(spark, tmp_path):
    df = sinks.stamped(spark.createDataFrame([(1, None)], "n int, period string"), "r", "c", "h")
    with pytest.raises(ValueError, match="period"):
        sinks.write_aggregate(df, str(tmp_path / "x"))
    ok = spark.createDataFrame([(1, "2024-01")], "n int, period string")
    mixed = sinks.stamped(ok, "r1", "c", "h").union(sinks.stamped(ok, "r2", "c", "h"))
    with pytest.raises(ValueError, match="several"):
        sinks.write_aggregate(mixed, str(tmp_path / "x"))
    sinks.write_aggregate(sinks.stamped(ok, "r1", "c", "h"), str(tmp_path / "y"))
    sinks.write_aggregate(sinks.stamped(ok.union(ok), "r2", "c", "h"), str(tmp_path / "y"))
    assert sinks.scan_aggregate(spark, str(tmp_path / "y"), "h").count() == 2


def test_attempts_lie_side_by_side_and_one_reduction_a_write(spark, tmp_path):
    path = str(tmp_path / "t")
    seen = spark.sparkContext.accumulator(0)

    def counted(part):
        for x in part:
            seen.add(len(x))
            yield x

    raw = spark.range(200, numPartitions=4).withColumn("period", F.when(F.col("id") < 100, "2024-01").otherwise("2024-02")).mapInPandas(counted, "id long, period string")
    build = lambda df: df.groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    got = sinks.write_aggregate(sinks.stamped(build(raw), "r1", "01", "h", "2024-03-01 00:00:00"), path).collect()
    assert seen.value == 200
    assert {(r.pipeline_run_id, r.chunk_id, r.period, r.n_rows) for r in got} == {("r1", "01", p, 1) for p in ("2024-01", "2024-02")} and all(r.size_bytes > 0 and r.files == 1 for r in got)
    # a second run with one period only: its chunk shows that run alone, and the first stays to fall back on
    again = sinks.write_aggregate(sinks.stamped(build(spark.createDataFrame([(1, "2024-01")], "id long, period string")), "r2", "01", "h", "2024-03-02 00:00:00"), path).collect()
    assert [(r.pipeline_run_id, r.period) for r in again] == [("r2", "2024-01")]
    assert [(r.pipeline_run_id, r.period, r.n) for r in sinks.scan_aggregate(spark, path, "h").collect()] == [("r2", "2024-01", 1)]
    every = sinks.scan_aggregate(spark, path, every_attempt=True)
    assert every.count() == 3
    attempts = spark.createDataFrame([("s", "01", "r1", "ok", "ok", 1), ("s", "01", "r2", "failed", "failed", 2)], "source string, chunk_id string, pipeline_run_id string, status string, run_status string, attempt_at int")
    assert sorted((r.period, r.n) for r in sinks.current_view(every, attempts, "h").collect()) == [("2024-01", 100), ("2024-02", 100)]


def test_rebuild_keeps_the_old_version_on_failure(spark, tmp_path):
    target = str(tmp_path / "target")
    rows = lambda n: spark.createDataFrame([(n, "2024-01")], "n int, period string")
    assert incremental.rebuild(spark, {"a": lambda: rows(1), "b": lambda: rows(2).limit(0)}, target, "r1", "h") == 1

    def broken():
        raise RuntimeError("source is gone")

    with pytest.raises(RuntimeError, match="gone"):
        incremental.rebuild(spark, {"a": lambda: rows(5), "b": broken}, target, "r2", "h")
    assert [(r.n, r.pipeline_run_id) for r in incremental.current(spark, target).collect()] == [(1, "r1")]
    assert incremental.rebuild(spark, {"a": lambda: rows(7), "b": lambda: rows(8)}, target, "r3", "h") == 2
    assert sorted(r.n for r in incremental.current(spark, target).collect()) == [7, 8]


@pytest.mark.parametrize("resolution", [101, 1501])
def test_curves_at_any_resolution(spark, resolution):
    rng = np.random.default_rng(3)
    score, flag = rng.random(4000), rng.random(4000)
    flag = (flag < score).astype(int)
    df = spark.createDataFrame([(float(s), int(f)) for s, f in zip(score, flag, strict=True)] + [(None, 1), (0.5, None), (0.29, 1), (0.29, 0)], "s double, f int")
    at = np.arange(resolution) / (resolution - 1)
    s, f = np.r_[score, 0.29, 0.29], np.r_[flag, 1, 0]
    tpr, fpr = ((s[f == k][None, :] > at[:, None]).mean(1) for k in (1, 0))
    points = sorted(zip(fpr, -tpr, strict=True))  # of equal fall-outs the greatest hit rate first
    want = sum((b[0] - a[0]) * -b[1] for a, b in zip(points[:-1], points[1:], strict=True))
    got = metrics.exact_curve(df, [], "s", "f", resolution).first().curve
    assert math.isclose(got.roc_auc, want, abs_tol=1e-9) and np.allclose(sorted(got.tpr), sorted(tpr))
    built = S.build(df, [], [State("p", "tdigest", "s", "f = 1"), State("n", "tdigest", "s", "f = 0")])
    near = metrics.curve_from_digests(built, "p", "n", resolution).first().curve
    assert abs(near.roc_auc - want) < 0.02 and len(near.tpr) == resolution


def test_slice_begins_at_half_rounded_to_even(spark):
    for n, first in ((50_001, 25_000), (50_003, 25_002)):
        got = P.source_order_slice(spark.range(n), ["id"]).agg(F.min("id"), F.max("id"), F.count("id")).first()
        assert tuple(got) == (first, n - 1, n - first)


def test_downsampling_with_and_without_series(spark):
    # a flat line with a peak in three of its four middle buckets (places 1-5, 6-10, 11-15, 16-20)
    peaks = {3: 9.0, 8: -7.0, 14: 5.0}
    rows = [(s, x, None if x % 4 == 1 and x not in peaks else peaks.get(x, 0.0)) for s in ("a", None) for x in range(22)]
    df = spark.createDataFrame(rows, "s string, x int, y double").repartition(3)
    kept = [0, 3, 8, 14, 16, 21]
    one = shape.downsampled(df.where("s IS NULL"), [], "x", "y", 6)
    assert one.columns == df.columns and sorted(r.x for r in one.collect()) == kept
    two = shape.downsampled(df, ["s"], "x", "y", 12).collect()
    assert sorted(((r.s or ""), r.x) for r in two) == [(s, x) for s in ("", "a") for x in kept]
    assert all(r.y == peaks[r.x] for r in two if r.x in peaks)
    assert shape.downsampled(df, ["s"], "x", "y").count() == 44
    assert shape.downsampled(df.limit(0), ["s"], "x", "y", 6).count() == 0
    days = df.where("s IS NULL").select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("x")).alias("d"), "y")
    assert sorted(r.d.toordinal() - dt.date(2024, 1, 1).toordinal() for r in shape.downsampled(days, [], "d", "y", 6).collect()) == kept


@pytest.fixture
def every_partition(spark):
    """Small partitions stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("size", "buckets", "stretch"), [(100_000, 300, 17), (2_000, 2_000, 44), (60, 7, 1), (60, 7, 100)])
def test_walk_in_stretches_is_the_walk(spark, every_partition, size, buckets, stretch):
    at = np.arange(size)
    b = np.where(at == 0, -1, np.where(at == size - 1, buckets - 2, ((at - 1) * (buckets - 2)) // (size - 2)))
    b = np.minimum(b, buckets - 2)
    for ys in ((at / size) ** 2 * 1e6, np.random.default_rng(size).integers(0, 4, size).astype(float)):
        x, y = at.astype(float), ys
        cut = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), size]
        runs = [(i, j) for i, j in zip(cut, cut[1:])]
        means = [(x[i:j].mean(), y[i:j].mean()) for i, j in runs][1:] + [(0.0, 0.0)]
        kept = [0]
        for (i, j), (mx, my) in list(zip(runs, means))[1:]:
            k = kept[-1]
            kept.append(i + int(np.abs((mx - x[k]) * (y[i:j] - y[k]) - (my - y[k]) * (x[i:j] - x[k])).argmax()))
        mean = np.repeat(np.array(means), [j - i for i, j in runs], axis=0)
        pdf = pd.DataFrame({"_first": 5, "_b": b, "_n": at, "_x": x, "_y": y, "_mx": mean[:, 0], "_my": mean[:, 1]})
        df = spark.createDataFrame(pa.Table.from_pandas(pdf))
        got = shape.walked(df.union(df.withColumn("_first", F.lit(6).cast("long")).withColumn("_n", F.col("_n") + size)), stretch).withColumn("task", F.spark_partition_id()).toPandas()
        assert sorted(got["_n"]) == kept + [k + size for k in kept]
        if size > 10_000:
            assert got[got["_n"] < size]["task"].nunique() > 1


def test_corners_hold_every_extreme():
    rng = np.random.default_rng(6)
    for spread in (3, 1000):
        points = sorted((float(a), float(b)) for a, b in rng.integers(0, spread, (200, 2)))
        x, y = (list(v) for v in zip(*points, strict=True))
        at = shape.corners(x, y)
        assert len(at) < 40
        for u, v, w in rng.integers(-9, 10, (50, 3)).tolist():
            size = [abs(u * a + v * b + w) for a, b in points]
            assert size.index(max(size)) in at


def test_grain_names():
    from stateroll.functions import calendar

    assert [calendar.grain(g) for g in ("all-time", "All time", " day ", "HOURLY", "quarter")] == ["summary", "summary", "daily", "hourly", "quarterly"]
    with pytest.raises(ValueError, match="fortnight"):
        calendar.grain("fortnight")


def test_names_of_identities_and_measures():
    from stateroll.operators import profile

    assert [n for n in ("id", "Key", "customer_id", "order-id", "the id", "PlayerID", "ID", "paid", "customerNumber", "account token", "UserEmail", "uuid", "idea", "number") if profile.is_identity(n)] == ["id", "Key", "customer_id", "order-id", "the id", "PlayerID", "ID", "customerNumber", "account token", "UserEmail", "uuid"]
    assert [n for n in ("OutcomeTime", "response-time-ms", "update", "Propensity", "score_final", "Channel", "rank", "colour") if profile.is_measure_or_time(n)] == ["OutcomeTime", "response-time-ms", "update", "Propensity", "score_final", "rank"]


def test_profile_counts_few_values_exactly_and_estimates_many(spark, monkeypatch):
    from stateroll.operators import profile

    df = spark.range(20_000).select("id", (F.col("id") % 7).alias("few"), F.lit(None).cast("int").alias("none"))
    got = {r.field: r for r in profile.column_profile(df).collect()}
    assert (got["few"].cardinality, got["none"].cardinality, got["none"].null_rate, got["id"].cardinality) == (7, 0, 1.0, 20_000)
    monkeypatch.setattr(profile, "EXACT_LG", 12)
    got = {r.field: r for r in profile.column_profile(df).collect()}
    assert got["few"].cardinality == 7 and 19_000 <= got["id"].cardinality <= 20_000


def test_quantiles_by_key(spark):
    from stateroll.operators import ordering

    rng = np.random.default_rng(8)
    rows = [(k, float(v)) for k in ("a", "b", None) for v in rng.integers(0, 9, 200)] + [("c", 1.5), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: r.quantiles for r in ordering.quantiles(df, "v", [0.1, 0.5, 0.77], ["k"]).collect()}
    assert got.keys() == {"a", "b", None, "c"}
    for k, q in got.items():
        assert np.allclose(q, np.quantile([v for x, v in rows if x == k], [0.1, 0.5, 0.77]))


def test_discovery_falls_back(spark, tmp_path):
    (tmp_path / "x-1.json").write_text("{}")
    assert readers.discovered(spark, str(tmp_path), "*.zip", r"x-(\d)").count() == 0
    assert [r.chunk_id for r in readers.discovered(spark, str(tmp_path), "*.zip", r"x-(\d)", fallback="*.json").collect()] == ["1"]


def test_stream_drops_late_repeats(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 0)), (1, dt.datetime(2024, 1, 1, 1)), (2, dt.datetime(2024, 1, 1, 2))]
    spark.createDataFrame(rows, "k int, t timestamp").write.parquet(str(tmp_path / "in"))
    stream = incremental.late_deduplicated(spark.readStream.schema("k int, t timestamp").parquet(str(tmp_path / "in")), "t", ["k"], "1 day")
    stream.writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("deduped").count() == 2


def test_query_errors(spark):
    df = spark.createDataFrame([(1, "a")], "n int, k string")
    with pytest.raises(ValueError, match="no column"):
        Q.filtered(df, {"x": 1})
    with pytest.raises(ValueError, match="unsupported operator"):
        Q.filtered(df, {"n": {"op": "near", "value": 1}})
    with pytest.raises(ValueError, match="circle"):
        metrics.Catalog({"a": (F.col("b"), ["b"]), "b": (F.col("a"), ["a"])}).order("a")
    with pytest.raises(ValueError):
        P.customer_sample(df, "k", 0.00000015)
    with pytest.raises(KeyError):
        registry.kind("none")


def test_a_choice_of_two_hashes_as_a_case():
    a = {"metric": {"op": "when_then", "cond": {"op": "gt", "a": 1.0}, "then": 2, "else": None}}
    b = {"metric": {"op": "case", "when": [{"then": 2.0, "cond": {"a": 1, "op": "gt"}}]}}
    assert sinks.config_hash(a) == sinks.config_hash(b) != sinks.config_hash({"metric": {**b["metric"], "else": 0}})


@pytest.mark.parametrize("how", ["inner", "left"])
def test_range_join_by_bins(spark, how):
    """One key in half of the rows, points on bins' edges, negative numbers, nulls, and intervals that are longer than the width."""
    rng = np.random.default_rng(7)
    left = [(i, "hot" if i % 2 else f"k{i % 7}", float(x), float(x + w)) for i, (x, w) in enumerate(zip(rng.integers(-60, 60, 300), rng.choice([0, 3, 10, 10, 45], 300), strict=True))]
    right = [(i, "hot" if i % 2 else f"k{i % 7}", float(p)) for i, p in enumerate(rng.integers(-80, 120, 400))]
    left += [(1000, "hot", None, 3.0), (1001, None, 0.0, 9.0), (1002, "hot", 5.0, None)]
    right += [(1000, "hot", None), (1001, None, 4.0)]
    a = spark.createDataFrame(left, "i long, k string, low double, high double")
    b = spark.createDataFrame(right, "j long, k string, p double")
    pairs = lambda w: sorted(((r.i, r.j) for r in frequency.range_join(a, b, ["k"], F.col("low"), F.col("high"), F.col("p"), how, w).collect()), key=str)
    want = [(i, j) for i, k, x, y in left for j, m, p in right if None not in (k, x, y, m, p) and k == m and x <= p <= y]
    if how == "left":
        met = {i for i, _ in want}
        want += [(i, None) for i, *_ in left if i not in met]
    assert pairs(None) == pairs(10) == pairs(0.5) == sorted(want, key=str)
    with pytest.raises(ValueError, match="width"):
        pairs(0)


def test_sizes_of_many_groupings(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "a"), ("a", "a"), (None, None)], "x string, y string")
    got = {r.candidate: (r.current_rows, r.projected_rows) for r in profile.size_previews(df, ["x"], {"y": ["y"], "x again": ["x"], "gone": ["z"]}).collect()}
    assert got == {"y": (2, 4), "x again": (2, 2), "gone": (2, 2)}
    assert profile.size_previews(df.limit(0), [], {"y": ["y"]}).first().projected_rows == 0


def test_configured_values_take_the_columns_type():
    from pyspark.sql import types as T

    whole = [9007199254740993, "9007199254740993", " 12 ", "1e3", 5.0, True, "inf", float("inf"), float("nan"), "1.5", 2.5, "", None, "x", 2**63, -(2**63), "1e999999"]
    assert P.compatible(whole, T.LongType()) == [9007199254740993, 9007199254740993, 12, 1000, 5, 1, -(2**63)]
    assert P.compatible(["Yes", "no ", "TRUE", "0", "maybe", 1.0, 0, True, 2, None], T.BooleanType()) == [True, False, True, False, True, False, True]
    assert P.compatible(["1.5", 2, True, "x", None, "inf"], T.DoubleType()) == [1.5, 2.0, 1.0, float("inf")]
    assert P.compatible([1, True, "a"], T.StringType()) == ["1", "True", "a"]


def test_relative_bounds():
    assert Q.relative_bounds("7d", dt.date(2024, 3, 10), dt.date(2024, 5, 1)) == (dt.date(2024, 3, 4), dt.date(2024, 3, 10))
    assert Q.relative_bounds("ytd", dt.date(2024, 3, 10), dt.date(2024, 2, 1)) == (dt.date(2024, 1, 1), dt.date(2024, 2, 1))


def test_sketches_of_a_million_stay_within_their_error(spark):
    df = spark.range(1_000_000).select("id", (F.col("id") % 1000).cast("double").alias("v"))
    r = S.build(df, [], [State("h", "hll", "id"), State("q", "tdigest", "v")]).select(S.estimate("h").alias("n"), S.quantile("q", 0.5).alias("m")).first()
    assert abs(r.n - 1e6) < 1e6 * 0.05 and abs(r.m - 500) < 20


def test_downsampling_keeps_ends_and_peak(spark):
    x = F.col("id").cast("double")
    got = [r.x for r in shape.downsampled(spark.range(1000).select(x.alias("x"), F.when(x == 500, 100.0).otherwise(F.sin(x / 50)).alias("y")), [], "x", "y", 50).collect()]
    assert len(got) == 50 and min(got) == 0 and max(got) == 999 and 500 in got


def test_personalization_golden(spark):
    same = spark.createDataFrame([("g", "u1", "a"), ("g", "u2", "a")], "g string, u string, a string")
    other = spark.createDataFrame([("g", "u1", "a"), ("g", "u2", "b")], "g string, u string, a string")
    assert abs(P.personalization(same, ["g"], "u", "a").first().personalization) < 1e-12
    assert P.personalization(other, ["g"], "u", "a").first().personalization == 1.0
    assert P.personalization(other.limit(1), ["g"], "u", "a").first().personalization == 0.0


def test_plain_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 3).alias("k"), F.lit("x").alias("wide")).write.parquet(str(tmp_path / "t"))
    df = Q.filtered(spark.read.parquet(str(tmp_path / "t")), {"k": {"op": "eq", "value": 1}}).groupBy("k").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,1)" in plan and "wide" not in plan


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_global_order_without_one_task(spark):
    from stateroll.operators import ordering

    rng = np.random.default_rng(4)
    values = [float(v) for v in rng.integers(0, 20, 500)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(900, None)], "k long, v double")
    order = [F.desc_nulls_last("v"), F.col("k")]
    want = sorted(range(500), key=lambda k: (-values[k], k))
    got = ordering.running(df.where("v IS NOT NULL"), order, "v").orderBy("n").collect()
    assert [r.k for r in got] == want and [r.n for r in got] == list(range(1, 501))
    assert np.allclose([r.running for r in got], np.cumsum([values[k] for k in want]))
    assert [r.k for r in ordering.numbered(df, order).orderBy("n").collect()] == [*want, 900]
    qs = [0.0, 0.25, 0.333, 0.5, 0.9, 1.0]
    assert np.allclose(ordering.quantiles(df, "v", qs).first().quantiles, np.quantile(values, qs))
    assert ordering.quantiles(df.limit(0), "v", [0.5]).first().quantiles == [None]
