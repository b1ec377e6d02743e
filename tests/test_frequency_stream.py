"""Frequencies from a stream and from kept days, against the one-shot rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stateroll.operators.frequency import FrequencyResponse
from stateroll.sources import sinks
from stateroll.streaming import frequency as S

FR = FrequencyResponse("customer", "interaction", "action", "placement", "rank", "outcome", "time", ["Clicked"], ["Impression"], ["Pending"], window_hours=48, max_frequency=4, order=["id"], propensity="p", priority="q")
COLUMNS = "id long, customer string, interaction long, action string, placement string, rank int, outcome string, time timestamp, p double, q double"


def rows(n=700, seed=1, days=8):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    out = []
    for k in range(n):
        at = start + dt.timedelta(seconds=rng.choice([rng.randrange(days * 86400), 3600 * rng.randrange(days * 24)]))
        who = rng.choice("abc")
        for rank in (1, 2)[: rng.choice([1, 1, 2])]:
            out.append((len(out), who, k, rng.choice("xy"), "top", rank, rng.choice(["Impression", "Impression", "Clicked", "Pending", "Other"]), at, rng.random(), rng.random()))
            if rng.random() < 0.2:  # the same contact again, somewhat later
                out.append((len(out), *out[-1][1:6], "Clicked", at + dt.timedelta(seconds=rng.randrange(7200)), 0.5, None))
    return out


def one_shot(spark, data):
    contacts = FR.contacts(FR.events(spark.createDataFrame(data, COLUMNS)))
    return sorted((r.customer, r.action, r.interaction, r.s, r.positive, r.frequency) for r in FR.frequencies(contacts).collect())


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def streamed(spark, folder, batches, lag):
    told = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, COLUMNS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(COLUMNS).parquet(f"{folder}/in")

        def write(df, number):
            told.extend((number, *r) for r in df.collect())

        q = S.frequencies_stream(stream, FR, lag).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    return told


@pytest.mark.parametrize("n_batches", [1, 5])
def test_any_split_ends_in_the_one_shot_rows(spark, tmp_path, rocks, n_batches):
    """Rows come in the order of time, but up to a day late."""
    data = sorted(rows(), key=lambda r: r[7] + dt.timedelta(hours=random.Random(r[0]).uniform(0, 20)))
    size = -(-len(data) // n_batches)
    told = streamed(spark, str(tmp_path), [data[a : a + size] for a in range(0, len(data), size)], 24)
    frame = spark.createDataFrame(told, "batch long, customer string, action string, placement string, interaction long, s long, positive boolean, frequency int")
    got = sorted((r.customer, r.action, r.interaction, r.s, r.positive, r.frequency) for r in S.last_told(frame).collect())
    want = one_shot(spark, data)
    assert got == want and len({w[5] for w in want}) == 4
    if n_batches > 1:
        assert len(told) > len(got)  # late rows moved frequencies that had been told


def test_state_is_bounded_by_window_and_lag(spark, tmp_path, rocks):
    """Forty days of an exposure an hour: what is held at the end is the window and the lag of them."""
    start = dt.datetime(2024, 1, 1)
    data = [(k, "a", k, "x", "top", 1, "Impression", start + dt.timedelta(hours=k), 0.5, 0.5) for k in range(40 * 24)]
    streamed(spark, str(tmp_path), [data[:480], data[480:720], data[720:900], data[900:]], 24)
    state = spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "exposures").load()
    assert 48 <= state.count() <= 48 + 24 + 24 + (960 - 900) + 1  # window and lag before the watermark, which is a lag and a batch behind


def test_kept_days_give_the_one_shot_rows(spark, tmp_path):
    data = rows(500, 2)
    path = str(tmp_path / "h")
    chunk = lambda r: r[0] % 3
    frames = {str(k): spark.createDataFrame([r for r in data if chunk(r) == k], COLUMNS) for k in range(3)}
    for name, df in frames.items():
        assert len(S.keep(spark, path, FR, name, "f1", df)) >= 8
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(9)]
    columns = ["customer", "interaction", "action", "rank", "s", "frequency", "clicked", "comparable", "runner_propensity"]
    flat = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    want = FR.responses(spark.createDataFrame(data, COLUMNS))
    assert flat(S.frequencies_of(spark, path, FR, days)) == flat(want)
    some = [dt.date(2024, 1, 4), dt.date(2024, 1, 6)]
    assert flat(S.frequencies_of(spark, path, FR, some)) == flat(want.where(F.col("Day").isin(some))) != []


def test_a_changed_chunk_replaces_its_own_days(spark, tmp_path):
    data = rows(400, 3)
    path = str(tmp_path / "h")
    day = lambda r: str(r[7].date())
    by_day = {d: [r for r in data if day(r) == d] for d in sorted({day(r) for r in data})}
    for name, some in by_day.items():
        S.keep(spark, path, FR, name, "f1", spark.createDataFrame(some, COLUMNS))
    files = {r.file_path for r in sinks.scan_aggregate(spark, path).select("_metadata.file_path").distinct().collect()}
    assert S.keep(spark, path, FR, "2024-01-03", "f1", spark.createDataFrame(by_day["2024-01-03"], COLUMNS)) == []
    expected = spark.createDataFrame([(d, "f2" if d == "2024-01-03" else "f1") for d in by_day] + [("new", "f1")], "chunk_id string, fingerprint string")
    assert sorted(r.chunk_id for r in S.reconcile(spark, path, expected).collect()) == ["2024-01-03", "new"]
    changed = [(*r[:7], r[7] + dt.timedelta(minutes=1), *r[8:]) for r in by_day["2024-01-03"] if r[0] % 2]
    touched = S.keep(spark, path, FR, "2024-01-03", "f2", spark.createDataFrame(changed, COLUMNS))
    assert touched == [dt.date(2024, 1, 3)] or touched == [dt.date(2024, 1, 3), dt.date(2024, 1, 4)]
    now = {r.file_path for r in sinks.scan_aggregate(spark, path).select("_metadata.file_path").distinct().collect()}
    assert all("chunk_id=2024-01-03" in f for f in files ^ now) and files & now
    after = [r for d, some in by_day.items() if d != "2024-01-03" for r in some] + changed
    todo = S.days_to_do(touched, FR)
    assert dt.date(2024, 1, 3) in todo and dt.date(2024, 1, 5) in todo and dt.date(2024, 1, 8) not in todo
    key = lambda df: sorted((r.interaction, r.action, r.s, r.frequency, r.clicked) for r in df.collect())
    want = FR.responses(spark.createDataFrame(after, COLUMNS))
    assert key(S.frequencies_of(spark, path, FR, todo)) == key(want.where(F.col("Day").isin(todo)))
    # days that aren't to be done have the rows they had
    had = FR.responses(spark.createDataFrame(data, COLUMNS))
    other = ~F.col("Day").isin(todo)
    assert key(want.where(other)) == key(had.where(other))


def test_a_key_is_one_read_and_one_write_of_the_store():
    from pyspark.sql import Row

    calls, kept = [], []

    class Store:
        def get(self):
            calls.append("get")
            return iter(list(kept))

        def put(self, values):
            calls.append("put")
            kept[:] = values

    class Handle:
        def getListState(self, *_):
            return Store()

        def registerTimer(self, at):
            calls.append(at)

        def deleteTimer(self, at):
            calls.append(-at)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    one = S._Exposures(3600, 7200, 5, "long")
    one.init(Handle())
    give = lambda a, b: list(one.handleInputRows(("a", "x", "top"), iter([Row(interaction=k, s=k * 600, exposed=True, positive=False) for k in range(a, b)]), Times()))
    assert [t.frequency for t in give(0, 100)] == [1, 2, 3, 4] + [5] * 96
    assert calls == ["get", "put", (99 * 600 + 10800) * 1000] and len(kept) == 100
    assert give(50, 60) == [] and calls[3:] == ["get"]
    assert len(give(100, 101)) == 1 and calls[4:] == ["get", "put", -(99 * 600 + 10800) * 1000, (100 * 600 + 10800) * 1000]
