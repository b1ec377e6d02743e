"""Registered queries against their SQL on tables with what the given small ones lack: more users, parts of seconds, many files."""

import duckdb
import pytest
from test_queries import plain

from stateroll.plans.all_queries import QUERIES, SQL


@pytest.fixture
def against_sql(spark, tmp_path):
    """Writes events of the given SQL (columns by name), and gives a query's rows and its SQL's."""

    def check(name, select):
        con = duckdb.connect()
        con.execute(f"CREATE TABLE events AS {select}")
        con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        df = QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        got = con.execute(SQL[name])
        at = [[d[0] for d in got.description].index(c) for c in columns]
        want = sorted(tuple(plain(r[k]) for k in at) for r in got.fetchall())
        assert want
        assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want

    return check


@pytest.mark.parametrize("name", ["j04_range_join", "j04_range_join_of_a_hot_key"])
def test_seconds_are_rounded_as_in_sql(against_sql, name):
    """Times at halves and other parts of seconds, around a day's end too."""
    against_sql(name, """SELECT i AS event_id, i % 3 AS user_id, CASE WHEN i % 2 = 0 THEN 'view' ELSE 'purchase' END AS event_type, 1.0 :: DOUBLE AS value,
        TIMESTAMP '2024-01-01 23:59:58' + to_microseconds((i % 7) * 86400000000 + (i % 11) * 250000 + (i % 5) * 3600000000) AS ts FROM range(400) AS t(i)""")


@pytest.mark.parametrize("name", ["d12_theta", "d18_cardinality_bounds", "e10_entity_set", "e11_funnel", "g13_set_op", "g14_set_op_windows", "l03_set_algebra_of_sketches", "p03_unique_entities"])
def test_full_sketches_are_counted_exactly(against_sql, name):
    """More users than a sketch holds exactly, of one type and of most days; other types and days have few."""
    against_sql(name, """SELECT i AS event_id, CASE WHEN i % 3 = 0 THEN i % 97 ELSE i % 17001 END AS user_id, ['view', 'purchase', 'error'][1 + ((i % 3 + 2 * (i // 17001)) % 3) :: INT] AS event_type, (i % 501) :: DOUBLE AS value,
        TIMESTAMP '2024-01-01' + to_days((i * 7 % 60001 % 12 // 4 * 4) :: INT) + to_seconds(i % 86400) AS ts FROM range(60000) AS t(i)""")


def test_merged_and_joined_sketches_keep_their_size(spark):
    from stateroll.operators import metrics
    from stateroll.operators import states as S
    from stateroll.operators.states import State

    states = [State("a", "theta", "id", "id < 15000", size=16), State("b", "theta", "id", "id >= 5000", size=16)]
    df = spark.range(20_000).selectExpr("id", "id % 2 AS part")
    one = S.merge(S.build(df, ["part"], states), [], states).select(S.estimate("a", "theta"), metrics.set_op("a", "b", "union", 16), metrics.set_op("a", "b", "intersection", 16)).first()
    assert tuple(one) == (15_000.0, 20_000.0, 10_000.0)


def test_profile_counts_many_values_exactly(against_sql):
    """More values than the profile's sketches hold exactly."""
    against_sql("n01_column_profile", """SELECT i AS event_id, i * 17 % 100003 AS user_id, ['view', 'purchase', 'error'][1 + i % 3] AS event_type, CASE WHEN i % 5 > 0 THEN (i % 70001) / 8 END AS value,
        TIMESTAMP '2024-01-01' AS ts FROM range(120000) AS t(i)""")


def test_a_waiting_table_is_streamed_in_few_batches(against_sql, monkeypatch):
    """Micro-batches don't grow with the table in number, and none lists what was written before it."""
    from stateroll.sources import sinks
    from stateroll.streaming import incremental

    batches, listed, stamp, stored = [], [], incremental.stamped, sinks._stored
    monkeypatch.setattr(incremental, "stamped", lambda df, run, chunk, *more: batches.append(chunk) or stamp(df, run, chunk, *more))
    monkeypatch.setattr(sinks, "_stored", lambda *at: listed.append(at) or stored(*at))
    against_sql("m05_partials_from_stream", """SELECT i AS event_id, i % 1000 AS user_id, ['view', 'purchase', 'error'][1 + i % 3] AS event_type, 1.0 :: DOUBLE AS value,
        TIMESTAMP '2024-01-01' + to_days((i % 20) :: INT) AS ts FROM range(120000) AS t(i)""")
    assert 3 < len(set(batches)) <= 13 and len(listed) == 1


@pytest.mark.parametrize("name", ["g08_calibration_digest", "o13_calibration_rows"])
def test_calibration_of_rare_scores(against_sql, name):
    """Two bins that hold some 44 of 133 000 rows of a group each, at an end of the bin."""
    against_sql(name, """SELECT i AS event_id, i % 3 AS user_id, CASE WHEN i // 9000 % 2 = 1 OR i % 9000 > 2 AND i % 7 < 2 THEN 'click' ELSE 'view' END AS event_type,
        500 * CASE WHEN i % 9000 < 3 THEN 0.664 WHEN i % 9000 < 6 THEN 0.74 ELSE (i % 89) / 150 END AS value, TIMESTAMP '2024-01-01' AS ts FROM range(400000) AS t(i)""")


def test_digests_are_shuffled_as_states(spark):
    """A shuffled row is a key of a task, not one of its values or clusters."""
    from stateroll.operators import states as S
    from stateroll.operators.states import State

    s, sc = [State("q", "tdigest", "v")], spark.sparkContext
    df = spark.range(0, 240_000, 1, 6).selectExpr("id % 3 AS flag", "id % 60 AS day", "CAST(id * 7919 % 240007 AS double) AS v")
    sc.setJobGroup("digests", "")
    try:
        got = S.merge(S.build(df, ["flag", "day"], s), ["flag"], s).select(S.weight("q").alias("n"), *[S.quantile("q", q) for q in (0.01, 0.5, 0.99)]).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
    stages = {i for j in tracker.getJobIdsForGroup("digests") for i in tracker.getJobInfo(j).stageIds}
    written = {i: store.lastStageAttempt(i).shuffleWriteRecords() for i in stages}
    assert 0 < max(written.values()) <= 6 * 60
    assert len(got) == 3
    for n, *at in got:
        assert n == 80_000 and all(abs(x / 240_007 - q) < 0.003 for x, q in zip(at, (0.01, 0.5, 0.99), strict=True))


@pytest.mark.parametrize("tasks", [1, 5])
def test_digest_of_a_value_that_is_most_of_its_key(spark, tasks):
    """Ranks beside it don't depend on how many tasks have read it; a key is one, whatever the sign of its zero, and so is a null."""
    from stateroll.operators import states as S
    from stateroll.operators.states import State

    df = spark.range(0, 200_000, 1, tasks).selectExpr("CASE WHEN id % 4 = 0 THEN 0.0D WHEN id % 4 = 2 THEN -0.0D END AS k", "CASE WHEN id < 4 THEN 0.0D WHEN id % 10 < 6 THEN 7.0D ELSE 9.0D END AS v")
    s = [State("q", "tdigest", "v")]
    built = S.build(df, ["k"], s)
    for frame in (built, S.merge(built, ["k"], s)):
        got = {r.k: tuple(r)[1:] for r in frame.select("k", S.weight("q"), S.quantile("q", 0.5), S.quantile("q", 0.61), S.cdf("q", 7.0)).collect()}
        assert set(got) == {0.0, None} and all(n == 100_000 and (middle, more) == (7.0, 9.0) and abs(seven - 0.6) < 0.0001 for n, middle, more, seven in got.values())
