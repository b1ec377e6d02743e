"""Exposure frequency on a stream, with kept state, and on a kept history of days.

On a stream: the state of a customer, action and placement holds its contacts of the window and the lag before the
watermark, nothing older: they can't change any frequency that is still to come. A row that comes late moves the
frequencies of exposures after it, and those are told again; of what is told for a contact, the last stands. Any split of
a table into batches, with rows late by the lag at most and contacts no longer than it, so ends in the rows of
FrequencyResponse.frequencies().

On a history: rows that matter are kept by day and chunk (a stored aggregate, whose log is the journal). A chunk that comes
again with another fingerprint replaces its own rows alone, and the days whose frequencies it can change follow from the days it had
and has. Those are computed from the kept rows; the source isn't read again.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stateroll.operators.frequency import FrequencyResponse
from stateroll.sources import sinks

KEY = ["customer", "action", "placement"]
#: What is told of a contact.
TOLD = Row(*KEY, "interaction", "s", "positive", "frequency")


class _Exposures(StatefulProcessor):
    """Of one customer, action and placement: contacts by interaction, with their first second, whether they are exposures, and positive, and the frequency told last (0: none).

    A key's contacts are read at once and written at once, as each call to the state store is a round trip.
    """

    def __init__(self, window: int, lag: int, most: int, kind: str) -> None:
        self.window, self.lag, self.most, self.kind = window, lag, most, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("exposures", f"interaction {self.kind}, s long, exposed boolean, positive boolean, told int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = {k: tuple(v) for k, *v in self.held.get()}
        held = {k: list(v) for k, v in before.items()}
        for name, s, exposed, positive in ((r["interaction"], r["s"], r["exposed"], r["positive"]) for r in rows):
            one = held.setdefault(name, [s, False, False, 0])
            one[:3] = min(one[0], s), one[1] or exposed, one[2] or positive
        # frequencies that rows still to come can move: of contacts that a row within the lag may add to
        open_ = timerValues.getCurrentWatermarkInMs() // 1000 - self.lag
        order = sorted((k for k in held if held[k][1]), key=lambda k: (held[k][0], k))
        told, first = [], 0
        for at, name in enumerate(order):
            s = held[name][0]
            while held[order[first]][0] <= s - self.window:
                first += 1
            if s >= open_:
                held[name][3] = min(at - first + 1, self.most)
            if tuple(held[name]) != before.get(name) and held[name][3]:
                told.append(TOLD(*key, name, s, *held[name][2:]))
        limit = open_ - self.window  # what is older is in none of their windows
        kept = {name: tuple(one) for name, one in held.items() if one[0] > limit}
        if kept != before:
            if kept:
                self.held.put([(name, *one) for name, one in kept.items()])
            else:
                self.held.clear()
        self._wake(before, kept)
        yield from told

    def _wake(self, before: dict, kept: dict) -> None:
        """A timer at which a key's newest contact is too old; what was held tells which timer there is."""
        at = lambda contacts: (max(one[0] for one in contacts.values()) + self.window + self.lag) * 1000 if contacts else None
        was, is_ = at(before), at(kept)
        if was != is_:
            if was is not None:
                self.handle.deleteTimer(was)
            if is_ is not None:
                self.handle.registerTimer(is_)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()  # the newest contact is too old
        return iter(())

    def close(self) -> None:
        pass


def frequencies_stream(stream: DataFrame, fr: FrequencyResponse, lag_hours: int) -> DataFrame:
    """Exposed contacts of the first rank with their frequency, told again whenever it changes (update mode): of a contact the last stands.

    Needs the RocksDB state store. Rows later than lag_hours are left out, as a watermark does.
    """
    exposures = fr.events(stream).where("rank = 1").select(*KEY, "interaction", "s", "exposed", "positive", F.timestamp_seconds("s").alias("at"))
    kinds = {f.name: f.dataType.simpleString() for f in exposures.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in (*KEY, "interaction")), "s long, positive boolean, frequency int"])
    processor = _Exposures(fr.window_hours * 3600, lag_hours * 3600, fr.max_frequency, kinds["interaction"])
    return exposures.withWatermark("at", f"{lag_hours} hours").groupBy(*KEY).transformWithState(processor, schema, "Update", "EventTime")


def last_told(told: DataFrame, batch: str = "batch") -> DataFrame:
    """Of what was told for each contact, the last: batch numbers ascend."""
    value = F.struct("s", "positive", "frequency")
    return told.groupBy(*KEY, "interaction").agg(F.max_by(value, batch).alias("v")).select(*KEY, "interaction", "v.*")


def keep(spark: SparkSession, path: str, fr: FrequencyResponse, chunk_id: str, fingerprint: str, source: DataFrame) -> list[dt.date]:
    """Keep a chunk's rows that matter in the history at path; gives the days that it had or has rows of (none, if this fingerprint is kept already)."""
    had: set[dt.date] = set()
    if _exists(spark, path):
        if not sinks.attempts_of(spark, path, fingerprint).join(_journal(spark, path), ["chunk_id", "pipeline_run_id"], "left_semi").where(F.col("chunk_id") == chunk_id).isEmpty():
            return []
        had = _days(sinks.scan_aggregate(spark, path).where(F.col("chunk_id") == chunk_id))
    rows = fr.events(source.drop("seen_current")).drop("seen_current").withColumn("period", F.to_date(F.timestamp_seconds("s")).cast("string"))
    got = sinks.write_aggregate(sinks.stamped(rows, uuid.uuid4().hex, chunk_id, fingerprint), path)
    return sorted(had | {dt.date.fromisoformat(r.period) for r in got.select("period").distinct().collect()})


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_log")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _journal(spark: SparkSession, path: str) -> DataFrame:
    """The attempt of each chunk that counts."""
    return sinks.attempts_of(spark, path).groupBy("chunk_id").agg(F.max_by("pipeline_run_id", F.struct("created_at", "pipeline_run_id")).alias("pipeline_run_id"))


def _days(rows: DataFrame) -> set[dt.date]:
    return {dt.date.fromisoformat(r.period) for r in rows.select("period").distinct().collect()}


def closure(days: Iterable[dt.date], before: int, after: int) -> list[dt.date]:
    """Days up to so many before and after the given ones, themselves included."""
    return sorted({d + dt.timedelta(k) for d in days for k in range(-before, after + 1)})


def days_to_do(changed: Iterable[dt.date], fr: FrequencyResponse, follow: int = 1) -> list[dt.date]:
    """Days whose frequencies rows of the changed days can move: the window after them, and `follow` days before, in which a contact may have begun."""
    return closure(changed, follow, -(-fr.window_hours // 24) + follow)


def frequencies_of(spark: SparkSession, path: str, fr: FrequencyResponse, days: list[dt.date], follow: int = 1, daily: bool = False) -> DataFrame:
    """Contacts of the given days with their frequency, runner-up and flags, as FrequencyResponse.responses() has them over all rows; from the kept rows of these days, their window and `follow` days.

    follow: days for which a contact may have rows after its first.
    """
    wanted = closure(days, -(-fr.window_hours // 24) + follow, follow)
    rows = sinks.scan_aggregate(spark, path).where(F.col("period").isin([str(d) for d in wanted]))
    contacts = fr.contacts(rows.drop("period", "chunk_id", "pipeline_run_id", "config_hash", "created_at").withColumn("seen_current", F.lit(True)))
    return fr.responses_of(contacts, daily).where(F.col("Day").isin(days))


def reconcile(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Of expected (chunk_id, fingerprint): those that aren't kept as they are, and so must be done."""
    if not _exists(spark, path):
        return expected
    log = sinks.attempts_of(spark, path).join(_journal(spark, path), ["chunk_id", "pipeline_run_id"], "left_semi")
    return expected.join(log.select("chunk_id", F.col("config_hash").alias("fingerprint")), ["chunk_id", "fingerprint"], "left_anti")
