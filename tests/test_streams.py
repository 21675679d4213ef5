"""Streams in several steps against batch results; late rows, restarts, empty streams."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.streaming import state

DAY = datetime(2024, 1, 1)


def plain_sessions(rows, gap):
    out = {}
    for u, t, v in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        mine = out.setdefault(u, [])
        if mine and t - mine[-1][1] <= gap:
            mine[-1][1:] = [t, mine[-1][2] + 1, mine[-1][3] + (v or 0)]
        else:
            mine.append([t, t, 1, v or 0])
    return sorted((u, *s) for u, ss in out.items() for s in ss)


@pytest.fixture(scope="module")
def events():
    rng = random.Random(2)
    return [(rng.choice([1, 1, 1, 2, 3, None]), DAY + timedelta(seconds=rng.randint(0, 40_000), microseconds=rng.randint(0, 9)), rng.choice([None, 1.0, 2.5])) for _ in range(400)]


@pytest.mark.parametrize("steps", [2, 10])
def test_sessions_in_steps(spark, tmp_path, events, steps):
    """Rows come up to 20 minutes out of order; however they are cut, sessions are those of the whole."""
    df = spark.createDataFrame(events, "user long, ts timestamp, v double")
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("ts", "user"), F.lit(1_200_000_000))
    rows, run = state.replayed(df, "ts", arrival, steps, str(tmp_path), lambda s: state.sessions(s, "user", "ts", "v", 300, "30 minutes"), "2 hours", {"user": -1})
    assert sorted(map(tuple, rows.collect())) == plain_sessions(events, timedelta(seconds=300))
    assert run["late"] == 0 and run["rows"] == 401 and run["batches"] >= steps + 1


def test_a_key_has_one_timer(spark, tmp_path):
    """However many sessions and questions a key has open: one timer, due with the first, answers all that are."""

    class Handle:
        def __init__(self):
            self.timers, self.value = [], None

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, t):
            self.timers.append(t)

        def deleteTimer(self, t):
            self.timers.remove(t)

        def getCurrentWatermarkInMs(self):
            return self.now

        def getExpiryTimeInMs(self):
            return self.timers.pop(0)

    day = [DAY + timedelta(hours=h) for h in (5, 1, 3, 9)]
    s, h = state.Sessions(60_000_000, "user"), Handle()
    s.init(h)
    list(s.handleInputRows((1,), iter([pd.DataFrame({"user": 1, "ts": day, "v": 1.0})]), h))
    assert len(h.timers) == 1
    h.now = int(pd.Timestamp(DAY + timedelta(hours=6), tz="UTC").timestamp() * 1000)
    assert len(next(s.handleExpiredTimer((1,), h, h))) == 3 and len(h.timers) == 1
    a, h = state.AsOf(["id", "last"]), Handle()
    a.init(h)
    h.now = 0
    list(a.handleInputRows((1,), iter([pd.DataFrame({"k": 1, "ts": day, "id": [1, 2, 3, 4], "asks": [True, False, True, True]})]), h))
    assert len(h.timers) == 1
    h.now = int(pd.Timestamp(DAY + timedelta(hours=6), tz="UTC").timestamp() * 1000)
    assert next(a.handleExpiredTimer((1,), h, h)).values.tolist() == [[3, 2], [1, 2]] and len(h.timers) == 1


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    at = lambda m: DAY + timedelta(minutes=m)
    batches = [[(1, at(0), 1.0), (1, at(200), 1.0)], [(1, at(195), 1.0), (2, at(300), 1.0)], [(1, at(1), 1.0), (2, at(304), 1.0)]]
    for rows in batches:
        spark.createDataFrame(rows, "user long, ts timestamp, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: state.sessions(state.read_steps(spark, f"{tmp_path}/in", "user long, ts timestamp, v double"), "user", "ts", "v", 600, "30 minutes")
    out, run = state.run_to_end(stream(), f"{tmp_path}/out", f"{tmp_path}/ck")
    # the third batch's row of minute 1 is behind the watermark of minute 170; that of 195 in the second is not
    assert run["late"] == 1 and sorted(map(tuple, out.collect())) == [(1, at(0), at(0), 1, 1.0), (1, at(195), at(200), 2, 2.0)]
    # a restart goes on with the state: the open session of user 2 takes the next row and closes with the last one
    for rows in ([(2, at(310), 1.0)], [(-1, at(900), None)]):
        spark.createDataFrame(rows, "user long, ts timestamp, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out, run = state.run_to_end(stream(), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert run["rows"] == 2 and (2, at(300), at(310), 3, 3.0) in set(map(tuple, out.collect())) and out.count() == 3


@pytest.mark.parametrize("steps", [1, 5])
def test_as_of_and_joins_in_steps(spark, tmp_path, steps):
    rng = random.Random(8)
    rows = [(i, rng.choice([1, 1, 2, None]), DAY + timedelta(seconds=rng.randint(0, 20_000)), rng.random() < 0.4) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, user long, ts timestamp, asks boolean")
    got, run = state.replayed(df, "ts", F.unix_micros("ts"), steps, f"{tmp_path}/a", lambda s: state.as_of(s, "user", "ts", "id", F.col("asks"), "1 hour", ("id", "last")), "5 hours", {"user": -1})
    want = []
    for i, u, t, asks in rows:
        if asks and u is not None:
            want.append((i, max(((y, j) for j, x, y, a in rows if x == u and not a and y <= t), default=(None, None))[1]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and run["late"] == 0

    def join(s):
        asks, seen = s.where("asks or user = -1").select("id", "user", "ts"), s.where("not asks or user = -1").select(F.col("id").alias("other"), "user", F.col("ts").alias("seen"))
        return state.joined_within(asks, seen, "user", "ts", "seen", "10 minutes", "1 hour", "left_outer").select("id", "other")

    got, _ = state.replayed(df, "ts", F.unix_micros("ts"), steps, f"{tmp_path}/b", join, "5 hours", {"user": -1})
    want = []
    for i, u, t, asks in rows:
        if asks:
            near = [(i, j) for j, x, y, a in rows if u is not None and x == u and not a and t - timedelta(minutes=10) <= y <= t]
            want += near or [(i, None)]
    got = got.where("id is not null")  # the closing rows of both sides meet each other
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_distinct_and_empty_streams(spark, tmp_path):
    df = spark.createDataFrame([(k, DAY + timedelta(minutes=m)) for k, m in [("a", 0), ("a", 1), ("b", 2), ("a", 3)]], "k string, ts timestamp")
    got, _ = state.replayed(df, "ts", F.unix_micros("ts"), 2, f"{tmp_path}/a", lambda s: state.distinct_within(s, ["k"], "ts", "1 hour").select("k"), "3 hours", {"k": "end"})
    assert sorted(r["k"] for r in got.collect()) == ["a", "b", "end"]
    none = spark.createDataFrame([], "user long, ts timestamp, v double")
    got, run = state.replayed(none, "ts", F.unix_micros("ts"), 2, f"{tmp_path}/b", lambda s: state.sessions(s, "user", "ts", "v", 60, "1 hour"), "3 hours", {"user": -1})
    assert got.count() == 0 and run["rows"] == 0
