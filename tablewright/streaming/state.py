"""Streams with state: sessions and as-of answers by timers, joins of two streams, and replays of a table in steps.

A replay turns a table into files that arrive step by step, so a stream can be tested, or back-filled, with the rows that
a batch query reads: as long as no row comes later than the watermark allows, both give the same result, in however
many steps the rows come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: No time of a timer, and no id.
NO_TIMER = -(1 << 62)

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_steps(df: DataFrame, arrival: Column, steps: int, folder: str, at: str, ends_after: str, closing: dict, files: int = 1) -> None:
    """Writes ``df`` as ``steps`` groups of ``files`` files in the order of ``arrival`` (a number), and one closing row after them.

    Steps are cut by the arrivals' quantiles. The closing row has the values ``closing``, nulls, and in ``at`` the
    greatest time plus the interval ``ends_after``: it moves the watermark past every open window, so all results come
    out, and waits itself for one that never comes. Give it a key of its own: rows without a key may be left out
    before a watermark sees them.
    """
    edges = df.agg(F.percentile_approx(arrival, [i / steps for i in range(1, steps)] or [0.5], 10_000)).first()[0] or []
    edges = edges[: steps - 1]
    for low, high in zip([None, *edges], [*edges, None]):
        inside = F.lit(True) if low is None else arrival >= low
        inside = inside & (F.lit(True) if high is None else arrival < high)
        df.where(F.coalesce(inside, F.lit(low is None))).repartition(files).write.mode("append").parquet(folder)
    last = df.agg((F.max(at) + F.expr(f"interval {ends_after}")).alias(at)).where(F.col(at).isNotNull())
    blank = [F.col(at) if f.name == at else F.lit(closing.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema]
    last.select(*blank).repartition(files).write.mode("append").parquet(folder)


def read_steps(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """The files of :func:`write_steps` as a stream, a step a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> tuple[DataFrame, dict[str, int]]:
    """Runs a stream over all that has arrived and reads its rows back; ``(rows, {batches, rows, late})``.

    Rows are appended to ``out`` exactly once over any number of calls with one ``checkpoint``. ``late`` counts the rows
    that came after the watermark and were dropped.
    """
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    query.awaitTermination()
    done = query.recentProgress
    late = sum(op.get("numRowsDroppedByWatermark", 0) for p in done for op in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(out), {"batches": len(done), "rows": sum(p["numInputRows"] for p in done), "late": late}


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def _set_timer(handle, known: int, wanted: int) -> None:
    """A key has one timer, the first that it waits for; ``NO_TIMER`` is none."""
    if known != wanted:
        if known != NO_TIMER:
            handle.deleteTimer(known)
        if wanted != NO_TIMER:
            handle.registerTimer(wanted)


def _packed(rows: list[tuple], kinds: str) -> bytes:
    return np.array(rows, dtype=kinds).tobytes()


def _unpacked(held, kinds: str) -> list[tuple]:
    return np.frombuffer(bytes(held), dtype=kinds).tolist()


class Sessions(StatefulProcessor):
    """A key's rows, cut where more than ``gap`` microseconds pass without one; a timer closes sessions for good.

    A key's open sessions are one value and have one timer: when it is due, all that the watermark has passed are closed.
    """

    KINDS = "i8,i8,i8,f8"

    def __init__(self, gap: int, key: str):
        self.gap, self.names = gap, [key, "begin", "finish", "n", "total"]

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "timer long, spans binary")

    def due(self, finish: int) -> int:
        """The first millisecond at which no row can lengthen the session any more."""
        return (finish + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.open.get()
        known, held = (state[0], _unpacked(state[1], self.KINDS)) if state else (NO_TIMER, [])
        for pdf in rows:
            held += [(t, t, 1, 0.0 if pd.isna(v) else float(v)) for t, v in zip(_micros(pdf.iloc[:, 1]).tolist(), pdf.iloc[:, 2])]
        merged: list[tuple] = []
        for begin, finish, n, total in sorted(held):
            if merged and begin - merged[-1][1] <= self.gap:
                b, f, m, t = merged[-1]
                merged[-1] = (b, max(f, finish), m + n, t + total)
            else:
                merged.append((begin, finish, n, total))
        first = self.due(merged[0][1]) if merged else NO_TIMER  # sessions do not overlap, so the first ends first
        _set_timer(self.handle, known, first)
        self.open.update((first, _packed(merged, self.KINDS)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        state = self.open.get()
        held = _unpacked(state[1], self.KINDS) if state else []
        closed, left = [s for s in held if self.due(s[1]) <= now], [s for s in held if self.due(s[1]) > now]
        if left:
            _set_timer(self.handle, NO_TIMER, self.due(left[0][1]))
            self.open.update((self.due(left[0][1]), _packed(left, self.KINDS)))
        else:
            self.open.clear()
        if closed:
            out = pd.DataFrame([(key[0], *s) for s in closed], columns=self.names)
            yield out.assign(**{c: pd.to_datetime(out[c], unit="us", utc=True) for c in ("begin", "finish")})

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, key: str, at: str, value: str, gap_seconds: int, late: str) -> DataFrame:
    """``(key, begin, finish, n, total)`` of each session, once it is closed; rows more than ``late`` behind are dropped.

    Open sessions are the state, of a key its gaps' worth of time behind the watermark. Rows without a key are in none;
    null values count as rows of 0. ``at`` is a timestamp column, the key a long.
    """
    gap = gap_seconds * 1_000_000
    src = stream.withWatermark(at, late).where(F.col(key).isNotNull()).select(F.col(key).cast("long"), at, F.col(value).cast("double"))
    out = f"`{key}` long, begin timestamp, finish timestamp, n long, total double"
    return src.groupBy(key).transformWithStateInPandas(Sessions(gap, key), out, "append", "eventTime")


class AsOf(StatefulProcessor):
    """A key's open questions and the answers that may still be the last before one; a timer answers questions.

    They are one value with one timer: when it is due, all questions that the watermark has passed are answered.
    """

    KINDS = "i8,i8"

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "timer long, asked binary, seen binary")

    def held(self) -> tuple[int, list[tuple], list[tuple]]:
        state = self.open.get()
        return (state[0], _unpacked(state[1], self.KINDS), _unpacked(state[2], self.KINDS)) if state else (NO_TIMER, [], [])

    def keep(self, known: int, asked: list[tuple], seen: list[tuple]) -> None:
        # by then every answer that is not later has come
        first = min(asked)[0] // 1000 + 1 if asked else NO_TIMER
        _set_timer(self.handle, known, first)
        self.open.update((first, _packed(asked, self.KINDS), _packed(seen, self.KINDS))) if asked or seen else self.open.clear()

    @staticmethod
    def needed(seen: list[tuple], now: int) -> list[tuple]:
        """Of sorted answers older than the last before the watermark can be nobody's any more."""
        old = sum(t // 1000 < now for t, _ in seen)
        return seen[max(old - 1, 0) :]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, asked, seen = self.held()
        for pdf in rows:
            at, ids, asks = (pdf.iloc[:, i] for i in (1, 2, 3))  # by place: a plan may drop an alias
            for t, i, question in zip(_micros(at).tolist(), ids.tolist(), asks.tolist()):
                (asked if question else seen).append((t, NO_TIMER if pd.isna(i) else int(i)))
        self.keep(known, asked, seen if asked else self.needed(sorted(seen), timerValues.getCurrentWatermarkInMs()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        _, asked, seen = self.held()
        asked, seen = sorted(asked), sorted(seen)
        ready, left = [q for q in asked if q[0] // 1000 < now], [q for q in asked if q[0] // 1000 >= now]
        out, last, at = [], None, 0
        for t, i in ready:
            while at < len(seen) and seen[at][0] <= t:
                last, at = seen[at][1], at + 1
            out.append(tuple(None if x == NO_TIMER else x for x in (i, last)))
        self.keep(NO_TIMER, left, self.needed(seen, now))
        if out:
            yield pd.DataFrame(out, columns=self.names).astype("Int64")

    def close(self) -> None:
        pass


def as_of(stream: DataFrame, key: str, at: str, id_col: str, asks: Column, late: str, names: tuple[str, str]) -> DataFrame:
    """For each asking row of a key the ``id_col`` of its last other row that is not later; of one time the greatest; else null.

    One stream holds both kinds of rows, so one watermark says when all rows before a question have come: it is answered
    then, once. Of the answers only those after the last one before the watermark stay in the state.
    """
    src = stream.withWatermark(at, late).where(F.col(key).isNotNull())
    src = src.select(F.col(key).alias("_key"), at, F.col(id_col).cast("long").alias("_id"), asks.alias("_asks"))
    return src.groupBy("_key").transformWithStateInPandas(AsOf(list(names)), f"`{names[0]}` long, `{names[1]}` long", "append", "eventTime")


def joined_within(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, before: str, late: str, how: str = "inner") -> DataFrame:
    """Two streams: each left row with the right rows of its key at most ``before`` earlier; ``left_outer`` keeps rows without one.

    The bound on both times lets Spark drop a row from the state once no row can meet it; an unmatched left row comes out
    then, with nulls. Column names of the two sides must differ but for the key.
    """
    l, r = left.withWatermark(left_at, late), right.withWatermark(right_at, late).withColumnRenamed(key, "_key")
    near = (F.col(key) == F.col("_key")) & (F.col(right_at) <= F.col(left_at)) & (F.col(right_at) >= F.col(left_at) - F.expr(f"interval {before}"))
    return l.join(r, near, how).drop("_key")


def distinct_within(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Rows whose keys have not come in the time that ``late`` allows; older keys are forgotten."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def replayed(df: DataFrame, at: str, arrival: Column, steps: int, folder: str, make: Callable[[DataFrame], DataFrame], ends_after: str, closing: dict) -> tuple[DataFrame, dict[str, int]]:
    """A table sent through a streaming operator in ``steps`` micro-batches: its rows, and what the run counted.

    ``folder`` is shared and new; the rows that arrive, the state and the result lie in it.
    """
    write_steps(df, arrival, steps, f"{folder}/in", at, ends_after, closing)
    stream = make(read_steps(df.sparkSession, f"{folder}/in", df.schema))
    return run_to_end(stream, f"{folder}/out", f"{folder}/state")
