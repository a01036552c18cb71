"""Sessions as state: rows of a session in the order of time over any micro-batches, with event-time timers.

Batches bring a session's rows in no order. Rows wait in the session's state until the watermark has passed them (no row
of that time can come any more, as Spark drops it), and are then taken in order. A session's state is what waits, bounded
by the watermark's delay, and what the processor keeps of the rows before: a ring of values, a bit, less than a chunk.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .live import TRAILING, decisions

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SILENCE_S = 2.5


class Ordered(StatefulProcessor):
    """Takes a session's rows in order. Subclasses say what waits (columns, the first two the time in microseconds and
    what breaks ties), what rows give (taken), and what time alone gives (passed, with due as its next time); each is
    given what the session keeps (None at first) and gives back what it keeps from then on.

    A session is one value: its timer, what waits, and what it keeps, as JSON. So a call reads and writes the store once,
    and touches timers only when the next time changes.
    """

    waits: list[str]
    output: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "timer long, waiting string, kept string")

    def taken(self, rows: list[list], kept) -> tuple[list[tuple], object]:
        raise TypeError("a processor says what its rows give")

    def passed(self, now_us: int, kept) -> tuple[list[tuple], object]:
        """What follows from the time alone, after all rows up to now."""
        return [], kept

    def due(self, kept) -> int | None:
        """When time alone gives something next, in microseconds."""
        return None

    def _advance(self, key: tuple, fresh: list[list], now_ms: int, expired_ms: int | None = None) -> Iterator[Row]:
        now = now_ms * 1000
        timer, waiting, kept = self.session.get() or (None, "[]", "null")
        rows, kept = sorted([*json.loads(waiting), *fresh], key=lambda r: (r[0], r[1] is None, r[1])), json.loads(kept)
        ready = bisect.bisect_right(rows, now, key=lambda r: r[0])
        out, kept = self.taken(rows[:ready], kept) if ready else ([], kept)
        more, kept = self.passed(now, kept)
        times = [t for t in (rows[ready][0] if ready < len(rows) else None, self.due(kept)) if t is not None]
        ahead = max(now_ms + 1, -(-min(times) // 1000)) if times else None
        if ahead != timer:
            if timer not in (None, expired_ms):  # Spark itself deletes the one that expires
                self.handle.deleteTimer(timer)
            if ahead is not None:
                self.handle.registerTimer(ahead)
        self.session.update((ahead, json.dumps(rows[ready:]), json.dumps(kept)))
        make = Row("session", *self.output)
        for r in out + more:
            yield make(key[0], *r)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._advance(key, [[r[c] for c in self.waits] for r in rows], max(0, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


class Referee(Ordered):
    """One decision a frame: louder than the mean of the trailing frames or not; none for a frame without a value. Keeps the
    trailing values."""

    waits, output = ["at_us", "event_id", "value"], ["event_id", "speaking"]

    def __init__(self, trailing: int = TRAILING):
        self.trailing = trailing

    def taken(self, rows: list[list], kept) -> tuple[list[tuple], object]:
        past, values = kept or [], [r[2] for r in rows]
        return list(zip((r[1] for r in rows), decisions(past, values, self.trailing))), (past + values)[-(self.trailing - 1):]


class Chunks(Ordered):
    """Whole chunks of `size` frames. Keeps the number of chunks, and the frames that don't fill one."""

    waits, output = ["at_us", "event_id"], ["chunk", "event_ids"]

    def __init__(self, size: int = 5):
        self.size = size

    def taken(self, rows: list[list], kept) -> tuple[list[tuple], object]:
        done, rest = kept or (0, [])
        ids = rest + [r[1] for r in rows]
        whole = len(ids) // self.size
        return [(done + k, ids[k * self.size:(k + 1) * self.size]) for k in range(whole)], (done + whole, ids[whole * self.size:])


class Orchestrator(Ordered):
    """The floor's actions at each flag, and SILENCE_BREAK where no frame follows for a while: found when the next frame
    is taken, or by a timer once the watermark has passed it. Keeps whether a prefetch is active, the last frame's time,
    and whether its silence was broken."""

    waits = ["at_us", "event_id", "flag", "agent_state", "spoken"]
    output = ["at_us", "event_id", "flag", "prefetch_active", "actions"]
    named = {"BARGE_HARD": "barge_hard", "BARGE_SOFT": "barge_soft", "COMMIT_LLM": "commit", "CANCEL_LLM": "cancel", "TURN_END": "turn_end"}

    def __init__(self, silence_us: int):
        self.silence_us = silence_us

    def taken(self, rows: list[list], kept) -> tuple[list[tuple], object]:
        active, last, broken = kept or (0, None, True)
        out = []
        for at, event_id, flag, state, spoken in rows:
            if not broken and at > last + self.silence_us:
                out.append(self.broken(last, active))
            starts = flag == "PREFETCH_LLM" and (state or "") != "LLM_GEN"
            done = ["prefetch"] if starts or flag == "TURN_END" and not active else []
            done += [self.named[flag]] if flag in self.named else []
            done += ["say"] if flag == "SILENCE_BREAK" or spoken else []
            out.append((at, event_id, flag, active, done))
            active = 1 if starts else 0 if flag in ("COMMIT_LLM", "CANCEL_LLM") else active
            last, broken = at, False
        return out, (active, last, broken)

    def broken(self, last: int, active: int) -> tuple:
        return last + self.silence_us, None, "SILENCE_BREAK", active, ["say"]

    def passed(self, now_us: int, kept) -> tuple[list[tuple], object]:
        active, last, broken = kept or (0, None, True)
        if broken or now_us < last + self.silence_us:
            return [], kept
        return [self.broken(last, active)], (active, last, True)

    def due(self, kept) -> int | None:
        return None if kept is None or kept[2] else kept[1] + self.silence_us


def by_session(rows: DataFrame, session: str, ts: str, late: str, processor: Ordered, output: str) -> DataFrame:
    """What the processor gives for each session of a stream; rows later than the delay are left out by Spark."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at = rows.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).where(F.col("at").isNotNull())
    named = at.select(F.col(session).cast("long").alias("session"), "at", F.unix_micros("at").alias("at_us"), *[c for c in processor.waits if c != "at_us"])
    return named.groupBy("session").transformWithState(processor, f"session long, {output}", "append", "EventTime")


def referee(frames: DataFrame, session: str, ts: str, late: str, trailing: int = TRAILING) -> DataFrame:
    """(session, event_id, speaking): one decision a frame, by event_id where times are equal."""
    return by_session(frames, session, ts, late, Referee(trailing), "event_id long, speaking boolean")


def chunks(frames: DataFrame, session: str, ts: str, late: str, size: int = 5) -> DataFrame:
    """(session, chunk, event_ids): frames in whole chunks, in the order of time."""
    return by_session(frames, session, ts, late, Chunks(size), "chunk long, event_ids array<long>")


def orchestrator(steps: DataFrame, session: str, ts: str, late: str, silence_s: float = SILENCE_S) -> DataFrame:
    """(session, at_us, event_id, flag, prefetch_active, actions): the batch twin is logs.orchestrated."""
    return by_session(steps, session, ts, late, Orchestrator(round(silence_s * 1e6)), "at_us long, event_id long, flag string, prefetch_active int, actions array<string>")
