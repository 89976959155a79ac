"""Memory records as a stateful stream: versions of profile facts, decay, expiry and purge by event-time timers.

The state of a (user, key) is its records and the candidates that wait for the watermark to pass their batch's time, so the
order in which rows arrive, and how they are cut into micro-batches, changes nothing. Keys share their state in groups by hash. What comes out is a log of records as
they change; its last entries are the table that the batch operators make.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from heapq import heapify, heappop, heappush
from operator import attrgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import memory as M
from tessera.streaming.events import run_stateful

_TIMES = ("last_accessed_at", "expires_at", "created_at", "updated_at")
_RECORD = (
    "memory_type string, content string, told string, conversation_id string, session_id string, base_importance_score double, importance_score double, "
    "confidence_score double, access_count int, status string, version int, supersedes_memory_id string, " + ", ".join(f"{t} long" for t in _TIMES)
)
_FIELDS = [f.split()[0] for f in _RECORD.split(", ")]
_values = attrgetter(*_FIELDS)
_OUT = f"memory_id string, user_id string, memory_key string, {_RECORD}, purged boolean, seq long"
#: Groups of keys. A micro-batch reads and writes those that its keys fall in, so they are many and small; but each costs some
#: messages and batches of its own, about as much as 170 changes by two timed runs. A checkpoint keeps the number it began with.
GROUPS = 1 << 12
_DAY = 86_400_000_000
#: A pass so long after now needs no timer.
_NEVER = 100_000 * _DAY


@dataclass
class Record:
    """A memory record; times are microseconds, `told` is the content as it is compared. None is changed in place: frozen ones take long to make."""

    memory_type: str
    content: str
    told: str
    conversation_id: str | None
    session_id: str | None
    base_importance_score: float
    importance_score: float
    confidence_score: float
    access_count: int
    status: str
    version: int
    supersedes_memory_id: str | None
    last_accessed_at: int | None
    expires_at: int | None
    created_at: int | None
    updated_at: int | None

    def age(self, at: int) -> float:
        since = next((t for t in (self.last_accessed_at, self.created_at) if t is not None), at)
        return max(0.0, (at - since) / _DAY)

    def score(self, at: int) -> float:
        fading = M.EVENT_DAYS if self.memory_type == "event" else M.PROFILE_DAYS
        bonus = min(M.MOST_BONUS, M.BONUS * math.log1p(max(self.access_count, 0)))
        raw = self.base_importance_score * self.confidence_score * math.exp(-self.age(at) / fading) + bonus
        return math.floor(100 * max(0.0, min(100.0, raw)) + 0.5) / 100

    def over(self, at: int) -> bool:
        """Whether a pass at this time ends or purges the record. Once it does, every later pass would."""
        if self.status == "active":
            weak = self.score(at) < M.THRESHOLD and (self.memory_type == "event" or self.age(at) >= M.STALE_DAYS)
            return weak or (self.expires_at is not None and self.expires_at <= at)
        return self.updated_at is not None and self.updated_at < at - M.RETENTION_DAYS * _DAY

    def order(self, memory_id: str) -> tuple:
        """The current record of a key is the first in this order."""
        return -self.version, -(self.updated_at or 0), memory_id


def _entry(memory_id: str, key: tuple, record: Record, purged: bool, seq: int) -> str:
    return json.dumps({"memory_id": memory_id, "user_id": key[0], "memory_key": key[1], **vars(record), "purged": purged, "seq": seq})


@dataclass
class Held:
    """What is known of one (user, key): records by id, the last candidate of each time that waits, and when something is due next, if ever."""

    seq: int = 0
    passed: int = -(1 << 62)
    due: int | None = None
    records: dict[str, Record] = field(default_factory=dict)
    waiting: dict[int, tuple] = field(default_factory=dict)

    @classmethod
    def of(cls, told: list) -> Held:
        seq, passed, due, records, waiting = told
        held = cls(seq, passed, due, {m: Record(*v) for m, *v in records})
        for candidate in map(tuple, waiting):
            held.wait(candidate)
        return held

    def told(self) -> list:
        return [self.seq, self.passed, self.due, [[m, *_values(r)] for m, r in self.records.items()], list(self.waiting.values())]

    def wait(self, candidate: tuple) -> None:
        """Of the candidates of a time only the last by position counts, so no other is kept."""
        other = self.waiting.get(candidate[0])
        if other is None or candidate[1] > other[1]:
            self.waiting[candidate[0]] = candidate


class Keeper(StatefulProcessor):
    """The records of the (user, key) pairs of a group. Maintenance passes are at `first` and every `every` microseconds after it, if at all.

    A pass needs a timer only where it changes a record, so keys that nothing happens to cost nothing at a pass. Each call of
    the state store is a message to another process, many times what a record costs, so a group is one value with one timer;
    of its keys only those that have rows or are due are taken apart. Records that nothing can change any more are told once
    and not kept: without passes, all but active profiles.
    """

    def __init__(self, first: int | None, every: int | None) -> None:
        self.first, self.every = first, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "timer long, keys string")

    def _kept(self, record: Record) -> bool:
        return self.first is not None or (record.status == "active" and record.memory_type == "profile")

    def _pass_time(self, record: Record, after: int) -> int | None:
        """The first pass after a time that changes the record; the passes are searched by halving."""
        if self.first is None:
            return None
        if not self.every:
            return self.first if self.first > after and record.over(self.first) else None
        low = max(0, -(-(after + 1 - self.first) // self.every))
        due = lambda n: record.over(self.first + (low + n) * self.every)
        gap = 1
        while not due(gap - 1):
            gap *= 2
            if gap * self.every > _NEVER:
                return None
        a, b = gap // 2, gap - 1  # the passes before a end or purge nothing, the one at b does
        while a < b:
            half = (a + b) // 2
            a, b = (a, half) if due(half) else (half + 1, b)
        return self.first + (low + a) * self.every

    def _advance(self, key: tuple, held: Held, now: int) -> list[str]:
        """Do what is due by the watermark, in order of time, candidates before passes; returns log entries."""
        records, log = held.records, []
        before = dict(records)
        # Passes by record; what a change of the record makes of it replaces the time here, and older entries of the heap don't count.
        soonest = {m: t for m, r in records.items() if (t := self._pass_time(r, held.passed)) is not None}
        heap = [(t, m) for m, t in soonest.items()]
        heapify(heap)
        times = sorted(held.waiting, reverse=True)
        while True:
            while heap and soonest.get(heap[0][1]) != heap[0][0]:
                heappop(heap)
            told = times[-1] if times else None
            held.due = min([t for t in (told, heap[0][0] if heap else None) if t is not None], default=None)
            if held.due is None or held.due > now:
                break
            if told == held.due:
                changed, held.passed = self._apply(records, held.waiting.pop(times.pop())), max(held.passed, held.due - 1)
            else:
                changed, held.passed = [], held.due
                while heap and heap[0][0] == held.due:
                    _, m = heappop(heap)
                    if soonest.get(m) == held.due:
                        del soonest[m]
                        changed.append(m)
                self._pass(records, changed, held.due)
            for m in changed:
                held.seq += 1
                r = records.get(m)
                log.append(_entry(m, key, r or before[m], r is None, held.seq))
                before[m] = r or before[m]
                soonest.pop(m, None)
                if r is not None and (t := self._pass_time(r, held.passed)) is not None:
                    soonest[m] = t
                    heappush(heap, (t, m))
                if r is not None and not self._kept(r):
                    del records[m]
        return log

    def _apply(self, held: dict[str, Record], candidate: tuple) -> list[str]:
        """The last candidate of a batch against the current record: delete, refresh or a new version."""
        at, _, memory_id, content, action, conversation, session, base, confidence = candidate
        live = [(r.order(m), m) for m, r in held.items() if r.status == "active" and r.memory_type == "profile"]
        old = min(live)[1] if live else None
        if action == "delete":
            if old is None:
                return []
            held[old] = replace(held[old], status="deleted", updated_at=at)
            return [old]
        if old is not None and held[old].told == content:
            held[old] = replace(held[old], base_importance_score=base, importance_score=base, confidence_score=confidence, last_accessed_at=at, updated_at=at)
            return [old]
        version = 1
        if old is not None:
            held[old] = replace(held[old], status="superseded", updated_at=at)
            version = held[old].version + 1
        held[memory_id] = Record("profile", content, content, conversation, session, base, base, confidence, 0, "active", version, old, None, None, at, at)
        return [memory_id] if old is None else [old, memory_id]

    def _pass(self, held: dict[str, Record], over: list[str], at: int) -> None:
        """A pass that ends or purges the records that are `over`."""
        for m in over:
            r = held[m]
            if r.status == "active":
                held[m] = replace(r, status="expired", importance_score=r.score(at), updated_at=at)
            else:
                del held[m]

    def _entries(self, log: list[str]) -> Iterator[pd.DataFrame]:
        if log:
            yield pd.DataFrame({"entry": log})

    def _load(self) -> tuple[int, dict[tuple, list]]:
        timer, keys = self.group.get() or (-1, "[]")
        return timer, {(user, key): told for user, key, told in json.loads(keys)}

    def _save(self, timer: int, keys: dict[tuple, list], fired: int = -1) -> None:
        """Keep the group, with one timer for what is due first; one that has `fired` is taken away by Spark."""
        due = min((told[2] for told in keys.values() if told[2] is not None), default=None)
        following = -1 if due is None else -(-due // 1000)
        if following != timer:
            if timer >= 0 and timer != fired:
                self.handle.deleteTimer(timer)
            if following >= 0:
                self.handle.registerTimer(following)
        self.group.update((following, json.dumps([[*key, told] for key, told in keys.items()])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, keys = self._load()
        now, log, touched = timerValues.getCurrentWatermarkInMs() * 1000, [], {}
        for frame in rows:
            for change in frame["change"]:
                row = json.loads(change)
                pair, kind = (row.get("user_id"), row.get("memory_key")), row["kind"]
                held = touched.get(pair)
                if held is None:
                    held = touched[pair] = Held.of(keys[pair]) if pair in keys else Held()
                if kind == "record":
                    record = Record(*map(row.get, _FIELDS))
                    held.seq, held.passed = held.seq + 1, max(held.passed, row["at_micros"] - 1)  # what came before shows in the record
                    if self._kept(record):
                        held.records[row["memory_id"]] = record
                    else:
                        held.records.pop(row["memory_id"], None)
                    # The change names the record's fields as the log does; JSON of a row is never empty.
                    log.append(f'{change[:-1]},"purged":false,"seq":{held.seq}}}')
                elif kind == "candidate":
                    held.wait((
                        row["at_micros"], row.get("position") or 0, row.get("memory_id"), row.get("content"), row.get("action"), row.get("conversation_id"), row.get("session_id"),
                        float(row["base_importance_score"]), float(row["confidence_score"]),
                    ))
        for pair in touched.keys() | {p for p, told in keys.items() if told[2] is not None and told[2] <= now}:
            held = touched.get(pair) or Held.of(keys[pair])
            log += self._advance(pair, held, now)
            keys[pair] = held.told()
        self._save(timer, keys)
        yield from self._entries(log)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer, keys = self._load()
        now, log = timerValues.getCurrentWatermarkInMs() * 1000, []
        for pair in [p for p, told in keys.items() if told[2] is not None and told[2] <= now]:
            held = Held.of(keys[pair])
            log += self._advance(pair, held, now)
            keys[pair] = held.told()
        self._save(timer, keys, expiredTimerInfo.getExpiryTimeInMs())
        yield from self._entries(log)


def record_changes(records: DataFrame, at: datetime) -> DataFrame:
    """Records that are there already, as rows of the stream's input with time `at`."""
    micros = {t: F.unix_micros(t).alias(t) for t in _TIMES}
    columns = [M.squeezed(F.col("content")).alias(f) if f == "told" else micros.get(f, F.col(f)) for f in _FIELDS]
    return records.select(F.lit("record").alias("kind"), F.lit(at).cast("timestamp").alias("at"), "memory_id", "user_id", "memory_key", F.lit(0).cast("long").alias("position"), F.lit("").alias("action"), *columns)


def candidate_changes(candidates: DataFrame, at: datetime) -> DataFrame:
    """Profile candidates of the batch with time `at`, as rows of the stream's input."""
    given = M.prepared_profiles(candidates, F.lit(at).cast("timestamp"))
    have = {"content", "conversation_id", "session_id", "base_importance_score", "confidence_score"}
    kinds = dict(f.split() for f in _RECORD.split(", "))
    columns = [F.col(f) if f in have else F.lit(None).cast(kinds[f]).alias(f) for f in _FIELDS]
    return given.select(F.lit("candidate").alias("kind"), F.lit(at).cast("timestamp").alias("at"), "memory_id", "user_id", "memory_key", F.col("position").cast("long").alias("position"), "action", *columns)


def tick(spark: SparkSession, like: DataFrame, at: datetime) -> DataFrame:
    """One row that says nothing but that this time has come, so that the watermark passes what is before it."""
    empty = [F.lit(v).cast(f.dataType).alias(f.name) for f in like.schema.fields for v in [{"kind": "tick", "at": at, "user_id": "", "memory_key": ""}.get(f.name)]]
    return spark.range(1).select(*empty)


def keep_memories(changes: DataFrame, delay: str, first: datetime | None = None, every: timedelta | None = None, groups: int = GROUPS) -> DataFrame:
    """The log of a stream of changes: a row for each record as it comes in or changes, with `purged` and `seq`.

    `changes`: rows of `record_changes` and `candidate_changes`, streamed. Rows may be late by `delay`. Candidates of one
    time are one batch, of which a key's last counts. Maintenance passes are at `first` and then every `every`: a pass ends
    what has expired or faded, and purges what has long not been active. Without `first` there are none. A stream that goes
    on from a checkpoint needs the number of `groups` that it began with.
    """
    micros = lambda t: None if t is None else round(t.timestamp() * 1e6)
    keeper = Keeper(micros(first), None if every is None else round(every.total_seconds() * 1e6))
    sent = F.to_json(F.struct(F.unix_micros("at").alias("at_micros"), *(c for c in changes.columns if c != "at")))
    group = F.pmod(F.xxhash64("user_id", "memory_key"), F.lit(groups)).cast("int")
    told = changes.withWatermark("at", delay).select(group.alias("group"), "at", sent.alias("change"))
    log = told.groupBy("group").transformWithStateInPandas(keeper, "entry string", "Append", "EventTime")
    return log.select(F.from_json("entry", _OUT).alias("r")).select("r.*")


def run(changes: DataFrame, delay: str, first: datetime | None = None, every: timedelta | None = None, base: str | None = None, groups: int = GROUPS) -> DataFrame:
    """Process all that is there now; returns the whole log so far. The same `base` again continues from its checkpoint."""
    return run_stateful(keep_memories(changes, delay, first, every, groups), base)


def end_state(log: DataFrame) -> DataFrame:
    """The table of records that the log has led to."""
    last = log.groupBy("memory_id").agg(F.max_by(F.struct(*(c for c in log.columns if c != "memory_id")), "seq").alias("r")).select("memory_id", "r.*")
    return last.filter(~F.col("purged")).drop("purged", "seq", "told").withColumns({t: F.timestamp_micros(t) for t in _TIMES})
