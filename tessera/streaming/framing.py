"""Events out of answers that arrive as chunks of bytes, cut anywhere: a stateful stream that carries unfinished tails.

A body is a row of blocks that an empty line parts; a block's `event:` line names it (`message` without one) and its `data:`
lines, joined, are what it says. Blocks without data are none. Lines may end in CR LF. A body that ends without a `done` gets
one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "request_id string, seq long, event string, data string"
#: Groups of requests, and numbers of chunks in a block. A micro-batch reads and writes the groups that its requests fall in, so
#: they are many and small; a checkpoint keeps the number it began with.
GROUPS, BLOCK = 1 << 13, 64


def parse_block(block: bytes) -> tuple[str, str] | None:
    """The event and data of a block, None without data. Bytes that aren't UTF-8 are replaced."""
    event, said = "message", []
    for line in block.decode("utf-8", "replace").strip().split("\n"):
        if line.startswith("event:"):
            event = line[6:].strip()
        elif line.startswith("data:"):
            said.append(line[5:].strip())
    return (event, "\n".join(said)) if said else None


class Framer:
    """Takes chunks of a body in order and gives its events; `tail` is what no block holds yet."""

    def __init__(self, tail: bytes = b"", done: bool = False) -> None:
        self.tail, self.done, self.searched = bytearray(tail), done, 0

    def _event(self, block: bytes) -> Iterator[tuple[str, str]]:
        found = parse_block(block)
        if found:
            self.done = self.done or found[0] == "done"
            yield found

    def add(self, chunk: bytes) -> Iterator[tuple[str, str]]:
        at = max(0, len(self.tail) - 1)
        self.tail += chunk
        # A CR at the end waits for its LF.
        fresh = bytes(self.tail[at:])
        whole = fresh[:-1] if fresh.endswith(b"\r") else fresh
        self.tail[at:] = whole.replace(b"\r\n", b"\n") + fresh[len(whole) :]
        start = 0
        while (end := self.tail.find(b"\n\n", max(start, self.searched))) >= 0:
            yield from self._event(bytes(self.tail[start:end]))
            start = self.searched = end + 2
        del self.tail[:start]
        self.searched = max(0, len(self.tail) - 2)

    def end(self) -> Iterator[tuple[str, str]]:
        """What the body's end brings: the last block, and `done` where there was none."""
        yield from self._event(bytes(self.tail).replace(b"\r\n", b"\n"))
        self.tail.clear()
        if not self.done:
            yield "done", "{}"


@dataclass
class Place:
    """Of one request: the number of the chunk that comes next, the tail so far, its events, and when it counts as stopped."""

    following: int = 0
    tail: str = ""
    events: int = 0
    finished: bool = False
    done: bool = False
    idle_at: int | None = None


class Reassemble(StatefulProcessor):
    """Of a group of requests: their places, and the chunks that came too early, in blocks of BLOCK numbers.

    Each call of the state store is a message to another process, many times what a chunk costs. So the places are one value,
    and a micro-batch reads and writes only blocks that its chunks fall in or whose turn has come. With `idle_ms` a body is at
    its end, too, when the watermark is so far past its last chunk.
    """

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "timer long, blocks string, places string")
        self.early = handle.getMapState("early", "block long", "chunks string")

    def _load(self) -> tuple[int, set[int], dict[str | None, Place]]:
        timer, blocks, places = self.group.get() or (-1, "[]", "[]")
        return timer, set(json.loads(blocks)), {request: Place(*v) for request, *v in json.loads(places)}

    def _save(self, timer: int, blocks: set[int], places: dict[str | None, Place], fired: int = -1) -> None:
        """Keep the places, with one timer for the body that counts as stopped first; one that has `fired` is taken away by Spark."""
        following = min((p.idle_at for p in places.values() if p.idle_at is not None), default=-1)
        if following != timer:
            if timer >= 0 and timer != fired:
                self.handle.deleteTimer(timer)
            if following >= 0:
                self.handle.registerTimer(following)
        self.group.update((following, json.dumps(sorted(blocks)), json.dumps([[request, *vars(p).values()] for request, p in places.items()])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, blocks, places = self._load()
        held: dict[int, dict[tuple, tuple]] = {}  # by block, what is there of (request, number)
        changed, latest, out = set(), {}, []

        def block(n: int) -> dict[tuple, tuple]:
            if n not in held:
                told = json.loads(self.early.getValue((n,))[0]) if n in blocks else []
                held[n] = {(request, number): (chunk, last) for request, number, chunk, last in told}
            return held[n]

        for frame in rows:
            times = frame["at_ms"] if self.idle_ms is not None else repeat(0)
            for request, number, chunk, last, at in zip(frame["request_id"], frame["number"].tolist(), frame["chunk"], frame["last"].tolist(), times):
                place = places.setdefault(request, Place())
                latest[request] = max(latest.get(request, 0), int(at))
                if number >= place.following and not place.finished:  # a chunk that comes again says nothing new
                    block(number // BLOCK)[request, number] = bytes(chunk).decode("latin-1") if chunk is not None else "", bool(last)
                    changed.add(number // BLOCK)
        for request in latest:
            place = places[request]
            framer, found, n = Framer(place.tail.encode("latin-1"), place.done), [], place.following // BLOCK
            while not place.finished and (came := block(n).pop((request, place.following), None)) is not None:
                found += framer.add(came[0].encode("latin-1"))
                changed.add(n)
                place.following += 1
                n = place.following // BLOCK
                if came[1]:
                    found += framer.end()
                    place.finished = True
            self._told(request, place, framer, found, out)
            watermark = timerValues.getCurrentWatermarkInMs() if self.idle_ms is not None else 0
            place.idle_at = None if self.idle_ms is None or place.finished else max(watermark, latest[request]) + self.idle_ms
        for n in changed:
            rest = [[*at, *came] for at, came in held[n].items() if not places[at[0]].finished]
            if rest:
                self.early.updateValue((n,), (json.dumps(rest, ensure_ascii=False),))
                blocks.add(n)
            elif n in blocks:
                self.early.removeKey((n,))
                blocks.remove(n)
        self._save(timer, blocks, places)
        yield from self._rows(out)

    def _told(self, request: str | None, place: Place, framer: Framer, found: list, out: list) -> None:
        out += [(request, place.events + i, *e) for i, e in enumerate(found)]
        place.tail, place.events, place.done = framer.tail.decode("latin-1"), place.events + len(found), framer.done

    def _rows(self, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["request_id", "seq", "event", "data"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Bodies that stopped: what has come in order so far is all there is."""
        timer, blocks, places = self._load()
        now, out, stopped = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), [], set()
        for request, place in places.items():
            if place.idle_at is not None and place.idle_at <= now:
                framer = Framer(place.tail.encode("latin-1"), place.done)
                found = list(framer.end())
                place.finished, place.idle_at = True, None
                self._told(request, place, framer, found, out)
                stopped.add(request)
        for n in sorted(blocks) if stopped else ():
            told = json.loads(self.early.getValue((n,))[0])
            rest = [c for c in told if c[0] not in stopped]
            if rest and len(rest) < len(told):
                self.early.updateValue((n,), (json.dumps(rest, ensure_ascii=False),))
            elif not rest:
                self.early.removeKey((n,))
                blocks.remove(n)
        self._save(timer, blocks, places, expiredTimerInfo.getExpiryTimeInMs())
        yield from self._rows(out)


def reassemble(chunks: DataFrame, delay: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """Events (request_id, seq, event, data) of a stream of chunks (request_id, number, chunk, last).

    `number` counts the chunks of a request from 0; `last` marks the one that ends its body. Chunks may come in any order
    and in any micro-batches, and more than once: the events are those of the body. With `delay` and `idle_ms` (and a column
    `at`, the time of a chunk) a body that stops for so long ends without a last chunk; later chunks of it are left out.
    """
    if (delay is None) != (idle_ms is None):
        raise ValueError("delay and idle_ms go together")
    timed = chunks if delay is None else chunks.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    timed = timed.withColumn("group", F.pmod(F.xxhash64("request_id"), F.lit(GROUPS)).cast("int"))
    return timed.groupBy("group").transformWithStateInPandas(Reassemble(idle_ms), _OUT, "Append", "None" if delay is None else "EventTime")


def rendered(log: DataFrame) -> DataFrame:
    """A log of events (request_id, seq, event, data) as bodies: request_id, body (binary), in order of seq."""
    lines = F.concat(F.lit("event: "), F.col("event"), F.lit("\ndata: "), F.regexp_replace("data", "\n", "\ndata: "), F.lit("\n\n"))
    held = log.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("seq", lines.alias("block")))).alias("blocks"))
    return held.select("request_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "").cast("binary").alias("body"))


def cut(bodies: DataFrame, size: Column) -> DataFrame:
    """Bodies as chunks of `size` bytes each: request_id, number, chunk, last."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / size)).cast("int")
    held = bodies.withColumns({"_size": size, "_count": count}).withColumn("number", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    return held.select("request_id", F.col("number").cast("long").alias("number"), F.substring(F.col("body"), F.col("number") * F.col("_size") + 1, F.col("_size")).alias("chunk"), (F.col("number") == F.col("_count") - 1).alias("last"))
