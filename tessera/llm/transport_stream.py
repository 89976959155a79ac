"""Media columns: texts as MPEG transport streams of 8-bit samples, written and parsed again with numpy.

A stream has one program (PAT, PMT) with one elementary stream. Samples travel in PES packets with timestamps;
each PES packet begins a transport packet with a clock reference, and every few of them is a random-access point.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_slices

# Fixed values of the format.
PACKET, SYNC, CLOCK = 188, 0x47, 90_000
PROGRAM, PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID = 1, 0x1000, 0x0100, 0x06, 0xBD
PES_HEADER = 14

#: Payloads are padded to a positive multiple of this many samples, and a PES packet carries some such frames.
FRAME, FRAMES_PER_PES, PES_PER_ACCESS_POINT, SAMPLE_RATE = 576, 4, 4, 8000
PAD = b"\xff"


@lru_cache(maxsize=1)
def _crc_table() -> tuple[int, ...]:
    table = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return tuple(table)


@lru_cache(maxsize=64)
def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _crc_table()[c >> 24 ^ b]
    return c


def _section_packet(pid: int, table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | 5 + len(body) + 4).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    section = head + body
    section += crc_mpeg(section).to_bytes(4, "big")
    packet = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section
    return packet.ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def program_tables() -> bytes:
    """The packets of the program association table and of the program map table."""
    pat = PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")
    pmt = (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
    return _section_packet(0, 0, 1, pat) + _section_packet(PMT_PID, 2, PROGRAM, pmt)


@lru_cache(maxsize=16)
def _layout(size: int) -> tuple[np.ndarray, np.ndarray]:
    """For a PES packet of `size` bytes in all: its transport packets without data, and the places of its bytes."""
    packets, places, left = [], [], size
    while left or not packets:
        p = bytearray(PACKET)
        p[0], p[1], p[2] = SYNC, (0x40 if not packets else 0) | ES_PID >> 8, ES_PID & 255
        field_ = bytes([0x10, 0, 0, 0, 0, 0, 0]) if not packets else b""  # flags and clock reference
        room = PACKET - 4 - (1 + len(field_) if field_ else 0)
        if left < room:  # stuffing, with at least the byte that tells the length
            short = room - left
            if not field_:
                field_ = b"" if short == 1 else b"\x00" + b"\xff" * (short - 2)
                stuffed = 1 + len(field_)
            else:
                field_ += b"\xff" * short
                stuffed = 1 + len(field_)
        else:
            stuffed = 1 + len(field_) if field_ else 0
        p[3] = 0x30 if stuffed else 0x10
        if stuffed:
            p[4] = len(field_)
            p[5 : 5 + len(field_)] = field_
        start = 4 + stuffed
        take = PACKET - start
        places.append(np.arange(start, PACKET) + PACKET * len(packets))
        packets.append(bytes(p))
        left -= take
    return np.frombuffer(b"".join(packets), np.uint8), np.concatenate(places)


def _stamps(k: np.ndarray) -> np.ndarray:
    """Presentation times (90 kHz, modulo 2^33) of the k-th PES packets."""
    return k * (FRAME * FRAMES_PER_PES * CLOCK // SAMPLE_RATE) % (1 << 33)


def _pes(payload: np.ndarray, first: int) -> np.ndarray:
    """PES packets, a row each, of rows of payload; `first` is the number of the first."""
    n, size = payload.shape
    out = np.empty((n, PES_HEADER + size), np.uint8)
    t = _stamps(first + np.arange(n, dtype=np.int64))
    length = PES_HEADER - 6 + size
    out[:, :9] = [0, 0, 1, STREAM_ID, length >> 8, length & 255, 0x80, 0x80, 5]
    for i, b in enumerate((0x21 | t >> 29 & 0x0E, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1)):
        out[:, 9 + i] = b
    out[:, PES_HEADER:] = payload
    return out


def mux(payload: bytes) -> bytes:
    """The transport stream that holds a payload (a multiple of FRAME bytes)."""
    data = np.frombuffer(payload, np.uint8)
    full = FRAME * FRAMES_PER_PES
    n = len(data) // full
    parts = [(data[: n * full].reshape(n, full), 0)] if n else []
    if len(data) % full:
        parts.append((data[n * full :].reshape(1, -1), n))
    streams = []
    for rows, first in parts:
        frame, places = _layout(PES_HEADER + rows.shape[1])
        out = np.tile(frame, (len(rows), 1))
        out[:, places] = _pes(rows, first)
        k = first + np.arange(len(rows), dtype=np.int64)
        base = _stamps(k)
        out[:, 5] |= np.where(k % PES_PER_ACCESS_POINT == 0, 0x40, 0).astype(np.uint8)
        for i, b in enumerate((base >> 25, base >> 17, base >> 9, base >> 1, (base & 1) << 7 | 0x7E)):
            out[:, 6 + i] = (b & 255).astype(np.uint8)
        streams.append(out.reshape(-1, PACKET))
    packets = np.concatenate(streams)
    packets[:, 3] |= (np.arange(len(packets)) & 15).astype(np.uint8)
    return program_tables() + packets.tobytes()


@dataclass
class Stream:
    """What a transport stream holds: programs, and of the first elementary stream its payload and marks."""

    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    payload: bytes = b""
    stamps: list[int] = field(default_factory=list)
    access_points: list[tuple[int, int]] = field(default_factory=list)  # presentation time, byte offset in the stream
    packets: int = 0
    pes_packets: int = 0
    continuity_errors: int = 0
    clock_references: int = 0


def _sections(packets: np.ndarray, start: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Whole sections with a good checksum, out of the packets of one PID."""
    found, held = [], b""
    for p, s, begins in zip(packets, start.tolist(), first.tolist(), strict=True):
        body = p[s:].tobytes()
        if begins:
            body = body[1 + body[0] :]
            held = b""
        elif not held:
            continue
        held += body
        if len(held) >= 3 and len(held) >= (size := 3 + (int.from_bytes(held[1:3], "big") & 0x0FFF)):
            if crc_mpeg(held[:size]) == 0:
                found.append(held[:size])
            held = b""
    return found


def demux(data: bytes) -> Stream:
    """Parse a transport stream.

    Packets that repeat the one before (same counter and bytes) are dropped; other jumps of the continuity counter
    are counted unless the packet says so. Raises ValueError where packets are out of step or there is no program.
    """
    p = np.frombuffer(data, np.uint8)
    if len(p) % PACKET or not len(p) or (p[::PACKET] != SYNC).any():
        raise ValueError("no transport stream in packets of 188 bytes")
    p = p.reshape(-1, PACKET)
    out = Stream(packets=len(p))
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    first, kind, counter = (p[:, 1] & 0x40) != 0, p[:, 3] >> 4 & 3, p[:, 3] & 15
    extra = np.where(kind & 2, 1 + p[:, 4].astype(np.int32), 0)
    start = 4 + extra
    flags = np.where((kind & 2 != 0) & (p[:, 4] > 0), p[:, 5], 0)
    of = lambda n: (pid == n) & (kind & 1 != 0)
    for s in _sections(p[of(0)], start[of(0)], first[of(0)]):
        for i in range(8, len(s) - 4, 4):
            if number := int.from_bytes(s[i : i + 2], "big"):
                map_pid = int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
                for m in _sections(p[of(map_pid)], start[of(map_pid)], first[of(map_pid)]):
                    at, streams = 12 + (int.from_bytes(m[10:12], "big") & 0x0FFF), {}
                    while at < len(m) - 4:
                        streams[int.from_bytes(m[at + 1 : at + 3], "big") & 0x1FFF] = m[at]
                        at += 5 + (int.from_bytes(m[at + 3 : at + 5], "big") & 0x0FFF)
                    out.programs[number] = streams
    if not any(out.programs.values()):
        raise ValueError("no program with an elementary stream")
    es = next(e for streams in out.programs.values() for e in streams)
    at = np.flatnonzero(of(es))
    step = (counter[at[1:]].astype(np.int32) - counter[at[:-1]]) & 15
    same = np.append(False, (step == 0) & (p[at[1:]] == p[at[:-1]]).all(1)) if len(at) else np.zeros(0, bool)
    jump = np.append(False, (step != 1) & ((flags[at[1:]] & 0x80) == 0))[: len(at)] & ~same
    out.continuity_errors = int(jump.sum())
    at = at[~same]
    rows = p[at]
    data_ = rows[np.arange(PACKET) >= start[at, None]]
    ends = np.cumsum(PACKET - start[at])
    begin = np.append(0, ends)[:-1][first[at]]
    opened = at[first[at]]
    random_access = (flags[opened] & 0x40) != 0
    out.clock_references = int(((flags[at] & 0x10) != 0).sum())
    held = data_.tobytes()
    pieces = []
    for a, b, packet, marks in zip(begin.tolist(), [*begin[1:].tolist(), len(held)], opened.tolist(), random_access.tolist(), strict=True):
        if held[a : a + 3] != b"\x00\x00\x01":
            out.continuity_errors += 1
            continue
        size, body = int.from_bytes(held[a + 4 : a + 6], "big"), a + 9 + held[a + 8]
        pieces.append(held[body : min(b, a + 6 + size) if size else b])
        out.pes_packets += 1
        if held[a + 7] & 0x80:
            t = held[a + 9 : a + 14]
            stamp = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
            out.stamps.append(stamp)
            if marks:
                out.access_points.append((stamp, packet * PACKET))
    out.payload = b"".join(pieces)
    return out


def padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + PAD * (-len(data) % FRAME if data else FRAME)


def feature(s: Stream) -> str:
    """A short description of a parsed stream, its samples' mean and deviation included."""
    x = np.frombuffer(s.payload, np.uint8)
    mean = float(x.mean()) if len(x) else 0.0
    deviation = float(x.std()) if len(x) else 0.0
    return (
        f"packets={s.packets};pes={s.pes_packets};errors={s.continuity_errors};pcr={s.clock_references};"
        f"first={s.stamps[0] if s.stamps else -1};last={s.stamps[-1] if s.stamps else -1};access={len(s.access_points)};"
        f"seconds={len(x) / SAMPLE_RATE:.3f};mean={mean:.3f};deviation={deviation:.3f}"
    )


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """Store every whole text as a transport stream, read it back, and describe what was read.

    Returns key, n_bytes (of the text in UTF-8), payload_bytes, payload_sha256 and tail_crc32 (of the last 32
    bytes) of the payload read back, media_bytes and media_sha256 of the stored form, feature, stamps (array of
    presentation times) and access_points (array of time and byte offset); with `keep_media` the stream itself
    as media. The payload is the text padded with bytes 255 to a positive multiple of 576; a null text counts as
    empty. Equal texts give equal values. Repeated rows are stored each, a null key is passed on, other columns
    are not read, and an empty table gives an empty result.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "stamps", "access_points"]
    point = pa.struct([("stamp", pa.int64()), ("offset", pa.int64())])

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, media = [], []
            for t in batch.column(1).to_pylist():
                stored = mux(padded(t))
                s = demux(stored)
                media.append(stored)
                rows.append((len((t or "").encode()), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(s), s.stamps, [{"stamp": a, "offset": b} for a, b in s.access_points]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(point))
            columns = [batch.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
            return pa.RecordBatch.from_arrays(columns + ([pa.array(media, pa.binary())] if keep_media else []), names=names + (["media"] if keep_media else []))

        return step

    schema = (
        f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "feature string, stamps array<long>, access_points array<struct<stamp:long,offset:long>>" + (", media binary" if keep_media else "")
    )
    return map_slices(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), work, schema).withColumnRenamed("key", key)
