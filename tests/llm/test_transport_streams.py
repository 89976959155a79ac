"""Transport streams read by another parser, packet by packet as the standard lays them out."""

import random

from pyspark.sql import functions as F
from test_llm_operators import documents

from tessera.llm import transport_stream


def crc(data):
    """The tables' checksum, bit by bit."""
    c = 0xFFFFFFFF
    for byte in data:
        for bit in range(7, -1, -1):
            top = c >> 31 ^ byte >> bit & 1
            c = c << 1 & 0xFFFFFFFF
            if top:
                c ^= 0x04C11DB7
    return c


def packets(stream):
    """(pid, unit start, counter, adaptation field or None, payload) of each packet."""
    assert len(stream) % 188 == 0
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47 and not p[1] & 0x80
        control, rest, field = p[3] >> 4 & 3, p[4:], None
        if control & 2:
            field, rest = rest[1 : 1 + rest[0]], rest[1 + rest[0] :]
        yield (p[1] & 0x1F) << 8 | p[2], bool(p[1] & 0x40), p[3] & 15, field, rest if control & 1 else b""


def section(payload):
    start = 1 + payload[0]
    length = (payload[start + 1] & 15) << 8 | payload[start + 2]
    held = payload[start : start + 3 + length]
    assert crc(held) == 0
    return held[0], held[8:-4]


def parsed(stream):
    """(payload, presentation times, packets that are access points) by program tables and packetised elementary stream."""
    program, elementary, units, counters, access = None, None, [], {}, []
    for n, (pid, begins, counter, field, payload) in enumerate(packets(stream)):
        if payload:
            assert counter == counters.get(pid, counter)
            counters[pid] = (counter + 1) % 16
        if pid == 0:
            table, body = section(payload)
            assert table == 0
            program = int.from_bytes(body[2:4], "big") & 0x1FFF
        elif pid == program:
            table, body = section(payload)
            assert table == 2
            skip = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
            elementary = int.from_bytes(body[skip + 1 : skip + 3], "big") & 0x1FFF
        elif pid == elementary:
            if begins:
                units.append(b"")
            units[-1] += payload
            if field and field[0] & 0x40:
                access.append(n)
    out, times = b"", []
    for u in units:
        assert u[:3] == b"\0\0\1" and u[7] & 0x80
        length, t = int.from_bytes(u[4:6], "big"), u[9:14]
        times.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
        assert length == 0 or length == len(u) - 6
        out += u[9 + u[8] :]
    return out, times, access


def test_streams_are_what_the_standard_says():
    rng = random.Random(1)
    for frames in (1, 2, 4, 5, 17, 64):
        payload = rng.randbytes(576 * frames)
        data, times, access = parsed(transport_stream.mux(payload))
        assert data == payload and times == sorted(times) and len(access) >= 1
        own = transport_stream.demux(transport_stream.mux(payload))
        assert own.payload == payload


def test_long_texts_and_other_columns(spark):
    text = "née und " * 120_000
    docs = documents(spark, text, None).withColumns({c: F.lit("x") for c in ("media", "feature", "stamps", "payload")})
    rows = {r["doc_id"]: r for r in transport_stream.media_column(docs).collect()}
    data = text.encode()
    assert parsed(bytes(rows[0]["media"]))[0] == data + b"\xff" * (-len(data) % 576)
    assert rows[0]["n_bytes"] == len(data) and rows[1]["payload_bytes"] == 576
    assert parsed(bytes(rows[1]["media"]))[0] == b"\xff" * 576
