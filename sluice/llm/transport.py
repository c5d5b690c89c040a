"""Media columns as MPEG transport streams.

write() packs a binary column of 8-bit samples, one row a stream: program association and
program map tables and a clock reference at every access unit, each unit one packetised
elementary packet with its presentation time and marked as a random-access point.
read() takes any such column apart again: it finds the program by the tables (checking
their CRC), checks the continuity counters, reassembles the elementary packets, and
returns the samples with an index of timestamps, offsets and random-access points.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm.common import bounded_batches, held, tidy

#: Fixed values of the format.
PACKET, SYNC, CLOCK, WRAP = 188, 0x47, 90_000, 1 << 33
PAT_PID, PMT_PID, DATA_PID, PRIVATE_DATA, PRIVATE_STREAM = 0x0000, 0x1000, 0x0100, 0x06, 0xBD

#: Samples of an access unit, and samples a second: a frame of 192 samples is 2160 ticks.
UNIT, RATE = 64 * 192, 8000
START = CLOCK  # time of the first sample


def _table() -> list[int]:
    out = []
    for i in range(256):
        r = i << 24
        for _ in range(8):
            r = (r << 1) ^ (0x04C11DB7 if r & 0x80000000 else 0)
        out.append(r & 0xFFFFFFFF)
    return out


_CRC = _table()


def crc(data: bytes) -> int:
    """CRC-32 as the tables' sections have it (no reflection); 0 over a section with its CRC."""
    r = 0xFFFFFFFF
    for b in data:
        r = ((r << 8) & 0xFFFFFFFF) ^ _CRC[(r >> 24) ^ b]
    return r


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc(head + body))


PAT = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
PMT = _section(2, 1, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_DATA, 0xE000 | DATA_PID, 0xF000))


def _stamp(ticks: int) -> bytes:
    t = ticks % WRAP
    return bytes((0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 0x01 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 0x01 | (t << 1) & 0xFE))


def _ticks(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def mux(samples: bytes) -> bytes:
    """One program with one elementary stream; no samples give the tables alone."""
    out, tables, count = [], 0, 0
    filler = b"\xff" * PACKET
    for at in range(0, max(1, len(samples)), UNIT):
        for pid, section in ((PAT_PID, PAT), (PMT_PID, PMT)):
            out.append((struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10 | tables & 15, 0) + section + filler)[:PACKET])
        tables += 1
        unit = samples[at : at + UNIT]
        if not unit:
            break
        time = START + at * CLOCK // RATE
        pes = b"\0\0\1" + struct.pack(">BHBBB", PRIVATE_STREAM, len(unit) + 8, 0x84, 0x80, 5) + _stamp(time) + unit
        clock = (time - CLOCK) % WRAP
        field = bytes((0x50,)) + (clock << 15 | 0x7E00).to_bytes(6, "big")
        first = min(PACKET - 5 - len(field), len(pes))
        field += filler[: PACKET - 5 - len(field) - first]
        out.append(struct.pack(">BHBB", SYNC, 0x4000 | DATA_PID, 0x30 | count & 15, len(field)) + field + pes[:first])
        count += 1
        room, head = PACKET - 4, struct.pack(">BH", SYNC, DATA_PID)
        whole = first + (len(pes) - first) // room * room
        for p in range(first, whole, room):
            out.append(head + bytes((0x10 | count & 15,)) + pes[p : p + room])
            count += 1
        if rest := pes[whole:]:
            pad = room - len(rest) - 1
            field = (b"\0" + filler)[:pad] if pad else b""
            out.append(head + bytes((0x30 | count & 15, pad)) + field + rest)
            count += 1
    return b"".join(out)


class Demuxer:
    """Takes one stream apart; damage of any kind is counted, never raised."""

    def __init__(self):
        self.program = self.pid = self.kind = -1
        self.map_pid = -1
        self.packets = self.gaps = self.bad_tables = self.lost_sync = 0
        self.last: dict[int, int] = {}
        self.parts: list[bytes] = []
        self.open: list[bytes] | None = None
        self.entry = False
        self.size = 0
        self.units: list[tuple[int, int, bool]] = []

    def feed(self, data: bytes) -> "Demuxer":
        at, n = 0, len(data)
        while at + PACKET <= n:
            if data[at] != SYNC:
                self.lost_sync += 1
                at = data.find(b"\x47", at + 1)
                if at < 0:
                    break
                continue
            self._packet(data, at)
            at += PACKET
        self._close()
        return self

    def _packet(self, data: bytes, at: int) -> None:
        self.packets += 1
        b1, flags = data[at + 1], data[at + 3]
        pid, begins = (b1 & 0x1F) << 8 | data[at + 2], b1 & 0x40
        if not flags & 0x10 or b1 & 0x80:  # no payload, or marked as damaged
            return
        seen = self.last.get(pid)
        if seen is not None and (flags & 15) != (seen + 1) & 15:
            if (flags & 15) == seen:
                return  # a repeated packet
            self.gaps += 1
            if pid == self.pid:
                self.open = None
        self.last[pid] = flags & 15
        start, entry = at + 4, False
        if flags & 0x20:
            size = data[start]
            entry = bool(size and data[start + 1] & 0x40)
            start += 1 + size
        body = data[start : at + PACKET]  # empty where the field is longer than the packet
        if pid == self.pid:
            if begins:
                self._close()
                self.open, self.entry = [body], entry
            elif self.open is not None:
                self.open.append(body)
        elif pid == PAT_PID or pid == self.map_pid:
            self._section(pid, body)

    def _section(self, pid: int, body: bytes) -> None:
        body = body[1 + body[0] :] if body else b""
        size = 3 + ((body[1] & 0x0F) << 8 | body[2]) if len(body) > 2 else 0
        if len(body) < size or size < 12:  # shorter than any table, or cut off
            self.bad_tables += 1
            return
        body = body[:size]
        if body == PAT and self.map_pid == PMT_PID or body == PMT and self.pid == DATA_PID:
            return  # the same table again
        if crc(body):
            self.bad_tables += 1
        elif pid == PAT_PID:
            for i in range(8, size - 4, 4):
                number, where = struct.unpack(">HH", body[i : i + 4])
                if number:
                    self.program, self.map_pid = number, where & 0x1FFF
                    break
        else:
            i = 12 + ((body[10] & 0x0F) << 8 | body[11])
            if i + 5 <= size - 4:
                self.kind, self.pid = body[i], (body[i + 1] & 0x1F) << 8 | body[i + 2]

    def _close(self) -> None:
        if not self.open:
            return
        pes, self.open = b"".join(self.open), None
        if pes[:3] != b"\0\0\1" or len(pes) < 9:
            return
        length = pes[4] << 8 | pes[5]
        data = pes[9 + pes[8] : 6 + length if length else None]
        if length and len(pes) < 6 + length:
            self.gaps += 1  # cut off
            return
        time = _ticks(pes[9:14]) if pes[7] & 0x80 and pes[8] >= 5 and len(pes) >= 14 else -1
        if self.units and time >= 0:  # beyond the wrap of 33 bits
            time += max(0, -(-(self.units[-1][0] - WRAP // 2 - time) // WRAP)) * WRAP
        self.units.append((time, self.size, self.entry))
        self.parts.append(data)
        self.size += len(data)


def write(df: DataFrame, key: str = "doc_id", samples: str = "samples", media: str = "media", carry: tuple[str, ...] = ()) -> DataFrame:
    """Key, the carried small columns and the stream of each row.

    Null samples count as none; repeated rows and null keys give a row each; an empty table gives
    no rows; samples of any length make one stream; columns that aren't named are not carried.
    """
    bounded_batches(df.sparkSession)
    schema = ", ".join([f"`{n}` {df.schema[n].dataType.simpleString()}" for n in (key, *carry)] + [f"`{media}` binary"])

    def run(batches):
        held("transport")
        for b in batches:
            out = [mux(x or b"") for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names=[key, *carry, media])

    return df.select(key, *carry, samples).mapInArrow(tidy(run), schema)


UNITS = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("random_access", pa.bool_())]))
FOUND = "program int, pid int, stream_type int, packets bigint, gaps bigint, bad_tables bigint, lost_sync bigint"


def read(df: DataFrame, key: str = "doc_id", media: str = "media", samples: str = "samples", carry: tuple[str, ...] = ()) -> DataFrame:
    """Key, carried columns, samples, units (pts, offset, random_access), what the tables said, the
    damage counted, and the samples' mean and root mean square.

    Null or damaged media give what is left, and never an error. Repeated rows and null keys give a
    row each; an empty table gives no rows; streams of any length are read whole. A carried column
    whose name is one of the results' raises ValueError.
    """
    if clash := {c.lower() for c in (key, *carry)} & {c.lower() for c in (samples, "units", "level", "rms", *(x.split()[0] for x in FOUND.split(", ")))}:
        raise ValueError(f"carried columns clash with the results': {sorted(clash)}")
    bounded_batches(df.sparkSession)
    schema = ", ".join([f"`{n}` {df.schema[n].dataType.simpleString()}" for n in (key, *carry)] + [f"`{samples}` binary, units array<struct<pts:bigint,offset:bigint,random_access:boolean>>, {FOUND}, level double, rms double"])
    fixed = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches):
        for b in batches:
            got = [Demuxer().feed(x or b"") for x in b.column(b.num_columns - 1).to_pylist()]
            data = [b"".join(d.parts) for d in got]
            units = [[{"pts": t, "offset": o, "random_access": r} for t, o, r in d.units] for d in got]
            level, rms = [], []
            for x in data:
                a = np.frombuffer(x, np.uint8).astype(np.int64)
                level.append(float(a.sum()) / max(1, len(a)))
                rms.append((float(a @ a) / max(1, len(a))) ** 0.5)
            ints = [(d.program, d.pid, d.kind, d.packets, d.gaps, d.bad_tables, d.lost_sync) for d in got]
            cols = [pa.array([x[i] for x in ints], pa.int32() if i < 3 else pa.int64()) for i in range(len(fixed))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(data, pa.binary()), pa.array(units, UNITS), *cols, pa.array(level, pa.float64()), pa.array(rms, pa.float64())],
                names=[key, *carry, samples, "units", *fixed, "level", "rms"],
            )

    return df.select(key, *carry, media).mapInArrow(tidy(run), schema)
