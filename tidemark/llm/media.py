"""MPEG transport streams in a binary column: writing, reading back, timestamps and features.

A stream here is one programme: a programme association table (PID 0), a programme map table, and one private
elementary stream whose access units are the payload's blocks of samples. Both tables stand before every access unit
and carry the MPEG CRC-32; every packet carries its PID's continuity counter; every access unit starts a packet that
carries a clock reference, a presentation timestamp and the random-access flag, because from there a reader needs
nothing that came before.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from . import common

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID, PROGRAM = 0x100, 0x101, 1
#: Private data in elementary packets.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
CLOCK = 90_000
#: Payloads are padded to a multiple of this; an access unit has up to UNIT such blocks, a second has RATE samples.
BLOCK, UNIT, RATE = 576, 64, 48_000


@functools.lru_cache(maxsize=1)
def _crc_table() -> tuple[int, ...]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return tuple(out)


def mpeg_crc(data: bytes) -> int:
    c, t = 0xFFFFFFFF, _crc_table()
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ t[c >> 24 ^ x]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    n = len(body) + 9
    head = bytes([table_id, 0xB0 | n >> 8, n & 255, ident >> 8, ident & 255, 0xC1, 0, 0]) + body
    return head + mpeg_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    """A packet of one section, with continuity counter 0."""
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


@functools.lru_cache(maxsize=16)
def _tables(counter: int) -> bytes:
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    entry = bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + entry)
    packets = [bytearray(_table_packet(0, pat)), bytearray(_table_packet(PMT_PID, pmt))]
    for p in packets:
        p[3] |= counter
    return b"".join(packets)


def _clock(pts: int) -> bytes:
    """A programme clock reference: 33 bits of 90 kHz, 6 reserved, 9 of 27 MHz, which are 0."""
    return (pts << 15 | 0x7E00).to_bytes(6, "big")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, 1 | pts >> 14 & 254, pts >> 7 & 255, 1 | pts << 1 & 254])


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream. It must be a positive multiple of 576 long."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("a payload is a positive multiple of 576 bytes")
    out, counter = [], 0
    size, high, low = UNIT * BLOCK, DATA_PID >> 8, DATA_PID & 255
    for start in range(0, len(payload), size):
        unit = payload[start : start + size]
        pts = start * CLOCK // RATE & (1 << 33) - 1
        out.append(_tables(start // size & 15))
        pes = bytes([0, 0, 1, STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        at, first = 0, True
        while at < len(pes):
            room = 176 if first else 184
            take = min(room, len(pes) - at)
            stuffing = 184 - take
            if first:
                field_ = bytes([stuffing - 1, 0x50]) + _clock(pts) + b"\xff" * (stuffing - 8)
            else:
                field_ = b"" if not stuffing else b"\0" if stuffing == 1 else bytes([stuffing - 1, 0]) + b"\xff" * (stuffing - 2)
            head = bytes([SYNC, (0x40 if first else 0) | high, low, (0x30 if field_ else 0x10) | counter])
            out.append(head + field_ + pes[at : at + take])
            counter, at, first = counter + 1 & 15, at + take, False
    return b"".join(out)


@dataclass
class Stream:
    """What demux finds. units: (pts in 90 kHz ticks or None, random access, offset in data) for each elementary packet;
    clocks: clock references, in 90 kHz ticks.
    """

    data: bytes = b""
    units: list[tuple[int | None, bool, int]] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)
    packets: int = 0
    counter_errors: int = 0
    table_errors: int = 0
    sync_errors: int = 0


def _sections(payload: bytes) -> bytes | None:
    """The one section that starts in a table's packet, or None if it is cut or its checksum is wrong."""
    s = payload[1 + payload[0] :]
    if len(s) < 3:
        return None
    n = 3 + ((s[1] & 15) << 8 | s[2])
    return s[:n] if len(s) >= n >= 12 and mpeg_crc(s[:n]) == 0 else None


def demux(ts: bytes) -> Stream:
    """Reads the first programme's first elementary stream. Damage is counted, never raised."""
    found, pmt_pid, pid = Stream(), None, None
    last: dict[int, int] = {}
    pes: list[bytes] = []
    kept: list[bytes] = []
    size = 0
    flag = False

    def close() -> None:
        nonlocal size
        if not pes:
            return
        x = b"".join(pes)
        pes.clear()
        if len(x) < 9 or x[:3] != b"\0\0\1":
            found.table_errors += 1
            return
        n, start, pts = x[4] << 8 | x[5], 9 + x[8], None
        if x[7] & 0x80 and len(x) >= 14:
            p = x[9:14]
            pts = (p[0] & 14) << 29 | p[1] << 22 | (p[2] & 254) << 14 | p[3] << 7 | p[4] >> 1
        body = x[start : 6 + n if n else len(x)]
        found.units.append((pts, flag, size))
        kept.append(body)
        size += len(body)

    for at in range(0, len(ts) - PACKET + 1, PACKET):
        if ts[at] != SYNC:
            found.sync_errors += 1
            continue
        found.packets += 1
        b1, b3 = ts[at + 1], ts[at + 3]
        this = (b1 & 31) << 8 | ts[at + 2]
        start, access = at + 4, False
        if b3 & 0x20:
            n = ts[start]
            access = bool(n and ts[start + 1] & 0x40)
            if n >= 7 and ts[start + 1] & 0x10 and this == pid:
                found.clocks.append(int.from_bytes(ts[start + 2 : start + 8], "big") >> 15)
            start += 1 + n
        if not b3 & 0x10:
            continue
        if this in last and b3 & 15 != last[this] + 1 & 15:
            found.counter_errors += 1
        last[this] = b3 & 15
        if this == pid:
            if b1 & 0x40:
                close()
                flag = access
                pes.append(ts[start : at + PACKET])
            elif pes:
                pes.append(ts[start : at + PACKET])
        elif this == 0 or this == pmt_pid:
            section = _sections(ts[start : at + PACKET]) if b1 & 0x40 else None
            if section is None:
                found.table_errors += 1
            elif this == 0:
                for k in range(8, len(section) - 4, 4):
                    if section[k : k + 2] != b"\0\0":
                        pmt_pid = (section[k + 2] & 31) << 8 | section[k + 3]
                        break
            else:
                k = 12 + ((section[10] & 15) << 8 | section[11])
                if k + 5 <= len(section) - 4:
                    pid = (section[k + 1] & 31) << 8 | section[k + 2]
    close()
    found.sync_errors += bool(len(ts) % PACKET)
    found.data = b"".join(kept)
    return found


def pad(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of 576."""
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b"\xff")


def write_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each text's padded UTF-8 as a transport stream. A null text counts as empty.

    Repeated rows and null ids give a row each, an empty table none; other columns are left out.
    """

    def run(x: dict[str, list]) -> dict[str, list]:
        raw = [common.utf8(t) for t in x[text_col]]
        return {"id": x[id_col], "n_bytes": [len(r) for r in raw], "media": [mux(pad(r)) for r in raw]}

    return common.map_batches(docs.select(id_col, text_col), f"{common.ddl(docs, id_col, 'id')}, n_bytes long, media binary", run)


#: Of read_streams. units: each elementary packet's timestamp, random-access flag and offset in the payload.
READ = (
    "payload binary, units array<struct<pts:long,random_access:boolean,at:long>>, clocks array<long>, packets long,"
    " counter_errors long, table_errors long, sync_errors long, mean double, deviation double, distinct_samples long"
)


def read_streams(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with the columns READ: payload, units and damage of each stream, and its samples' mean, standard deviation
    and number of different values. A null or damaged stream gives what can be read, never an error.
    """
    from pyspark.sql.types import StructType

    clash = {f.name for f in StructType.fromDDL(READ)} & set(media.columns)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    schema = ", ".join([*(common.ddl(media, c) for c in media.columns), READ])

    def run(x: dict[str, list]) -> dict[str, list]:
        found = [demux(m or b"") for m in x[media_col]]
        counts = [np.bincount(np.frombuffer(f.data, np.uint8), minlength=256) for f in found]
        levels = np.arange(256)
        means = [float(c @ levels / c.sum()) if c.sum() else 0.0 for c in counts]
        return x | {
            "payload": [f.data for f in found],
            "units": [[{"pts": p, "random_access": r, "at": a} for p, r, a in f.units] for f in found],
            "clocks": [f.clocks for f in found],
            "packets": [f.packets for f in found],
            "counter_errors": [f.counter_errors for f in found],
            "table_errors": [f.table_errors for f in found],
            "sync_errors": [f.sync_errors for f in found],
            "mean": means,
            "deviation": [
                float(np.sqrt(c @ (levels - m) ** 2 / c.sum())) if c.sum() else 0.0 for c, m in zip(counts, means, strict=True)
            ],
            "distinct_samples": [int((c > 0).sum()) for c in counts],
        }

    return common.map_batches(media, schema, run)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def tail_crc(data: bytes) -> int:
    return zlib.crc32(data[-32:])
