"""Media columns: MPEG transport streams.

``mux`` stores bytes losslessly as a private PES stream in 188-byte packets: program tables (PAT, PMT) first, then
PES packets of ``PES_BYTES`` with presentation timestamps, a clock reference and a random-access mark on every
``RANDOM_EVERY``-th. ``demux`` reads any such stream: it parses the tables, checks each PID's continuity counter,
drops permitted duplicate packets, reassembles the elementary packets and lists each with its timestamp, its
random-access mark and its place in the elementary data.

Edge cases: null bytes are empty; the empty payload still gives tables and, if ``mux`` is given no bytes, no PES.
Bytes that aren't whole packets with sync bytes raise ``ValueError``. Equal bytes give equal streams.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import arrow_stage

PACKET, BODY, SYNC = 188, 184, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM, PRIVATE_PES, PRIVATE_ID = 0x0000, 0x1000, 0x0100, 1, 0x06, 0xBD
PES_BYTES, PES_TICKS, RANDOM_EVERY = 32_768, 3_600, 8


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc_mpeg2(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), ext, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc_mpeg2(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_PES, 0xE000 | DATA_PID, 0xF000))
)


def _timestamp(mark: int, t: int) -> bytes:
    return bytes(((mark << 4) | (t >> 29 & 0xE) | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1))


def mux(data: bytes) -> bytes:
    """The transport stream of ``data``."""
    out, cc = [np.frombuffer(TABLES, np.uint8)], 0
    for k, at in enumerate(range(0, len(data), PES_BYTES)):
        part, t = data[at : at + PES_BYTES], k * PES_TICKS
        pes = np.frombuffer(struct.pack(">IHBBB", 0x100 | PRIVATE_ID, len(part) + 8, 0x84, 0x80, 5) + _timestamp(2, t) + part, np.uint8)
        n = max(1, -(-(len(pes) + 8) // BODY))  # the first packet gives 8 bytes to the clock reference
        p = np.empty((n, PACKET), np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        p[:, 3] = 0x10 | ((cc + np.arange(n)) & 15)
        cc = (cc + n) & 15
        p[0, 1] |= 0x40
        p[0, 3] |= 0x20
        spare = n * BODY - 8 - len(pes)  # stuffing: in the first packet's field if it is the only one, else the last's
        flags = 0x10 | (0x40 if k % RANDOM_EVERY == 0 else 0)
        clock = bytes((7 + (spare if n == 1 else 0), flags)) + struct.pack(">IBB", t >> 1 & 0xFFFFFFFF, (t & 1) << 7 | 0x7E, 0)
        head = np.frombuffer(clock + b"\xff" * (spare if n == 1 else 0), np.uint8)
        p[0, 4 : 4 + len(head)] = head
        p[0, 4 + len(head) :] = pes[: BODY - len(head)]
        rest = pes[BODY - len(head) :]
        if n > 1:
            full = n - 2
            p[1 : 1 + full, 4:] = rest[: full * BODY].reshape(full, BODY)
            last = rest[full * BODY :]
            if spare:
                p[-1, 3] |= 0x20
                p[-1, 4] = spare - 1
                if spare > 1:
                    p[-1, 5] = 0
                    p[-1, 6 : 4 + spare] = 0xFF
            p[-1, 4 + spare :] = last
        out.append(p.reshape(-1))
    return np.concatenate(out).tobytes()


@dataclass
class Stream:
    """One elementary stream."""

    program: int
    pid: int
    stream_type: int
    data: bytes = b""
    #: (timestamp or -1, random access, offset in data, size) of each PES packet
    units: list[tuple[int, bool, int, int]] = field(default_factory=list)
    continuity_errors: int = 0
    duplicates: int = 0


def _sections(packets: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Whole sections of one PID's packets with the right CRC."""
    out, buf = [], b""
    for p, o in zip(packets, offsets, strict=True):
        body = p[o:].tobytes()
        if p[1] & 0x40:
            body = body[1 + body[0] :] if body else b""
            buf = b""
        buf += body
        while len(buf) >= 3 and buf[0] != 0xFF:
            n = 3 + (struct.unpack(">H", buf[1:3])[0] & 0xFFF)
            if len(buf) < n:
                break
            if crc_mpeg2(buf[:n]) == 0:
                out.append(buf[:n])
            buf = buf[n:]
    return out


def demux(ts: bytes) -> list[Stream]:
    """The elementary streams of every program of a transport stream."""
    if len(ts) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(ts, np.uint8).reshape(-1, PACKET)
    if len(p) and (p[:, 0] != SYNC).any():
        raise ValueError("sync byte missing")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    field_len = np.where(p[:, 3] & 0x20, p[:, 4].astype(np.int32) + 1, 0)
    offset = np.where(p[:, 3] & 0x10, np.minimum(4 + field_len, PACKET), PACKET)
    clean = (p[:, 1] & 0x80) == 0

    def of(x: int) -> np.ndarray:
        return np.flatnonzero((pid == x) & clean)

    streams: list[Stream] = []
    for pat in _sections(p[i := of(PAT_PID)], offset[i]):
        for program, pmt in struct.iter_unpack(">HH", pat[8:-4]):
            if program == 0:
                continue
            for s in _sections(p[j := of(pmt & 0x1FFF)], offset[j]):
                at = 12 + (struct.unpack(">H", s[10:12])[0] & 0xFFF)
                while at < len(s) - 4:
                    kind, es, info = struct.unpack(">BHH", s[at : at + 5])
                    at += 5 + (info & 0xFFF)
                    if not any((x.program, x.pid) == (program, es & 0x1FFF) for x in streams):
                        streams.append(Stream(program, es & 0x1FFF, kind))
    for s in streams:
        i = of(s.pid)
        i = i[(p[i, 3] & 0x10) > 0]
        if not len(i):
            continue
        cc = p[i, 3] & 15
        same = np.concatenate([[False], (cc[1:] == cc[:-1]) & (p[i[1:]] == p[i[:-1]]).all(axis=1)])
        s.duplicates = int(same.sum())
        i, cc = i[~same], cc[~same]
        signalled = (p[i, 3] & 0x20 > 0) & (p[i, 4] > 0) & (p[i, 5] & 0x80 > 0)
        s.continuity_errors = int((((cc[1:] - cc[:-1]) & 15 != 1) & ~signalled[1:]).sum())
        first, o = np.flatnonzero(p[i, 1] & 0x40), offset[i]
        if not len(first):
            continue
        if first[0]:  # a tail whose start was lost
            i, o, first = i[first[0] :], o[first[0] :], first - first[0]
        body = p[i][np.arange(PACKET) >= o[:, None]]
        ends = np.concatenate([[0], np.cumsum(PACKET - o)])
        starts = ends[first].tolist() + [int(ends[-1])]
        parts, size = [], 0
        for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            pes = body[a:b].tobytes()
            if len(pes) < 9 or pes[:3] != b"\0\0\1":
                continue
            n, t = struct.unpack(">H", pes[4:6])[0], -1
            if pes[7] & 0x80 and len(pes) >= 14:
                x = pes[9:14]
                t = (x[0] >> 1 & 7) << 30 | x[1] << 22 | x[2] >> 1 << 15 | x[3] << 7 | x[4] >> 1
            parts.append(pes[9 + pes[8] : 6 + n if n else None])
            q = p[i[first[k]]]
            s.units.append((t, bool(q[3] & 0x20 and q[4] and q[5] & 0x40), size, len(parts[-1])))
            size += len(parts[-1])
        s.data = b"".join(parts)
    return streams


def pad64(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def store(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, n_bytes, media): each row's text or binary, padded to 64, as a transport stream."""

    def run(b: pa.RecordBatch) -> dict:
        raw = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
        return {key: b.column(0), "n_bytes": [len(x) for x in raw], "media": [mux(pad64(x)) for x in raw]}

    kind = df.schema[key].dataType.simpleString()
    return arrow_stage(df.select(F.col(key), F.col(content)), run, f"`{key}` {kind}, n_bytes bigint, media binary")


UNITS = "array<struct<program:int,pid:int,pts:bigint,random_access:boolean,offset:bigint,size:bigint>>"


def read(df: DataFrame, key: str, keep: str = "n_bytes") -> DataFrame:
    """(key, keep, media, payload, units, continuity_errors) of rows with a ``media`` column."""

    def run(b: pa.RecordBatch) -> dict:
        got = [demux(x or b"") for x in b.column(2).to_pylist()]
        units = [[{"program": s.program, "pid": s.pid, "pts": t, "random_access": r, "offset": o, "size": n} for s in ss for t, r, o, n in s.units] for ss in got]
        return {key: b.column(0), keep: b.column(1), "media": b.column(2), "payload": [b"".join(s.data for s in ss) for ss in got], "units": units, "continuity_errors": [sum(s.continuity_errors for s in ss) for ss in got]}

    kinds = [df.schema[c].dataType.simpleString() for c in (key, keep)]
    return arrow_stage(df.select(key, keep, "media"), run, f"`{key}` {kinds[0]}, `{keep}` {kinds[1]}, media binary, payload binary, units {UNITS}, continuity_errors int")
