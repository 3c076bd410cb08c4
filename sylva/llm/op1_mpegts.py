"""MPEG transport streams: writing payloads into packets, reading them back, and tables of what they hold."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID, PRIVATE_DATA, PRIVATE_STREAM = 0x100, 0x101, 0x06, 0xBD
#: Payload bytes of an access unit, ticks of 90 kHz between two, and units between two program tables.
UNIT, TICKS, TABLES_EVERY = 32_768, 3600, 16
_CRC = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = (_c << 1 ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC.append(_c)


@lru_cache(4096)
def section_crc(data: bytes) -> int:
    """CRC-32 of program-specific sections; 0 over a section with its own CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


PAT = _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
PMT = _section(2, 1, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, PRIVATE_DATA, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]))


def _table_packet(pid: int, counter: int, section: bytes) -> np.ndarray:
    out = np.full(PACKET, 255, np.uint8)
    out[:5] = (SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0)
    out[5 : 5 + len(section)] = np.frombuffer(section, np.uint8)
    return out


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def _unit_packets(data: np.ndarray, pts: int, counter: int) -> np.ndarray:
    """An elementary packet over transport packets: the first with clock and random-access mark, the last stuffed."""
    size = len(data) + 8
    pes = np.concatenate([np.frombuffer(b"\0\0\1" + bytes([PRIVATE_STREAM]) + (size if size < 65536 else 0).to_bytes(2, "big") + b"\x84\x80\5" + _stamp(2, pts), np.uint8), data])
    k = 1 + max(0, -(-(len(pes) - 176) // 184))
    out = np.empty((k, PACKET), np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
    out[:, 3] = 0x10 | (counter + np.arange(k)) & 15
    out[0, 1] |= 0x40
    field = bytearray(b"\7\x50" + (pts >> 1).to_bytes(4, "big") + bytes([(pts & 1) << 7 | 0x7E, 0]))
    room = PACKET - 4 - len(field)
    if k == 1 and len(pes) < room:
        field += b"\xff" * (room - len(pes))
        field[0] = len(field) - 1
        room = len(pes)
    out[0, 3] |= 0x20
    out[0, 4 : 4 + len(field)] = np.frombuffer(bytes(field), np.uint8)
    out[0, PACKET - room :] = pes[:room]
    if k > 1:
        whole = pes[room : room + (k - 2) * 184].reshape(k - 2, 184)
        out[1 : k - 1, 4:] = whole
        last = pes[room + (k - 2) * 184 :]
        spare = 184 - len(last)
        if spare:
            out[k - 1, 3] |= 0x20
            out[k - 1, 4] = spare - 1
            if spare > 1:
                out[k - 1, 5] = 0
                out[k - 1, 6 : 4 + spare] = 255
        out[k - 1, 4 + spare :] = last
    return out


def mux(payload: bytes | np.ndarray) -> bytes:
    """A transport stream of one program whose private elementary stream holds payload."""
    data = np.frombuffer(payload, np.uint8) if isinstance(payload, bytes) else payload
    out, tables, counter = [], 0, 0
    for i, at in enumerate(range(0, max(1, len(data)), UNIT)):
        if i % TABLES_EVERY == 0:
            out += [_table_packet(0, tables, PAT)[None], _table_packet(PMT_PID, tables, PMT)[None]]
            tables += 1
        packets = _unit_packets(data[at : at + UNIT], i * TICKS & (1 << 33) - 1, counter)
        counter += len(packets)
        out.append(packets)
    return np.concatenate(out).tobytes()


@dataclass
class Unit:
    """A reassembled elementary packet."""

    pid: int
    pts: int | None
    dts: int | None
    clock: int | None
    random_access: bool
    first_packet: int
    data: bytes
    complete: bool


@dataclass
class Stream:
    """What demux finds: programs by number -> (map PID, clock PID, {elementary PID: type}), units, and counts of faults."""

    packets: int = 0
    programs: dict[int, tuple[int, int, dict[int, int]]] = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)
    sync_losses: int = 0
    gaps: int = 0
    repeats: int = 0
    bad_sections: int = 0
    errors: int = 0


def _packets(data: bytes) -> tuple[np.ndarray, int]:
    """The packets of data, and how often the sync byte was lost and found again."""
    raw = np.frombuffer(data, np.uint8)
    whole = raw[: len(raw) // PACKET * PACKET].reshape(-1, PACKET)
    if len(raw) % PACKET == 0 and (whole[:, 0] == SYNC).all():
        return whole, 0
    rows, at, lost = [], 0, 0
    while at + PACKET <= len(raw):
        run = raw[at : at + (len(raw) - at) // PACKET * PACKET].reshape(-1, PACKET)
        bad = np.flatnonzero(run[:, 0] != SYNC)
        good = int(bad[0]) if len(bad) else len(run)
        rows.append(run[:good])
        at += good * PACKET
        if at + PACKET > len(raw):
            break
        lost += 1
        # In sync again where a sync byte is followed by another one packet on, or by the end.
        near = np.flatnonzero(raw[at + 1 :] == SYNC) + at + 1
        near = near[(near + PACKET >= len(raw)) | (raw[np.minimum(near + PACKET, len(raw) - 1)] == SYNC)]
        if not len(near):
            break
        at = int(near[0])
    return (np.concatenate(rows) if rows else np.zeros((0, PACKET), np.uint8)), lost


def _sections(table: np.ndarray, offset: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
    """Complete sections of one PID's packets, in order."""
    buffer = b""
    for row, at, begins in zip(table, offset, starts):
        body = row[at:].tobytes()
        if begins and body:
            point = body[0]
            yield from _cut(buffer + body[1 : 1 + point])
            buffer = body[1 + point :]
        elif buffer:
            buffer += body
    yield from _cut(buffer)


def _cut(data: bytes) -> Iterator[bytes]:
    while len(data) >= 3 and data[0] != 255:
        n = 3 + (data[1] & 15) * 256 + data[2]
        if len(data) < n:
            return
        yield data[:n]
        data = data[n:]


def _read_stamp(b: np.ndarray | bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _read_unit(pid: int, body: bytes, clock: int | None, mark: bool, first: int) -> Unit | None:
    if len(body) < 6 or body[:3] != b"\0\0\1":
        return None
    size, at, pts, dts = body[4] << 8 | body[5], 6, None, None
    if len(body) >= 9 and body[6] >> 6 == 2:
        if body[7] & 0x80 and len(body) >= 14:
            pts = int(_read_stamp(body[9:14]))
        if body[7] & 0x40 and len(body) >= 19:
            dts = int(_read_stamp(body[14:19]))
        at = 9 + body[8]
    end = 6 + size if size else len(body)
    return Unit(pid, pts, dts, clock, mark, first, body[at:end], len(body) >= end)


def demux(data: bytes) -> Stream:
    """Reads a transport stream: program tables, continuity counters, elementary packets, timestamps, random-access points.

    Null packets, scrambled packets and packets marked as faulty are passed over; a repeated packet counts
    once; a counter that skips without a discontinuity mark is a gap, and the packet it breaks is incomplete.
    """
    rows, lost = _packets(data)
    out = Stream(packets=len(rows), sync_losses=lost)
    if not len(rows):
        return out
    pid = (rows[:, 1].astype(np.int32) & 31) << 8 | rows[:, 2]
    starts, control, counter = rows[:, 1] & 0x40 > 0, rows[:, 3] >> 4 & 3, rows[:, 3] & 15
    faulty = (rows[:, 1] & 0x80 > 0) | (rows[:, 3] & 0xC0 > 0)
    out.errors = int(faulty.sum())
    has_field, has_body = control & 2 > 0, (control & 1 > 0) & ~faulty & (pid != 0x1FFF)
    length = np.where(has_field, rows[:, 4].astype(np.int32), -1)
    offset = np.minimum(5 + length, PACKET)
    flags = np.where(length > 0, rows[:, 5], 0)
    where: dict[int, np.ndarray] = {}
    for p in np.unique(pid[has_body]).tolist():
        at = np.flatnonzero(has_body & (pid == p))
        if len(at) > 1:
            step = (counter[at[1:]].astype(np.int16) - counter[at[:-1]]) & 15
            same = np.concatenate([[False], (step == 0) & (rows[at[1:], 4:] == rows[at[:-1], 4:]).all(1)])
            out.repeats += int(same.sum())
            at = at[~same]
        where[p] = at
    maps: dict[int, int] = {}
    for section in _sections(rows[where[0]], offset[where[0]], starts[where[0]]) if 0 in where else ():
        if len(section) < 12 or section_crc(section):
            out.bad_sections += 1
        elif section[0] == 0:
            maps |= {section[i] << 8 | section[i + 1]: (section[i + 2] & 31) << 8 | section[i + 3] for i in range(8, len(section) - 4, 4)}
    maps.pop(0, None)  # the network's own table
    for map_pid in sorted(set(maps.values()) & set(where)):
        at = where[map_pid]
        for section in _sections(rows[at], offset[at], starts[at]):
            if len(section) < 16 or section_crc(section):
                out.bad_sections += 1
            elif section[0] == 2:
                i, kinds = 12 + ((section[10] & 15) << 8 | section[11]), {}
                while i + 5 <= len(section) - 4:
                    kinds[(section[i + 1] & 31) << 8 | section[i + 2]] = section[i]
                    i += 5 + ((section[i + 3] & 15) << 8 | section[i + 4])
                out.programs[section[3] << 8 | section[4]] = (map_pid, (section[8] & 31) << 8 | section[9], kinds)
    streams = sorted({p for _, _, kinds in out.programs.values() for p in kinds} & set(where))
    for p in [0, *sorted(set(maps.values()))] + streams:
        if p in where:
            at = where[p]
            broken = np.flatnonzero(((counter[at[1:]].astype(np.int16) - counter[at[:-1]]) & 15 != 1) & (flags[at[1:]] & 0x80 == 0)) + 1
            out.gaps += len(broken)
            if p in streams:
                _reassemble(out, p, rows[at], offset[at], starts[at], flags[at], at, set(broken.tolist()))
    return out


def _reassemble(out: Stream, pid: int, rows: np.ndarray, offset: np.ndarray, starts: np.ndarray, flags: np.ndarray, index: np.ndarray, broken: set[int]) -> None:
    sizes = PACKET - offset
    body = rows[np.arange(PACKET)[None, :] >= offset[:, None]]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    begin = np.flatnonzero(starts)
    for a, b in zip(begin, np.append(begin[1:], len(rows))):
        clock = None
        if flags[a] & 0x10:
            f = rows[a, 6:12].astype(np.int64)
            clock = int((f[0] << 25 | f[1] << 17 | f[2] << 9 | f[3] << 1 | f[4] >> 7) * 300 + ((f[4] & 1) << 8 | f[5]))
        unit = _read_unit(pid, body[ends[a] : ends[b]].tobytes(), clock, bool(flags[a] & 0x40), int(index[a]))
        if unit is None:
            out.errors += 1
            continue
        unit.complete &= not any(a < x < b for x in broken)
        out.units.append(unit)


_MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<boolean>"
_STORED = "doc_id long, n_bytes long, media binary"


def _padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column: each text's padded UTF-8 bytes as a transport stream.

    Null text is empty, and an empty payload 64 zero bytes; long texts become long streams; repeated rows give equal rows; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                n, payload = _padded(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([n], pa.int64()), pa.array([mux(payload)], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, _STORED)


def access_units(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per elementary packet of a media column: key, program, pid, stream_type, unit, pts, dts, clock, random_access, first_packet, n_bytes, complete.

    Null or empty media give no rows; bytes that are no transport stream give no rows.
    """
    kind = dict(media.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "program", "pid", "stream_type", "unit", "pts", "dts", "clock", "random_access", "first_packet", "n_bytes", "complete"]
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0), batch.column(1)):
                found = demux(data.as_py() or b"")
                owner = {p: (number, t) for number, (_, _, kinds) in found.programs.items() for p, t in kinds.items()}
                rows += [(k.as_py(), *owner[u.pid][:1], u.pid, owner[u.pid][1], i, u.pts, u.dts, u.clock, u.random_access, u.first_packet, len(u.data), u.complete) for i, u in enumerate(found.units)]
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    schema = f"key {kind}, program int, pid int, stream_type int, unit int, pts long, dts long, clock long, random_access boolean, first_packet long, n_bytes long, complete boolean"
    return media.select(F.col(key).alias("key"), F.col(column)).mapInArrow(run, schema)


def _levels(payload: bytes) -> str:
    x = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, v = len(payload), np.arange(256)
    mean = int((x * v).sum()) / n
    return f"mean={round(100 * mean)};deviation={round(100 * float(np.sqrt(max(0.0, int((x * v * v).sum()) / n - mean * mean))))}"


def media_features(docs: DataFrame) -> DataFrame:
    """Stores each text as a transport stream, reads the stored bytes back, and describes both.

    feature is packets, programs, elementary packets, random-access points, gaps, repeated packets, first and
    last timestamp of the stream read back, and the mean and standard deviation of its payload's bytes, in hundredths. Null text is empty, and an empty payload is 64 zero bytes;
    long texts become many elementary packets; repeated rows give equal rows; an empty table gives no
    rows. Each row is computed where it is read; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                n, payload = _padded(text.as_py())
                media = mux(payload)
                found = demux(media)
                back = b"".join(u.data for u in found.units)
                stamps, marks = [u.pts for u in found.units], [u.random_access for u in found.units]
                feature = f"packets={found.packets};programs={len(found.programs)};units={len(found.units)};access={sum(marks)};gaps={found.gaps};repeats={found.repeats};pts={stamps[0]}-{stamps[-1]};{_levels(back)}"
                out.append((doc.as_py(), n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, stamps, marks))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, _MEDIA)


def op1_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(documents(spark, sf_dir))
