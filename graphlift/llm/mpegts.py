"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

`mux` packs a payload as one elementary stream: program tables (PAT, PMT with their CRC), packetized
elementary packets with presentation time stamps, random-access points with a program clock reference, and
188-byte transport packets with continuity counters. `demux` reads any such stream: it
follows the program tables, checks each PID's continuity counter, reassembles the elementary packets
and lists time stamps and random-access points.

Null payloads count as empty bytes. Damage doesn't raise: bytes out of step are skipped, and counted with
lost and repeated packets and broken tables. Repeated rows stay; other columns pass through, but one that has the name
of an added column is replaced. Payloads are packed whole, of any length; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x1000, 0x0100
#: Stream type of private data in elementary packets.
PRIVATE_DATA = 0x06
CLOCK = 90_000
#: One access unit: bytes, and its duration in ticks of the 90 kHz clock.
UNIT_BYTES, UNIT_TICKS = 32_000, 3_600
#: Every so many units one can be decoded without those before.
RANDOM_ACCESS_EVERY = 4

_CRC_TABLE = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC_TABLE.append(_c)


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC_TABLE[(crc >> 24) ^ b]
    return crc


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | ((len(body) + 9) >> 8), (len(body) + 9) & 0xFF, extension >> 8, extension & 0xFF, 0xC1, 0, 0])
    data = head + body
    return data + crc32_mpeg(data).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int = 0) -> bytes:
    return bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter, 0]) + section.ljust(PACKET - 5, b"\xff")


_HEAD = _table_packet(PAT_PID, _section(0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(marker: int, t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([marker << 4 | (t >> 29) & 0x0E | 1, (t >> 22) & 0xFF, (t >> 14) & 0xFE | 1, (t >> 7) & 0xFF, (t << 1) & 0xFE | 1])


def _clock(t: int) -> bytes:
    return ((t & ((1 << 33) - 1)) << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes, start: int = CLOCK) -> bytes:
    """The payload as a transport stream of one program."""
    out, counter = [_HEAD], 0
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit = payload[at : at + UNIT_BYTES]
        when = start + k * UNIT_TICKS
        data = b"\x00\x00\x01\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, when) + unit
        access = k % RANDOM_ACCESS_EVERY == 0
        field_ = (b"\x07\x50" + _clock(when - UNIT_TICKS)) if access else b""
        room = PACKET - 4 - len(field_)
        if len(data) < room:  # the only packet of its unit
            out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter]) + _stuffed(field_, PACKET - 4 - len(data)) + data)
            counter = (counter + 1) & 15
            continue
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 0xFF, (0x30 if field_ else 0x10) | counter]) + field_ + data[:room])
        counter = (counter + 1) & 15
        rest = data[room:]
        full = len(rest) // (PACKET - 4)
        if full:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
            packets[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            packets[:, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, -1)
            out.append(packets.tobytes())
            counter = (counter + full) & 15
        tail = rest[full * (PACKET - 4) :]
        if tail:
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter]) + _stuffed(b"", PACKET - 4 - len(tail)) + tail)
            counter = (counter + 1) & 15
    return b"".join(out)


def _stuffed(field_: bytes, size: int) -> bytes:
    """An adaptation field of exactly `size` bytes."""
    if size == 1:
        return b"\x00"
    body = field_[1:] if field_ else b"\x00"
    return bytes([size - 1]) + body.ljust(size - 1, b"\xff")


@dataclass
class Unit:
    """A packetized elementary packet: its PID, first packet's number, time stamps, whether decoding can begin here, and data."""

    pid: int
    packet: int
    pts: int | None
    dts: int | None
    random_access: bool
    data: bytes
    whole: bool


@dataclass
class Stream:
    packets: int = 0
    skipped_bytes: int = 0
    programs: dict[int, dict[int, int]] = field(default_factory=dict)  # program -> PID -> stream type
    units: list[Unit] = field(default_factory=list)
    lost: int = 0  # breaks of a continuity counter
    repeated: int = 0
    bad_tables: int = 0
    clocks: list[tuple[int, int]] = field(default_factory=list)  # packet, program clock reference in 27 MHz ticks

    def payload(self, pid: int | None = None) -> bytes:
        if pid is None:
            pid = next((p for streams in self.programs.values() for p in streams), None)
        return b"".join(u.data for u in self.units if u.pid == pid)

    def feature(self) -> str:
        """A short description: equal streams, equal descriptions."""
        times = [u.pts for u in self.units if u.pts is not None]
        access = [u.pts for u in self.units if u.random_access]
        index = hashlib.md5(",".join(map(str, access)).encode()).hexdigest()[:12]
        streams = ";".join(f"{n}:" + ",".join(f"{p:#x}={t:#x}" for p, t in sorted(s.items())) for n, s in sorted(self.programs.items()))
        span = f"{times[0]}-{times[-1]}" if times else "-"
        return f"programs={streams} packets={self.packets} units={len(self.units)} pts={span} random_access={len(access)}@{index} pcr={len(self.clocks)} lost={self.lost} repeated={self.repeated} skipped={self.skipped_bytes} bad_tables={self.bad_tables}"


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _steps(data: bytes) -> tuple[np.ndarray, int]:
    """Offsets of packets, and how many bytes aren't in one. In step, a sync byte is enough; out of step, the next packet must start with one too, or the data end."""
    n = len(data) // PACKET
    array = np.frombuffer(data, np.uint8)
    if n * PACKET == len(data) and (array[::PACKET] == SYNC).all():
        return np.arange(n) * PACKET, 0
    offsets, at, in_step = [], 0, False
    while at + PACKET <= len(data):
        if data[at] == SYNC and (in_step or data[at + PACKET : at + PACKET + 1] in (b"", b"\x47")):
            offsets.append(at)
            at += PACKET
            in_step = True
        else:
            in_step = False
            at = data.find(b"\x47", at + 1)
            if at < 0:
                break
    return np.array(offsets, np.int64), len(data) - PACKET * len(offsets)


class _Sections:
    """Gathers the sections of one table's PID."""

    def __init__(self):
        self.data, self.open = b"", False

    def add(self, payload: bytes, start: bool) -> list[bytes]:
        out = []
        if start:
            if not payload:
                return out
            point = payload[0]
            if self.open:
                self.data += payload[1 : 1 + point]
                out += self._take()
            self.data, self.open = payload[1 + point :], True
        elif self.open:
            self.data += payload
        return out + self._take()

    def _take(self) -> list[bytes]:
        out = []
        while len(self.data) >= 3 and self.data[0] != 0xFF:
            size = 3 + ((self.data[1] & 0x0F) << 8 | self.data[2])
            if len(self.data) < size:
                break
            out.append(self.data[:size])
            self.data = self.data[size:]
        return out


def demux(data: bytes) -> Stream:
    out = Stream()
    offsets, out.skipped_bytes = _steps(data)
    out.packets = len(offsets)
    tables: dict[int, _Sections] = {PAT_PID: _Sections()}
    program_of: dict[int, int] = {}
    wanted: set[int] = set()
    counters: dict[int, int] = {}
    last_payload: dict[int, bytes] = {}
    open_units: dict[int, list] = {}

    def close(pid: int, whole: bool = True) -> None:
        begun = open_units.pop(pid, None)
        if begun:
            unit = _unit(pid, *begun)
            if unit:
                unit.whole &= whole
                out.units.append(unit)

    for number, o in enumerate(offsets.tolist()):
        b1, b3 = data[o + 1], data[o + 3]
        pid = (b1 & 0x1F) << 8 | data[o + 2]
        if pid == 0x1FFF or b1 & 0x80 or b3 & 0xC0:  # null packet, marked as damaged, or scrambled
            continue
        at, jump, access = o + 4, False, False
        if b3 & 0x20:
            size = data[at]
            if size:
                flags = data[at + 1]
                jump, access = bool(flags & 0x80), bool(flags & 0x40)
                if flags & 0x10 and size >= 7:
                    clock = int.from_bytes(data[at + 2 : at + 8], "big")
                    out.clocks.append((number, (clock >> 15) * 300 + (clock & 0x1FF)))
            at += 1 + size
        if not b3 & 0x10 or at >= o + PACKET:
            continue
        counter, payload = b3 & 15, data[at : o + PACKET]
        before = counters.get(pid)
        if before is not None and not jump:
            if counter == before and last_payload.get(pid) == payload:
                out.repeated += 1
                continue
            if counter != (before + 1) & 15:
                out.lost += 1
                close(pid, whole=False)
        counters[pid], last_payload[pid] = counter, payload
        start = bool(b1 & 0x40)
        if pid in tables:
            for section in tables[pid].add(payload, start):
                _read_table(section, pid, out, tables, program_of, wanted)
        elif pid in wanted:
            if start:
                close(pid)
                open_units[pid] = [number, access, [payload]]
            elif pid in open_units:
                open_units[pid][2].append(payload)
    for pid in list(open_units):
        close(pid)
    out.units.sort(key=lambda u: u.packet)
    return out


def _read_table(section: bytes, pid: int, out: Stream, tables: dict, program_of: dict, wanted: set) -> None:
    if len(section) < 12 or crc32_mpeg(section) != 0:
        out.bad_tables += 1
        return
    if not section[5] & 1:  # holds later, not now
        return
    if section[0] == 0 and pid == PAT_PID:
        for i in range(8, len(section) - 7, 4):
            program, target = section[i] << 8 | section[i + 1], (section[i + 2] & 0x1F) << 8 | section[i + 3]
            if program:
                program_of[program] = target
                tables.setdefault(target, _Sections())
                out.programs.setdefault(program, {})
    elif section[0] == 2:
        program = section[3] << 8 | section[4]
        i = 12 + ((section[10] & 0x0F) << 8 | section[11])
        while i + 5 <= len(section) - 4:
            es = (section[i + 1] & 0x1F) << 8 | section[i + 2]
            out.programs.setdefault(program, {})[es] = section[i]
            wanted.add(es)
            i += 5 + ((section[i + 3] & 0x0F) << 8 | section[i + 4])


def _unit(pid: int, packet: int, access: bool, parts: list[bytes]) -> Unit | None:
    data = b"".join(parts)
    if len(data) < 9 or data[:3] != b"\x00\x00\x01":
        return None
    size, flags, head = data[4] << 8 | data[5], data[7] >> 6, 9 + data[8]
    pts = _read_stamp(data[9:14]) if flags & 2 and len(data) >= 14 else None
    dts = _read_stamp(data[14:19]) if flags == 3 and len(data) >= 19 else pts
    end = 6 + size if size else len(data)
    return Unit(pid, packet, pts, dts, access, data[head:end], len(data) >= end)


def padded(text: bytes, unit: int = 64) -> bytes:
    """Bytes 0 appended up to a positive multiple of `unit`."""
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b"\x00")


def with_media(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """Adds the payload column (binary or text; null: empty) as a transport stream."""
    hidden = frames.fresh("_payload", df)
    kept = frames.without(df.columns, [media])
    rows = df.select(*kept, df[payload].cast("binary").alias(hidden))
    schema = frames.with_fields(df.select(*kept), f"`{media}` binary")

    def pack(batches):
        for batch in batches:
            streams = [mux(x) for x in frames.strings(batch.column(hidden))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(streams, pa.binary())], schema.names)

    return frames.map_arrow(rows, pack, schema)


#: What read_media() adds, besides the payload.
FACTS = "packets bigint, skipped_bytes bigint, lost bigint, repeated bigint, bad_tables bigint, programs map<int,map<int,int>>, units array<struct<pid:int,packet:bigint,pts:bigint,dts:bigint,random_access:boolean,bytes:bigint,whole:boolean>>"


def read_media(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Parses stored streams: the kept columns, the reassembled payload of the first stream, FACTS and a short feature."""
    arrow = frames.arrow_schema("payload binary, " + FACTS + ", feature string")
    kept = frames.without([c for c in df.columns if c != media] if keep is None else keep, arrow.names)
    hidden = frames.fresh("_media", df)
    rows = df.select(*kept, df[media].alias(hidden))
    schema = frames.with_fields(rows.drop(hidden), "payload binary, " + FACTS + ", feature string")

    def parse(batches):
        for batch in batches:
            found = [demux(x) for x in frames.strings(batch.column(hidden))]
            values = {
                "payload": [s.payload() for s in found],
                "packets": [s.packets for s in found],
                "skipped_bytes": [s.skipped_bytes for s in found],
                "lost": [s.lost for s in found],
                "repeated": [s.repeated for s in found],
                "bad_tables": [s.bad_tables for s in found],
                "programs": [[(n, list(p.items())) for n, p in s.programs.items()] for s in found],
                "units": [[{"pid": u.pid, "packet": u.packet, "pts": u.pts, "dts": u.dts, "random_access": u.random_access, "bytes": len(u.data), "whole": u.whole} for u in s.units] for s in found],
                "feature": [s.feature() for s in found],
            }
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(values[f.name], f.type) for f in arrow)], schema.names)

    return frames.map_arrow(rows, parse, schema)


def op1_mpegts(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = frames.read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes"))
    size = F.length("bytes")
    short = F.greatest(F.lit(64), F.ceil(size / 64) * 64) - size
    payload = F.concat("bytes", F.unhex(F.repeat(F.lit("00"), short.cast("int"))))
    stored = with_media(docs.select("doc_id", size.cast("bigint").alias("n_bytes"), payload.alias("payload")), "payload").drop("payload")
    back = read_media(stored.select("doc_id", "n_bytes", F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media"))
    tail = F.substring("payload", -64, 64)
    return back.select(
        "doc_id", "n_bytes", F.length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
        "packets", F.size("units").alias("units"), F.size(F.filter("units", lambda u: u["random_access"])).alias("random_access_points"), (F.col("lost") + F.col("bad_tables") + F.col("skipped_bytes")).alias("damage"),
    )
