"""MPEG transport streams (ISO/IEC 13818-1): a writer and a reader.

Writer: one programme with one private elementary stream. A payload is dealt into elementary packets of at most
PES_BYTES, each with a time stamp (PTS) of its own; the transport packet that begins one carries a clock reference and
the random access mark, the one that ends one is stuffed by its adaptation field.

Reader: takes the programme association and map tables (with their checksums), follows the elementary streams that the
map names, checks continuity counters by PID, joins elementary packets, and returns time stamps with random access
points. It reads any stream of 188-byte packets, not only the writer's.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table

PACKET, SYNC, PES_BYTES, UNIT = 188, 0x47, 32_768, 64
#: Stream ids whose elementary packets have no header beyond the length; the one of stuffing.
BARE, STUFFING = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}, 0xBE
#: PIDs of the writer's map table and stream, its stream type (private data in PES), and ticks (90 kHz) between units.
MAP_PID, STREAM_PID, STREAM_TYPE, TICKS = 0x1000, 0x0100, 0x06, 3600


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(1024)
def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2; 0 over a section that ends with its own."""
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ x]
    return c


def _section(table_id: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, len(body) + 9 & 0xFF, 0, 1, 0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


@lru_cache(1)
def _tables() -> bytes:
    pat = _section(0, bytes([0, 1, 0xE0 | MAP_PID >> 8, MAP_PID & 0xFF]))
    pmt = _section(2, bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0]))
    return _table_packet(0, pat) + _table_packet(MAP_PID, pmt)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def write_stream(payload: bytes, pes_bytes: int = PES_BYTES) -> bytes:
    """payload as a transport stream; an empty payload makes one empty elementary packet."""
    parts, counter = [_tables()], 0
    for k, at in enumerate(range(0, max(1, len(payload)), pes_bytes)):
        unit, pts = payload[at : at + pes_bytes], k * TICKS & 0x1FFFFFFFF
        body = b"\x00\x00\x01\xbd" + (8 + len(unit)).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        lead = min(len(body), 176)
        first = bytes([SYNC, 0x40 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0x30 | counter, 183 - lead, 0x50]) + clock
        parts.append(first + b"\xff" * (176 - lead) + body[:lead])
        counter = counter + 1 & 15
        if full := (len(body) - lead) // 184:
            block = np.empty((full, PACKET), np.uint8)
            block[:, :3] = (SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF)
            block[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            block[:, 4:] = np.frombuffer(body, np.uint8, full * 184, lead).reshape(full, 184)
            parts.append(block.tobytes())
            counter = counter + full & 15
        if tail := (len(body) - lead) % 184:
            stuffing = bytes([183 - tail]) + (b"\x00" + b"\xff" * (182 - tail) if tail < 183 else b"")
            parts.append(bytes([SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF, 0x30 | counter]) + stuffing + body[-tail:])
            counter = counter + 1 & 15
    return b"".join(parts)


@dataclass
class Stream:
    """What a reader found: units are (pts or None, offset in payload, length, random access, whole)."""

    payload: bytes = b""
    units: list[tuple[int | None, int, int, bool, bool]] = field(default_factory=list)
    packets: int = 0
    pids: list[int] = field(default_factory=list)
    gaps: int = 0
    repeats: int = 0
    damaged: int = 0


def _sections(packets: np.ndarray, begins: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Whole sections with a right checksum from the packets of one PID."""
    out, data, live = [], b"", False

    def take(data: bytes) -> bytes:
        while len(data) >= 3 and data[0] != 0xFF and len(data) >= (n := 3 + ((data[1] & 0x0F) << 8 | data[2])):
            if n >= 12 and not section_crc(data[:n]):
                out.append(data[:n])
            data = data[n:]
        return data

    for row, begin, start in zip(packets, begins, starts, strict=True):
        body = row[start:].tobytes()
        if not body:
            continue
        if begin:
            if live:
                take(data + body[1 : 1 + body[0]])
            data, live = take(body[1 + body[0] :]), True
        elif live:
            data = take(data + body)
    return out


def read_stream(media: bytes) -> Stream:
    """The elementary streams of all programmes, joined in the order of the tables.

    A cut last packet, packets without sync byte or marked as erroneous are counted as damaged and passed over; a
    counter that doesn't follow counts as a gap (unless the packet says so by its discontinuity mark), and the unit in
    which it lies as not whole, as does one of unknown length that a gap ends; repeated packets are taken once. Packets
    before a stream's first unit begins, and units without a start code, count as damaged; stuffing units are passed
    over. Bytes that are no transport stream give an empty result."""
    n = len(media) // PACKET
    out = Stream(packets=n, damaged=int(len(media) % PACKET > 0))
    if not n:
        return out
    rows = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)
    good = (rows[:, 0] == SYNC) & (rows[:, 1] < 0x80)
    out.damaged += int(n - good.sum())
    rows = rows[good]
    pid = (rows[:, 1] & 0x1F).astype(np.int32) << 8 | rows[:, 2]
    begins = rows[:, 1] & 0x40 > 0
    adapted = rows[:, 3] & 0x20 > 0
    start = np.where(adapted, 5 + rows[:, 4].astype(np.int32), 4)
    start[(rows[:, 3] & 0x10 == 0) | (start > PACKET)] = PACKET
    marks = adapted & (rows[:, 4] > 0) & (rows[:, 5] & 0x40 > 0)
    breaks = adapted & (rows[:, 4] > 0) & (rows[:, 5] & 0x80 > 0)

    def of(p: int) -> tuple:
        at = np.flatnonzero(pid == p)
        return rows[at], begins[at], start[at]

    maps = [s[i + 2 : i + 4] for s in _sections(*of(0)) if s[0] == 0 for i in range(8, len(s) - 7, 4) if s[i] or s[i + 1]]
    for section in (s for p in dict.fromkeys((a & 0x1F) << 8 | b for a, b in maps) for s in _sections(*of(p))):
        i = 12 + ((section[10] & 0x0F) << 8 | section[11])
        while section[0] == 2 and i + 5 <= len(section) - 4:
            p = (section[i + 1] & 0x1F) << 8 | section[i + 2]
            if p not in out.pids:
                out.pids.append(p)
            i += 5 + ((section[i + 3] & 0x0F) << 8 | section[i + 4])
    chunks = []
    for p in out.pids:
        at = np.flatnonzero((pid == p) & (start < PACKET))
        if not len(at):
            continue
        counter = rows[at, 3] & 15
        step = (counter[1:].astype(np.int8) - counter[:-1]) & 15
        if (step != 1).any():
            again = np.append(False, (step == 0) & (rows[at[1:], 4:] == rows[at[:-1], 4:]).all(1))
            out.repeats += int(again.sum())
            at, counter = at[~again], counter[~again]
            step = (counter[1:].astype(np.int8) - counter[:-1]) & 15
        gap = np.append(False, step != 1) & ~breaks[at]
        out.gaps += int(gap.sum())
        sizes = PACKET - start[at]
        body = rows[at][np.arange(PACKET) >= start[at][:, None]].tobytes()
        ends = np.cumsum(sizes)
        firsts = np.flatnonzero(begins[at])
        out.damaged += int(firsts[0]) if len(firsts) else len(at)
        for k, f in enumerate(firsts):
            until = firsts[k + 1] if k + 1 < len(firsts) else len(at)
            unit = body[ends[f] - sizes[f] : ends[until - 1]]
            if len(unit) < 6 or unit[:3] != b"\x00\x00\x01" or (unit[3] not in BARE and len(unit) < 9):
                out.damaged += 1
                continue
            if unit[3] == STUFFING:
                continue
            said, head, pts = int.from_bytes(unit[4:6], "big"), 6 if unit[3] in BARE else 9 + unit[8], None
            if head > 6 and unit[7] & 0x80 and len(unit) >= 14:
                b = unit[9:14]
                pts = (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1
            data = unit[head : 6 + said] if said else unit[head:]
            # Packets lost before the next unit may be the end of one that doesn't tell its length.
            whole = not gap[f + 1 : until].any() and (len(unit) >= 6 + said if said else not gap[until : until + 1].any())
            out.units.append((pts, sum(map(len, chunks)), len(data), bool(marks[at[f]]), whole))
            chunks.append(data)
    out.payload = b"".join(chunks)
    return out


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media (a transport stream that holds the UTF-8 text, padded to a positive multiple of 64 bytes).

    A null text is stored as an empty one; repeated rows give repeated rows; an empty table gives no rows; other columns
    are not read."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [(t or "").encode() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([write_stream(padded(x)) for x in data], pa.binary())], names=[key, "n_bytes", "media"])

    return map_batches(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes bigint, media binary")


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df without its media column, and with the payload that a reader gets from it, its time stamps, random access points and faults.

    A null or foreign media column gives an empty payload and no time stamps; repeated rows give repeated rows; an empty
    table gives no rows; columns of df that have the name of a new one are replaced."""
    more = "payload binary, media_bytes bigint, media_sha256 string, time_stamps array<bigint>, random_access array<bigint>, packets bigint, gaps bigint, damaged bigint"
    new_names = [x.split()[0] for x in more.split(", ")]
    keep = [c for c in df.columns if c != media and c.lower() not in new_names]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [x or b"" for x in batch.column(batch.schema.get_field_index(media)).to_pylist()]
        got = [read_stream(x) for x in data]
        new = [
            pa.array([s.payload for s in got], pa.binary()),
            pa.array([len(x) for x in data], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in data]),
            pa.array([[u[0] for u in s.units] for s in got], pa.list_(pa.int64())),
            pa.array([[u[1] for u in s.units if u[3]] for s in got], pa.list_(pa.int64())),
            *(pa.array([getattr(s, c) for s in got], pa.int64()) for c in ("packets", "gaps", "damaged")),
        ]
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *new], names=[*keep, *new_names])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(df.select(*keep, media), run, kinds + more)


def digests(df: DataFrame) -> DataFrame:
    """The payload of read_media as its length, hash and the checksum of its last 64 bytes, and the stream's features as one string."""
    keep = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.to_pydict()
        data = rows["payload"]
        feature = [f"packets={p};units={len(t)};first={t[0] if t else '-'};last={t[-1] if t else '-'};random_access={len(r)};gaps={g};damaged={d}" for p, t, r, g, d in zip(rows["packets"], rows["time_stamps"], rows["random_access"], rows["gaps"], rows["damaged"], strict=True)]
        new = [pa.array([len(x) for x in data], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in data]), pa.array([zlib.crc32(x[-UNIT:]) for x in data], pa.int64()), pa.array(feature)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    out = map_batches(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media_bytes bigint, media_sha256 string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_media(store_media(table(spark, sf_dir, "documents"))))
