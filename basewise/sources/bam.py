"""BAM files (BGZF blocks of binary alignment records) as the rows that text.sam gives.

A file is dealt into ranges of its compressed bytes. Each task finds the first block that begins in its range and the
first record in it (by following a chain of records that hold together), and reads the records that begin in its range
block by block, so that memory doesn't grow with the file. Paths must be reachable from every machine.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from glob import glob

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: the first bytes of a block, letters of bases and of alignment steps, sizes of tag values.
MAGIC, BASES, STEPS = b"\x1f\x8b\x08\x04", "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SIZES = {"A": ("c", 1), "c": ("b", 1), "C": ("B", 1), "s": ("h", 2), "S": ("H", 2), "i": ("i", 4), "I": ("I", 4), "f": ("f", 4)}
#: Compressed bytes of a range; a block has at most 64 KB; records that must hold together where a range begins.
RANGE, BLOCK, CHAIN = 32 << 20, 1 << 16, 8

SCHEMA = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen int, seq string, qual string, tags map<string,string>, phred array<int>"


def block_size(data: bytes) -> int | None:
    """The size of the block that data begins with, or None if none does."""
    if len(data) < 18 or data[:4] != MAGIC:
        return None
    extra, at = struct.unpack_from("<H", data, 10)[0], 12
    while at + 4 <= 12 + extra and at + 6 <= len(data):
        if data[at : at + 2] == b"BC" and data[at + 2 : at + 4] == b"\x02\0":
            return struct.unpack_from("<H", data, at + 4)[0] + 1
        at += 4 + struct.unpack_from("<H", data, at + 2)[0]
    return None


def _inflate(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def blocks(file, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the blocks from a place on where one begins."""
    while True:
        file.seek(at)
        data = file.read(BLOCK)
        if not data:
            return
        size = block_size(data)
        if size is None or size > len(data):
            raise ValueError(f"no whole block at byte {at}")
        yield at, _inflate(data[:size])
        at += size


def first_block(file, at: int, end: int) -> int | None:
    """The first place from at on, and before end, where a block begins and another (or the end of the file) follows it."""
    file.seek(at)
    data = file.read(2 * BLOCK)
    whole = at + len(data) >= os.fstat(file.fileno()).st_size
    k = data.find(MAGIC)
    while 0 <= k < min(end - at, BLOCK):
        size = block_size(data[k:])
        if size is not None and (block_size(data[k + size :]) is not None or (whole and k + size == len(data))):
            return at + k
        k = data.find(MAGIC, k + 1)
    return None


def header(file) -> tuple[list[tuple[str, int]], int, int]:
    """The reference sequences, and the place of the block and the byte in it where the records begin."""
    data, starts = b"", []

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            try:
                place, content = next(source)
            except StopIteration:
                raise ValueError("the header is cut") from None
            starts.append((len(data), place))
            data += content

    source = blocks(file, 0)
    need(8)
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    need(at + 4)
    n, at, names = struct.unpack_from("<i", data, at)[0], at + 4, []
    for _ in range(n):
        need(at + 4)
        size = struct.unpack_from("<i", data, at)[0]
        need(at + 8 + size)
        names.append((data[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", data, at + 4 + size)[0]))
        at += 8 + size
    begin, place = next((s for s in reversed(starts) if s[0] <= at), (0, 0))
    return names, place, at - begin


def plausible(data: bytes, at: int, lengths: list[int]) -> int | None:
    """The size of the record that may begin at a place (with its own size field), or None if none can."""
    if at + 36 > len(data):
        return None
    size, ref, pos, l_name, _, _, n_steps, _, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if l_name < 1 or l_seq < 0 or size < 32 + l_name + 4 * n_steps + (l_seq + 1) // 2 + l_seq:
        return None
    for r, p in ((ref, pos), (mate, mate_pos)):
        if not -1 <= r < len(lengths) or p < -1 or (r >= 0 and p >= lengths[r]):
            return None
    if at + 36 + l_name <= len(data):
        name = data[at + 36 : at + 36 + l_name]
        if name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
            return None
    return size + 4


def first_record(data: bytes, lengths: list[int], whole: bool) -> int | None:
    """The first place in data from which a chain of records leads on, up to CHAIN of them or the end of data."""
    for at in range(len(data)):
        here, n = at, 0
        while n < CHAIN:
            if here == len(data) or (n and not whole and here + 36 > len(data)):
                break
            step = plausible(data, here, lengths)
            if step is None:
                n = -1
                break
            here, n = here + step, n + 1
        if n > 0:
            return at
    return None


def _tags(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in "ZH":
            end = data.index(0, at)
            out[name], at = data[at:end].decode(), end + 1
        elif kind == "B":
            code, size = SIZES[chr(data[at])]
            n = struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{code}", data, at + 5)
            out[name], at = ",".join([chr(data[at]), *(f"{v:g}" if code == "f" else str(v) for v in values)]), at + 5 + n * size
        else:
            code, size = SIZES[kind]
            v = struct.unpack_from("<" + code, data, at)[0]
            out[name], at = v.decode() if kind == "A" else f"{v:g}" if kind == "f" else str(v), at + size
    return out


def record(data: bytes, names: list[str]) -> tuple:
    """The fields of a record, without its size field, in the order of SCHEMA."""
    ref, pos, l_name, mapq, _, n_steps, flag, l_seq, mate, mate_pos, span = struct.unpack_from("<iiBBHHHiiii", data, 0)
    at = 32 + l_name
    name = data[32 : at - 1].decode()
    steps = struct.unpack_from(f"<{n_steps}I", data, at)
    at += 4 * n_steps
    packed = data[at : at + (l_seq + 1) // 2]
    seq = "".join(BASES[x >> 4] + BASES[x & 15] for x in packed)[:l_seq] or "*"
    at += (l_seq + 1) // 2
    phred = list(data[at : at + l_seq])
    known = bool(phred) and phred[0] != 255
    tags = _tags(data[at + l_seq :])
    cigar = "".join(f"{x >> 4}{STEPS[x & 15]}" for x in steps) or "*"
    if "CG" in tags and n_steps == 2:  # too many steps for the field: they are in this tag
        cigar = "".join(f"{int(x) >> 4}{STEPS[int(x) & 15]}" for x in tags.pop("CG").split(",")[1:])
    where = names[ref] if ref >= 0 else "*"
    other = "*" if mate < 0 else "=" if mate == ref else names[mate]
    return name, flag, where, pos, mapq, cigar, other, mate_pos, span, seq, "".join(chr(q + 33) for q in phred) if known else "*", tags, phred if known else []


def records(path: str, begin: int, end: int) -> Iterator[tuple]:
    """The records of a file that begin in blocks from byte begin on and before end."""
    with open(path, "rb") as file:
        refs, place, skip = header(file)
        names, lengths = [n for n, _ in refs], [n for _, n in refs]
        if begin > place:
            place, skip = first_block(file, begin, end), None
        elif place >= end:
            return
        if place is None:
            return
        source, data, starts = blocks(file, place), b"", []
        # starts: where in data each block begins, and its place in the file.

        def more() -> bool:
            nonlocal data
            got = next(source, None)
            if got is None:
                return False
            starts.append((len(data), got[0]))
            data += got[1]
            return True

        at = skip
        if at is None:
            some, whole = 4, False
            while at is None and not whole:
                while len(starts) < some and not whole:
                    whole = not more()
                at, some = first_record(data, lengths, whole), 2 * some
            if at is None:
                return
        while True:
            while len(data) < at + 4 or len(data) < at + 4 + struct.unpack_from("<i", data, at)[0]:
                if not more():
                    return
            here = next(p for s, p in reversed(starts) if s <= at)
            if here >= end:
                return
            size = struct.unpack_from("<i", data, at)[0]
            yield record(data[at + 4 : at + 4 + size], names)
            at += 4 + size
            if at > 4 * BLOCK:
                data = data[at:]
                starts = [(s - at, p) for s, p in starts]
                last = max((i for i, (s, _) in enumerate(starts) if s <= 0), default=0)
                starts, at = starts[last:], 0


def bam(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """The alignments of a BAM file (or of all that a pattern names) that have a CIGAR string, as text.sam gives those of SAM files."""
    ranges = [(p, a, a + size) for p in sorted(glob(path)) for a in range(0, max(os.path.getsize(p), 1), size)]
    given = spark.createDataFrame(ranges, "path string, begin bigint, end bigint").repartition(max(1, min(len(ranges), 10_000)), "path", "begin")
    schema = pa.schema([("qname", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("rnext", pa.string()), ("pnext", pa.int64()), ("tlen", pa.int32()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("phred", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            columns[11] = [list(t.items()) for t in columns[11]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for p, a, b in zip(*batch.to_pydict().values(), strict=True):
                for r in records(p, a, b):
                    held.append(r)
                    if len(held) >= 1000:
                        yield out()
        if held:
            yield out()

    return given.mapInArrow(run, SCHEMA).where(F.col("cigar") != "*")


def bam_lengths(path: str) -> list[tuple[str, int]]:
    """(id, length) of the reference sequences that a BAM file names."""
    with open(path, "rb") as file:
        return header(file)[0]
