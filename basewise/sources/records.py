"""Binary files of transcript records: counts (RC), mutation maps (MM) and normalised profiles (NRC).

All numbers are little-endian; a sequence is packed with two bases in a byte (A C G T N as 0 to 4, the first base in the
high half, an odd length padded with 0). The formats are read and written as Spark data sources, with one partition for
each run of records (option recordsPerPartition) and, with the option ids, of some records only; or used as plain
functions on bytes.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: How files end, the version they state, and the number that stands for a missing value in NRC files.
RC_END, MM_END, NRC_END, VERSION, MISSING = b"[eofrc]", b"[mmeof]", b"[eofnrc]", 1, -999.0
_NIBBLES = str.maketrans("ACGTN", "01234")
_BASES = str.maketrans("01234", "ACGTN")


def pack(sequence: str) -> bytes:
    digits = sequence.upper().replace("U", "T").translate(_NIBBLES)
    return bytes.fromhex(digits + "0" * (len(digits) % 2))


def unpack(data: bytes, length: int) -> str:
    return data.hex()[:length].translate(_BASES)


@dataclass
class Counts:
    id: str
    sequence: str
    counts: list[int]
    coverage: list[int]
    reads: int = 0


@dataclass
class Mutations:
    id: str
    sequence: str
    reads: list[tuple[int, int, list[int]]] = field(default_factory=list)


@dataclass
class Profile:
    id: str
    sequence: str
    values: list[float | None]


def _name(identifier: str, wide: bool) -> bytes:
    raw = identifier.encode() + b"\0"
    return struct.pack("<I" if wide else "<H", len(raw)) + raw


def encode_counts(x: Counts) -> bytes:
    n = len(x.sequence)
    if len(x.counts) != n or len(x.coverage) != n:
        raise ValueError(f"{x.id}: counts, coverage and sequence differ in length")
    return _name(x.id, True) + struct.pack("<I", n) + pack(x.sequence) + np.array([*x.counts, *x.coverage], "<u4").tobytes() + struct.pack("<I", x.reads)


def encode_mutations(x: Mutations) -> bytes:
    out = [_name(x.id, False), struct.pack("<I", len(x.sequence)), pack(x.sequence), struct.pack("<I", len(x.reads))]
    out += [struct.pack(f"<III{len(m)}I", a, b, len(m), *sorted(m)) for a, b, m in x.reads]
    return b"".join(out)


def encode_profile(x: Profile) -> bytes:
    values = np.array([MISSING if v is None else v for v in x.values], "<f8")
    return _name(x.id, True) + struct.pack("<I", len(x.sequence)) + pack(x.sequence) + values.tobytes()


class _Reader:
    """Records of a file, one after the other; read with wanted ids only, others are skipped by their size."""

    def __init__(self, kind: str, f):
        self.kind, self.f = kind, f
        f.seek(0, os.SEEK_END)
        size = f.tell()
        mark = {"rc": RC_END, "mm": MM_END, "nrc": NRC_END}[kind]
        f.seek(max(0, size - len(mark)))
        if f.read() != mark:
            raise ValueError(f"not a whole {kind.upper()} file")
        self.end = size - len(mark) - (0 if kind == "mm" else 10)
        if kind != "mm":
            f.seek(self.end)
            self.total, self.version = struct.unpack("<QH", f.read(10))
        f.seek(0)

    def _head(self) -> tuple[str, int]:
        width = 2 if self.kind == "mm" else 4
        n = int.from_bytes(self.f.read(width), "little")
        return self.f.read(n)[:-1].decode(), int.from_bytes(self.f.read(4), "little")

    def skip(self) -> tuple[str, int]:
        """Id and length of the record here; goes to the next."""
        identifier, n = self._head()
        self.f.seek((n + 1) // 2, os.SEEK_CUR)
        if self.kind == "mm":
            for _ in range(int.from_bytes(self.f.read(4), "little")):
                self.f.seek(8, os.SEEK_CUR)
                self.f.seek(4 * int.from_bytes(self.f.read(4), "little"), os.SEEK_CUR)
        else:
            self.f.seek(8 * n + 4 * (self.kind == "rc"), os.SEEK_CUR)
        return identifier, n

    def record(self) -> Counts | Mutations | Profile:
        identifier, n = self._head()
        sequence = unpack(self.f.read((n + 1) // 2), n)
        if self.kind == "rc":
            values = np.frombuffer(self.f.read(8 * n), "<u4").astype(np.int64).reshape(2, n).tolist()
            return Counts(identifier, sequence, values[0], values[1], int.from_bytes(self.f.read(4), "little"))
        if self.kind == "nrc":
            return Profile(identifier, sequence, [None if v < 0 else v for v in np.frombuffer(self.f.read(8 * n), "<f8").tolist()])
        out = Mutations(identifier, sequence)
        for _ in range(int.from_bytes(self.f.read(4), "little")):
            a, b, k = struct.unpack("<III", self.f.read(12))
            out.reads.append((a, b, list(struct.unpack(f"<{k}I", self.f.read(4 * k)))))
        return out


def index(kind: str, path: str) -> list[tuple[str, int, int]]:
    """(id, offset, length) of every record."""
    out = []
    with open(path, "rb") as f:
        r = _Reader(kind, f)
        while (at := f.tell()) < r.end:
            out.append((*(x := r.skip())[:1], at, x[1]))
    return out


def read(kind: str, path: str, ids: set[str] | None = None) -> Iterator[Counts | Mutations | Profile]:
    with open(path, "rb") as f:
        r = _Reader(kind, f)
        while (at := f.tell()) < r.end:
            if ids is not None:
                identifier, _ = r.skip()
                if identifier not in ids:
                    continue
                f.seek(at)
            yield r.record()


def read_range(path: str, identifier: str, ranges: list[tuple[int, int]]) -> Counts:
    """Counts and coverage at some closed ranges of one transcript, in order of the ranges, read without the rest of the record."""
    for name, at, n in index("rc", path):
        if name == identifier:
            start = at + 8 + len(name.encode()) + 1 + (n + 1) // 2
            counts, coverage, bases = [], [], []
            with open(path, "rb") as f:
                f.seek(at + 8 + len(name.encode()) + 1)
                sequence = unpack(f.read((n + 1) // 2), n)
                for a, b in sorted(ranges):
                    a, b = max(a, 0), min(b, n - 1)
                    bases.append(sequence[a : b + 1])
                    for out, base in ((counts, start), (coverage, start + 4 * n)):
                        f.seek(base + 4 * a)
                        out += np.frombuffer(f.read(4 * max(0, b - a + 1)), "<u4").astype(int).tolist()
            return Counts(name, "".join(bases), counts, coverage)
    raise KeyError(identifier)


def end_of(kind: str, reads: int = 0) -> bytes:
    return {"rc": struct.pack("<QH", reads, VERSION) + RC_END, "mm": MM_END, "nrc": struct.pack("<QH", reads, VERSION) + NRC_END}[kind]


def write(kind: str, path: str, records: list[Counts | Mutations | Profile], total: int | None = None) -> None:
    """A whole file, with an index of (id, offset) beside it (path + ``i``)."""
    encode = {"rc": encode_counts, "mm": encode_mutations, "nrc": encode_profile}[kind]
    at = 0
    with open(path, "wb") as f, open(path + "i", "wb") as g:
        for x in records:
            data = encode(x)
            f.write(data)
            g.write(_name(x.id, kind != "mm") + struct.pack("<Q", at) + (struct.pack("<Q", at + len(data)) if kind == "mm" else b""))
            at += len(data)
        f.write(end_of(kind, sum(getattr(x, "reads", 0) for x in records) if total is None and kind == "rc" else total or 0))


def concatenate(kind: str, parts: list[str], path: str) -> None:
    """Several files of one kind as one."""
    write(kind, path, [x for p in parts for x in read(kind, p)])


# -- Spark data sources ---------------------------------------------------------------------------

SCHEMAS = {
    "rc": "id string, sequence string, counts array<bigint>, coverage array<bigint>, reads bigint",
    "mm": "id string, sequence string, read_no bigint, start bigint, end bigint, muts array<bigint>",
    "nrc": "id string, sequence string, values array<double>",
}


def _local(path: str) -> str:
    return urlparse(path).path if path.startswith("file:") else path


@dataclass
class _Run(InputPartition):
    start: int
    records: int


class _RecordReader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.path = kind, _local(options["path"])
        # An option, not a filter pushed down: Spark keeps what one query pushed for others on the same frame.
        self.ids = set(options["ids"].split(",")) if options.get("ids") else None
        self.size = int(options.get("recordsPerPartition", 500))

    def partitions(self):
        places = [at for name, at, _ in index(self.kind, self.path) if self.ids is None or name in self.ids]
        if self.ids is not None:
            return [_Run(at, 1) for at in places]
        return [_Run(places[i], len(places[i : i + self.size])) for i in range(0, len(places), self.size)]

    def read(self, partition):
        with open(self.path, "rb") as f:
            r = _Reader(self.kind, f)
            f.seek(partition.start)
            for _ in range(partition.records):
                x = r.record()
                if isinstance(x, Counts):
                    yield x.id, x.sequence, x.counts, x.coverage, x.reads
                elif isinstance(x, Profile):
                    yield x.id, x.sequence, x.values
                else:
                    for k, (a, b, m) in enumerate(x.reads):
                        yield x.id, x.sequence, k, a, b, m


@dataclass
class _Part(WriterCommitMessage):
    path: str


class _RecordWriter(DataSourceWriter):
    """Each task writes a part of its own beside the target (a shared folder on a cluster); the driver joins them and adds the end."""

    def __init__(self, kind: str, options: dict):
        self.kind, self.path = kind, _local(options["path"])

    def write(self, rows):
        from pyspark import TaskContext

        context = TaskContext.get()
        part = f"{self.path}.{context.partitionId():06d}-{context.taskAttemptId()}"
        with open(part, "wb") as f:
            for r in rows:
                if self.kind == "rc":
                    f.write(encode_counts(Counts(r["id"], r["sequence"], list(r["counts"]), list(r["coverage"]), r["reads"] or 0)))
                elif self.kind == "nrc":
                    f.write(encode_profile(Profile(r["id"], r["sequence"], list(r["values"]))))
                else:
                    f.write(encode_mutations(Mutations(r["id"], r["sequence"], [(x["start"], x["end"], list(x["muts"])) for x in r["reads"]])))
        return _Part(part)

    def commit(self, messages):
        with open(self.path + ".whole", "wb") as f:
            for m in sorted((m for m in messages if m), key=lambda m: m.path):
                with open(m.path, "rb") as g:
                    while data := g.read(1 << 24):
                        f.write(data)
                os.remove(m.path)
            f.write(end_of(self.kind))
        if self.kind == "rc":
            with open(self.path + ".whole", "r+b") as f:
                total, end = 0, f.seek(0, os.SEEK_END) - 17
                r = _Reader("rc", f)
                while f.tell() < end:
                    total += r.record().reads
                f.seek(end)
                f.write(struct.pack("<Q", total))
        os.replace(self.path + ".whole", self.path)

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


def _source(kind: str) -> type[DataSource]:
    class Records(DataSource):
        @classmethod
        def name(cls):
            return f"basewise_{kind}"

        def schema(self):
            return SCHEMAS[kind]

        def reader(self, schema):
            return _RecordReader(kind, self.options)

        def writer(self, schema, overwrite):
            return _RecordWriter(kind, self.options)

    return Records


def register(spark: SparkSession) -> None:
    """Makes the formats basewise_rc, basewise_mm and basewise_nrc known."""
    for kind in SCHEMAS:
        spark.dataSource.register(_source(kind))


def arrow_of(records: list[Counts]) -> pa.Table:
    return pa.table({c: [getattr(x, c) for x in records] for c in ("id", "sequence", "counts", "coverage", "reads")})
