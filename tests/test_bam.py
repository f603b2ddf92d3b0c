"""BAM files written here block by block, read whole and in ranges; replicates' windows; stranded counts."""

from __future__ import annotations

import random
import struct
import zlib

import pytest

from basewise.operators import deconvolution, pileup
from basewise.sources import bam, text

REFS = [("t1", 5000), ("chr_2", 100_000)]


def block(data):
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def packed(r):
    name, flag, ref, pos, mapq, cigar, mate, mate_pos, span, seq, qual, tags = r
    steps, n = [], ""
    for c in cigar if cigar != "*" else "":
        if c.isdigit():
            n += c
        else:
            steps.append(int(n) << 4 | bam.STEPS.index(c))
            n = ""
    codes = [bam.BASES.index(c) for c in (seq if seq != "*" else "")]
    codes += [0] * (len(codes) % 2)
    out = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(steps), flag, len(seq) if seq != "*" else 0, mate, mate_pos, span) + name.encode() + b"\0"
    out += b"".join(struct.pack("<I", s) for s in steps) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    out += bytes(ord(c) - 33 for c in qual) if qual != "*" else b"\xff" * (len(seq) if seq != "*" else 0)
    return struct.pack("<i", len(out + tags)) + out + tags


def made(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.randint(20, 150)
        seq = "".join(rng.choice("ACGTN") for _ in range(size))
        ref = rng.choice([0, 1, 1])
        tags = b"MDZ" + f"{size}".encode() + b"\0" + b"NMC" + bytes([i % 200]) + b"XSA+" + b"XFf" + struct.pack("<f", 0.5) + b"XBBS" + struct.pack("<iHH", 2, 1, 65535)
        rows.append((f"r{i}", rng.choice([0, 16, 99, 147]), ref, rng.randint(0, 4000), rng.randint(0, 60), f"3S{size - 3}M", rng.choice([-1, ref]), rng.randint(-1, 4000), 7, seq, "".join(chr(33 + rng.randint(0, 60)) for _ in range(size)), tags))
    return rows + [("none", 4, -1, -1, 0, "*", -1, -1, 0, "ACG", "*", b""), ("bare", 0, 0, 5, 9, "4M", -1, -1, 0, "*", "*", b"")]


def write(path, rows, size):
    head = b"@HD\tVN:1.6\n"
    data = b"BAM\x01" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(REFS))
    for name, length in REFS:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    data += b"".join(map(packed, rows))
    path.write_bytes(b"".join(block(data[i : i + size]) for i in range(0, len(data), size)) + block(b""))


def sam_line(r):
    name, flag, ref, pos, mapq, cigar, mate, mate_pos, span, seq, qual, tags = r
    more = [f"MD:Z:{len(seq)}", f"NM:i:{tags[tags.index(b'NMC') + 3]}", "XS:A:+", "XF:f:0.5", "XB:B:S,1,65535"] if tags else []
    other = "*" if mate < 0 else "=" if mate == ref else REFS[mate][0]
    return "\t".join([name, str(flag), REFS[ref][0] if ref >= 0 else "*", str(pos + 1), str(mapq), cigar, other, str(mate_pos + 1), str(span), seq, qual, *more])


@pytest.mark.parametrize("size", [300, 60_000])
def test_bam_equals_sam(spark, tmp_path, size):
    rows = made(800)
    write(tmp_path / "x.bam", rows, size)
    (tmp_path / "x.sam").write_text("@SQ\tSN:t1\tLN:5000\n" + "\n".join(map(sam_line, rows)) + "\n")
    want = sorted(text.sam(spark, str(tmp_path / "x.sam")).collect(), key=lambda r: r["qname"])
    for ranges in (1 << 30, 20_000, 7000):
        got = sorted(bam.bam(spark, str(tmp_path / "*.bam"), ranges).collect(), key=lambda r: r["qname"])
        assert len(got) == len(want) == 801
        for x, y in zip(got, want, strict=True):
            assert {k: v for k, v in x.asDict().items() if k not in ("phred",)} == {k: v for k, v in y.asDict().items() if k in x.asDict() and k != "phred"}
            assert list(x["phred"]) == [p for p in y["phred"] if p >= 0]
    assert bam.bam_lengths(str(tmp_path / "x.bam")) == REFS


def test_broken_files(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(b"no bam")
    with pytest.raises(ValueError):
        bam.bam_lengths(str(tmp_path / "a.bam"))
    write(tmp_path / "b.bam", [], 100)
    assert bam.bam(spark, str(tmp_path / "b.bam")).count() == 0


def test_matched_windows(spark):
    def row(f, start, counts):
        return (f, "t", start, start + 9, [0.5, 0.5], counts, [[10] * 10, [10] * 10])

    one, two = [9, 1, 8, 0, 7, 1, 9, 0, 8, 1], [0, 7, 1, 9, 0, 8, 1, 9, 0, 6]
    df = spark.createDataFrame([row("a", 10, [one, two]), row("b", 11, [two, one]), row("a", 100, [one, two]), row("b", 300, [one, two])], deconvolution.COLUMNS)
    got = sorted(map(tuple, deconvolution.matched_windows(df, least_overlap=0.7).select("match", "replicate", "start", "assigned").collect()))
    assert [(g[0], g[1], g[2]) for g in got] == [(0, "a", 10), (0, "b", 11)] and got[0][3] == [0, 1]


def test_genome_counts(spark):
    reads = [("t", "+", 5, 9), ("t", "+", 1, 3), ("t", "-", 5, 9)]
    got = {(r["strand"], r["pos"]): (r["count"], r["coverage"]) for r in pileup.genome_counts(spark.createDataFrame(reads, "id string, strand string, start long, end long"), 2).collect()}
    assert got["+", 2] == (1, 1) and got["+", 3] == (0, 2) and got["-", 12] == (1, 0) and got["-", 11] == (0, 1) and ("+", -2) not in got and ("-", 4) not in got
