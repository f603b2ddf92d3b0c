"""Readers and writers: round trips and odd records."""

from __future__ import annotations

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from basewise.sources import records as R
from basewise.sources import sinks, text


def put(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body)
    return str(p)


def some_counts(n=40):
    rng = random.Random(1)
    out = []
    for i in range(n):
        k = rng.choice([0, 1, 2, 7, 30])
        out.append(R.Counts(f"t{i}", "".join(rng.choice("ACGTN") for _ in range(k)), [rng.randint(0, 2**32 - 1) for _ in range(k)], [rng.randint(0, 99) for _ in range(k)], rng.randint(0, 9)))
    return out


def test_counts_round_trip(tmp_path):
    path, data = str(tmp_path / "x.rc"), some_counts()
    R.write("rc", path, data)
    assert list(R.read("rc", path)) == data and [x.id for x in R.read("rc", path, {"t3", "t5"})] == ["t3", "t5"]
    raw = open(path, "rb").read()
    assert raw.endswith(struct.pack("<QH", sum(x.reads for x in data), 1) + b"[eofrc]")
    assert raw[: 4 + 3 + 4] == struct.pack("<I", 3) + b"t0\0" + struct.pack("<I", len(data[0].sequence))
    for (name, at, n), x in zip(R.index("rc", path), data, strict=True):
        assert (name, n) == (x.id, len(x.sequence)) and raw[at + 4 : at + 4 + len(name)] == name.encode()
    x = next(x for x in data if len(x.sequence) == 30)
    got = R.read_range(path, x.id, [(20, 25), (2, 4), (28, 99)])
    assert got.counts == x.counts[2:5] + x.counts[20:26] + x.counts[28:] and got.sequence == x.sequence[2:5] + x.sequence[20:26] + x.sequence[28:]
    with pytest.raises(KeyError):
        R.read_range(path, "none", [(0, 1)])
    open(path, "wb").write(raw[:-1])
    with pytest.raises(ValueError):
        list(R.read("rc", path))


def test_mutation_and_profile_round_trips(tmp_path):
    maps = [R.Mutations("a", "ACGTN", [(0, 4, [1, 3]), (2, 2, [])]), R.Mutations("b", "A"), R.Mutations("c", "GG", [(0, 1, [0])])]
    R.write("mm", str(tmp_path / "x.mm"), maps)
    assert list(R.read("mm", str(tmp_path / "x.mm"))) == maps
    R.concatenate("mm", [str(tmp_path / "x.mm")] * 2, str(tmp_path / "y.mm"))
    assert list(R.read("mm", str(tmp_path / "y.mm"))) == maps * 2
    profiles = [R.Profile("a", "ACG", [0.5, None, 1.25]), R.Profile("b", "", [])]
    R.write("nrc", str(tmp_path / "x.nrc"), profiles)
    assert list(R.read("nrc", str(tmp_path / "x.nrc"))) == profiles


def test_packing():
    assert R.pack("ACGTN") == bytes([0x01, 0x23, 0x40]) and R.unpack(R.pack("GATTACA"), 7) == "GATTACA"


def test_data_sources(spark, tmp_path):
    R.register(spark)
    data = some_counts()
    R.write("rc", str(tmp_path / "in.rc"), data)
    df = spark.read.format("basewise_rc").option("recordsPerPartition", 7).load(str(tmp_path / "in.rc"))
    assert df.rdd.getNumPartitions() == 6
    assert sorted((r["id"], list(r["counts"])) for r in df.collect()) == sorted((x.id, x.counts) for x in data)
    assert [r["reads"] for r in df.where("id = 't7'").collect()] == [data[7].reads]
    some = spark.read.format("basewise_rc").option("ids", "t7,t9").load(str(tmp_path / "in.rc"))
    assert sorted(r["id"] for r in some.collect()) == ["t7", "t9"]
    df.where(F.size("counts") > 0).write.format("basewise_rc").mode("append").save(str(tmp_path / "out.rc"))
    kept = [x for x in data if x.sequence]
    assert sorted(R.read("rc", str(tmp_path / "out.rc")), key=lambda x: x.id) == sorted(kept, key=lambda x: x.id)
    assert open(tmp_path / "out.rc", "rb").read()[-17:-9] == struct.pack("<Q", sum(x.reads for x in kept))
    R.write("mm", str(tmp_path / "x.mm"), [R.Mutations("a", "ACGT", [(0, 3, [1]), (1, 2, [])])])
    assert [tuple(r)[2:] for r in spark.read.format("basewise_mm").load(str(tmp_path / "x.mm")).collect()] == [(0, 0, 3, [1]), (1, 1, 2, [])]
    R.write("nrc", str(tmp_path / "x.nrc"), [R.Profile("a", "AC", [None, 0.5])])
    assert spark.read.format("basewise_nrc").load(str(tmp_path / "x.nrc")).first()["values"] == [None, 0.5]


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "x.fa", ">a first one\nacgu\nRYN\n\n>b\nTTT\n>a\nGG")
    got = sorted(map(tuple, text.fasta(spark, path).collect()))
    assert got == [("a", "", "GG"), ("a", "first one", "ACGURYN"), ("b", "", "TTT")]
    assert text.repeated(text.fasta(spark, path)).collect()[0]["id"] == "a"
    assert "ACGUNNN" in [r["sequence"] for r in text.fasta(spark, path, mask=True).collect()]
    out = sinks.fasta_records(spark.createDataFrame([("x", "A" * 130)], "id string, sequence string")).first()[0]
    assert [len(x) for x in out.split("\n")] == [2, 60, 60, 10]


def test_structures(spark, tmp_path):
    path = put(tmp_path, "x.db", ">a\nGGAAACC\n((...)) (-1.50)\n>b\nGGAA\n((.)\n>c\nGGAAACCAA\n(([..))]. \n>d\nAC\n.\n")
    got = {r["id"]: r for r in text.vienna(spark, path).collect()}
    assert set(got) == {"a", "c"} and got["a"]["energy"] == -1.5 and got["c"]["energy"] is None
    ct = put(tmp_path, "x.ct", "3 ENERGY = -2.0 one\n1 G 0 2 3 1\n2 A 1 3 0 2\n3 C 2 0 1 3\n2 two\n1 A 0 2 0 1\n2 C 1 0 0 2\n")
    got = {r["id"]: r for r in text.ct(spark, ct).collect()}
    assert [tuple(p) for p in got["one"]["pairs"]] == [(0, 2)] and got["one"]["energy"] == -2.0 and got["two"]["pairs"] == []
    out = "\n".join(sorted(r[0] for r in sinks.ct_records(text.ct(spark, ct)).collect()))
    again = {r["id"]: r["pairs"] for r in text.ct(spark, put(tmp_path, "y.ct", out + "\n")).collect()}
    assert again == {k: v["pairs"] for k, v in got.items()}
    assert sinks.vienna_records(spark.createDataFrame([("a", "GC", "()", -0.5)], "id string, sequence string, structure string, energy double")).first()[0] == ">a\nGC\n() (-0.50)"


def test_sniffing():
    assert text.sniff([">a", "ACGT"]) == "fasta" and text.sniff([">a", "ACGT", "(..)"]) == "vienna"
    assert text.sniff(["4 x", "1 A 0 2 0 1", "2 C 1 3 0 2"]) == "ct" and text.sniff([], "y.db") == "vienna"
    assert text.kind_of("ACGU") == "rna" and text.kind_of("ACGT") == "dna" and text.kind_of("ACGRY") == "iupac" and text.kind_of("!") is None


SAM = """@HD	VN:1.6	SO:coordinate
@SQ	SN:t	LN:20
r1	0	t	3	30	6M	*	0	0	ACGTAC	IIIIII	NM:i:0	MD:Z:6
r2	16	t	1	5	2S4M1D3M	*	0	0	GGACGTACG	IIIIIIIII	MD:Z:2A1^G3
r3	4	*	0	0	*	*	0	0	*	*
r4	0	t	1	30	4M5N4M	*	0	0	ACGTACGT	*	MD:Z:8
"""


def test_sam(spark, tmp_path):
    path = put(tmp_path, "x.sam", SAM)
    got = {r["qname"]: r for r in text.sam(spark, path).collect()}
    assert set(got) == {"r1", "r2", "r4"} and got["r1"]["pos"] == 2 and got["r1"]["tags"] == {"NM": "0", "MD": "6"} and got["r1"]["phred"] == [40] * 6 and got["r4"]["phred"] == []
    assert [tuple(r) for r in text.sam_lengths(spark, path).collect()] == [("t", 20)]
    assert text.sam_facts(SAM.splitlines()) == {"paired": False, "md": False, "order": "coordinate"}
    ref = spark.createDataFrame([("t", "A" * 20)], "id string, sequence string")
    assert text.checked_header(text.sam_lengths(spark, path), ref).count() == 1
    for wrong in ([("t", "A")], [("u", "A")]):
        with pytest.raises(ValueError):
            text.checked_header(text.sam_lengths(spark, path), spark.createDataFrame(wrong, "id string, sequence string"))
    chimera = text.gapped(text.sam(spark, path), 4).collect()
    assert [tuple(r) for r in chimera] == [("t", 0, 3, 9, 12)]


def test_xml(spark, tmp_path):
    df = spark.createDataFrame([("t1", "ACGT" * 20, [None if i % 7 == 0 else i / 3 for i in range(80)]), ("t2", "AC", [0.5, None])], "id string, sequence string, values array<double>")
    for r in sinks.xml_documents(df, {"tool": "basewise", "combined": False, "win": 5}).collect():
        put(tmp_path, f"{r['id']}.xml", r["value"])
    got = {r["id"]: r for r in text.reactivity_xml(spark, f"{tmp_path}/*.xml").collect()}
    assert got["t1"]["sequence"] == "ACGT" * 20 and got["t2"]["reactivity"] == [0.5, None]
    assert got["t1"]["reactivity"] == [None if i % 7 == 0 else round(i / 3 + 1e-12, 3) for i in range(80)]
    assert got["t1"]["attributes"] == {"tool": "basewise", "combined": "FALSE", "win": "5"}
    put(tmp_path, "bad.xml", '<data tool="x">\n<transcript id="b" length="2"><sequence>AC</sequence><reactivity>1</reactivity></transcript>\n</data>')
    with pytest.raises(Exception, match="differ in length"):
        text.reactivity_xml(spark, f"{tmp_path}/bad.xml").collect()
    both = text.profile_folder(spark, {"s1": f"{tmp_path}/t*.xml", "s2": f"{tmp_path}/t2.xml"})
    assert sorted((r["sample"], r["id"]) for r in both.collect()) == [("s1", "t2"), ("s2", "t2")]


def test_tracks_and_annotations(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2, 9), ("a", 0, 0, 9), ("a", 4, 5, 1), ("b", 7, 1, 9)], "id string, pos int, v int, coverage int")
    lines = "\n".join(r[0] for r in sinks.wig_lines(df, "v", coverage=2).collect())
    assert lines == "variableStep chrom=a\n2 2\nvariableStep chrom=b\n8 1"
    assert sorted(map(tuple, text.wig(spark, put(tmp_path, "x.wig", "track type=wiggle_0\n" + lines + "\n")).collect())) == [("a", 1, 2.0), ("b", 7, 1.0)]
    bed = put(tmp_path, "x.bed", "# c\nc1\t5\t9\nc1\t10\t40\tn\t0\t-\t0\t0\t0\t2\t5,10,\t0,20,\n")
    assert sorted(map(tuple, text.bed(spark, bed).collect())) == [("c1", "c1", 5, 8, "+"), ("n", "c1", 10, 14, "-"), ("n", "c1", 30, 39, "-")]
    gtf = put(tmp_path, "x.gtf", 'c\ts\texon\t3\t7\t.\t-\t.\tgene_id "g"; transcript_id "x";\nc\ts\tgene\t3\t7\t.\t-\t.\tgene_id "g";\n')
    assert [tuple(r) for r in text.gtf(spark, gtf).collect()] == [("x", "c", 2, 6, "-")]


def test_chimeras_probabilities_and_lists(spark, tmp_path):
    row = "t\t100\t+\t{}\t10\t{}\t0\t0\t0\tr{}\t61\t30M\t{}\t25M{}"
    j = put(tmp_path, "j", "\n".join([row.format("t", "+", 1, 11, ""), row.format("t", "+", 2, 11, ""), row.format("u", "+", 3, 11, ""), row.format("t", "-", 4, 11, ""), row.format("t", "+", 5, 11, "3N4M"), "x"]))
    assert [tuple(r) for r in text.junctions(spark, j).collect()] == [("t", 10, 34, 60, 89)]
    dp = put(tmp_path, "dp.ps", "%!PS\n1 9 0.5 ubox\n2 8 1e-1 ubox\n2 8 0.9 lbox\n")
    assert [(r["i"], r["j"], round(r["p"], 9)) for r in text.dot_plot(spark, dp).collect()] == [(0, 8, 0.25), (1, 7, 0.01)]
    pt = put(tmp_path, "p.txt", "8\ni\tj\t-log10\n1\t8\t1.0\n")
    assert [(r["i"], r["j"], round(r["p"], 9)) for r in text.probability_table(spark, pt).collect()] == [(0, 7, 0.1)]
    ref = spark.createDataFrame([("t", "AACCGGUUAC")], "id string, sequence string")
    m = put(tmp_path, "m.csv", "# c\nt,2-4,CGG,rc:GTAAC\nu,1-2\n")
    assert sorted(map(tuple, text.masks(spark, m, ref).collect())) == [("t", 2, 4), ("t", 3, 5), ("t", 5, 9), ("u", 1, 2)]
    b = put(tmp_path, "b.txt", "a;1;3-5;3;9-7;x\nb\n")
    got = sorted(((r["id"], r["pos"]) for r in text.positions_list(spark, b).collect()), key=str)
    assert [g for g in got if g[1] is not None] == [("a", 1), ("a", 3), ("a", 4), ("a", 5)] and ("b", None) in got


def test_json_windows(spark, tmp_path):
    w = {"start": 0, "end": 2, "stoichiometries": [0.4, 0.6], "counts": [[1, 2, 3], [0, 1, 0]], "coverage": [[9, 9, 9], [8, 8, 8]], "preCoverage": [10, 20, 30]}
    body = json.dumps({"transcripts": [{"id": "t", "sequence": "ACG", "windows": [w, w | {"stoichiometries": [1.0]}]}]})
    assert json.loads(text.repair_json(body)) == json.loads(body)
    cut = json.loads(text.repair_json(body[: body.rfind("coverage") + 14]))
    assert cut["transcripts"][0]["windows"][0] == w
    assert text.repair_json("") == "{}" and text.repair_json("[") == "{}"
    put(tmp_path, "x.json", body)
    got = text.deconvolution(spark, f"{tmp_path}/x.json", 2, 15).collect()
    assert len(got) == 1 and got[0]["counts"] == w["counts"]
    assert text.deconvolution(spark, f"{tmp_path}/x.json", 1, 25).count() == 0


def test_config_and_checks(spark, tmp_path):
    path = put(tmp_path, "c.conf", "# c\nscore=ding\nremap=yes\nwindow=50\nrate = 0.25\n")
    assert text.config(path) == {"score": "ding", "remap": True, "window": 50, "rate": 0.25}
    with pytest.raises(KeyError):
        text.config(path, {"score": "x"})
    text.write_config(path, {"a": True, "b": 2})
    assert text.config(path, {"a": False, "b": 1}) == {"a": True, "b": 2}
    assert text.fastq_faults(spark, put(tmp_path, "a.fq", "@r\nACGT\n+\nIIII\n")) == [] and text.fastq_faults(spark, put(tmp_path, "b.fq", "@r\nACGT\n+\nIII\n")) == ["read 1"]
    assert text.aligner_statistics("# reads processed: 10\n# reads with at least one reported alignment: 7 (70%)\n# reads that failed to align: 3 (30%)\n") == {"processed": 10, "unique": 7, "failed": 3}


def test_small_writers(spark, tmp_path):
    dots = spark.createDataFrame([(1, 2, 0.1), (0, 3, 1.0), (4, 5, 0.0)], "i int, j int, p double")
    assert [r[0] for r in sinks.dot_plot_lines(dots).collect()] == ["1\t4\t0.000000", "2\t3\t1.000000"]
    assert sinks.transfac([{"A": 3}, {"C": 1, "G": 2}], "m", "AS").splitlines()[3:5] == ["01\t3\t0\t0\t0\tA", "02\t0\t1\t2\t0\tS"]
    sinks.write_text(sinks.dot_plot_lines(dots), str(tmp_path / "d.txt"), single=True)
    assert (tmp_path / "d.txt").read_text() == "1\t4\t0.000000\n2\t3\t1.000000\n"
    sinks.write_table(dots, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "t")).count() == 3
