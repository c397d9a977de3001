"""Barcode functions, trimming, sources and statistics."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tagmill import config
from tagmill.functions import umi as U
from tagmill.operators import counting, kernels, trimming
from tagmill.plans import pipeline, statistics
from tagmill.sources import bam, tables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_multimers(spark):
    text = "AAACCCGGGTTTGGGAAATTTGGGCCCCCC"
    assert value(spark, U.split_by_vote(F.lit(text))) == ["ACGTGATGCC"]
    sizes = [len(value(spark, U.split_to_all(F.lit(t)))) for t in ("AAATCCGGATTTCGGAAATTTGGGCACCCC", "AAATCCGGATTTCGGAAATTTGGGCCCCCC", "AAATCCGGATTTGGGAAATTTGGGCCCCCC", "AAATCCGGGTTTGGGAAATTTGGGCCCCCC")]
    assert sizes == [16, 8, 4, 2]
    assert value(spark, U.majority_vote(F.lit("AAATCCGGGTTTGGGAAATTTGGGCCCCCC"))) == "ACGTGATGCC"
    assert value(spark, U.take_by_order(F.lit("AAATCCGGGTTTGGGAAATTTGGGCCCCCC"))) == "ATGTGATGCC"
    assert [sorted(value(spark, U.vote_set(F.lit(b)))) for b in ("AAA", "TAA", "TGA")] == [["A"], ["A"], ["A", "G", "T"]]
    assert value(spark, U.expand(F.lit("ACG"))) == "AAACCCGGG" and value(spark, U.expand(F.lit(" "))) is None


def test_error_model(spark):
    p = F.lit(1e-5)
    assert value(spark, U.block_error(p)) == pytest.approx(2.333320000000001e-10, rel=1e-12)
    assert value(spark, U.bitflip_error(p)) == pytest.approx(2.9999800000000003e-10, rel=1e-12)
    assert value(spark, U.barcode_error(U.block_error(p), 12)) == pytest.approx(2.799984244461484e-09, rel=1e-6)
    assert value(spark, U.barcode_error(p, 12)) == pytest.approx(1.1999340021939808e-4, rel=1e-9)


def test_hamming(spark):
    assert value(spark, U.hamming(F.lit("ACGT"), F.lit("ACGA"))) == 1
    assert value(spark, U.hamming(F.lit("ACGT"), F.lit("AG"))) == 1
    assert value(spark, U.hamming_strict(F.lit("ACGT"), F.lit("AC"))) == 4
    assert value(spark, U.packed_hamming(U.pack(F.lit("ACGTT")), U.pack(F.lit("TCGAT")))) == 2
    assert value(spark, U.one_hot(F.lit("AN"))) == [1, 0, 0, 0, 0, 0, 1, 0]


def test_errors_are_seeded(spark):
    u = F.lit("ACGTACGTACGT")
    assert value(spark, U.substitute(u, 0.0, 1)) == "ACGTACGTACGT"
    assert value(spark, U.substitute(u, 0.5, 1)) == value(spark, U.substitute(u, 0.5, 1))
    assert value(spark, U.delete(u, 1.0, 1)) == "" and len(value(spark, U.insert(u, 1.0, 1))) == 24


def test_trimming(spark):
    reads = spark.createDataFrame([("AACCCGGGGT",)], "seq_raw string")
    row = trimming.trim(reads, "bc_1+umi_1+primer_1+umi_2", {"bc_1": 2, "umi_1": 3, "primer_1": 4, "umi_2": 1}).first()
    assert (row["bc"], row["umi_1"], row["umi_2"], row["umi"], row["seq"]) == ("AA", "CCC", "T", "CCCT", "B")
    with pytest.raises(KeyError):
        trimming.plan("umi_9", {})
    assert value(spark, trimming.between(F.lit("xxAAyyBB"), "AA", "BB")) == "yy" and value(spark, trimming.between(F.lit("BBAA"), "AA", "BB")) is None


def test_kernels():
    assert kernels.set_cover(["AAACCC", "AAACCT", "GGGTTT"]) == [["AAACCC", "AAACCT"], ["GGGTTT"]]
    x = kernels.one_hot(["AAAA", "AAAC", "GGGG", "GGGT", "TTTT"])
    assert kernels.dbscan(x).tolist() == [0, 0, 1, 1, 2]
    assert len(set(kernels.hdbscan(kernels.one_hot(["AAAA"] * 6 + ["GGGG"] * 6), 2, 3).tolist())) == 2
    w = kernels.redistribute([{"a": 2.0, "b": 2.0}, {"a": 1.0}])
    assert w["a"] > w["b"] and sum(w.values()) == pytest.approx(3.0)
    assert kernels.parent_paths({1: 5, 2: 1, 3: 2}, {1: {"x"}, 2: {"x"}, 3: {"y"}}, [(1, 2)]) == [(1, [1, 2]), (3, [3])]


def test_affinity_of_worked_barcodes():
    umis = ["AGATCTCGCA", "AGATCCCGCA", "AGATCACGCA", "AGATCGCGCA", "AGATCGCGGA", "AGATCGCGTA", "TGATCGCGAA"]
    assert len(set(kernels.affinity_propagation(kernels.one_hot(umis)).tolist())) in (3, 4)


def test_counting(spark):
    reads = spark.createDataFrame([("c", "g", "u", 2), ("c", "g", "u", 2), ("c", "g", "v", 2), ("c", "g", "w", 0), ("c", None, "w", 1)], "cell string, gene string, umi string, nh int")
    assert counting.umis_counts(counting.umis_evidence(reads)).first()["molecules"] == 2
    m = spark.createDataFrame([(n,) for n in (1, 2, 2, 3, 9)], "reads int")
    assert [counting.auto_threshold(m, q) for q in (0.0, 0.5, 0.99)] == [1, 2, 3]
    assert counting.auto_threshold(m.limit(0)) == 1


def test_statistics(spark):
    long = spark.createDataFrame([("m", float(v)) for v in (50, 55, 60)], "method string, count double")
    row = statistics.permutation_stats(long, ["method"], 50.0).first()
    assert (row["mean"], row["max"], row["min"]) == pytest.approx((0.1, 0.2, 0.0))
    compat = statistics.permutation_stats(long, ["method"], 50.0, compat=True).first()["std"]
    import numpy as np

    assert compat == pytest.approx(np.std([0, 0.1, 0.2, 0.1, 0.2, 0.0], ddof=1))
    with pytest.raises(ValueError, match="missing"):
        statistics.abundance(long)


def test_fastq_and_sam(spark, tmp_path):
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\n@@\n")
    assert [tuple(r) for r in tables.fastq(spark, str(tmp_path / "a.fq.gz")).collect()] == [("r1 x", "ACGT", "IIII"), ("r2", "GG", "@@")]
    tables.write_fastq(spark.createDataFrame([("a", "b", "ACG")], "x string, y string, seq string"), str(tmp_path / "out"), ["x", "y"])
    assert tables.fastq(spark, str(tmp_path / "out")).first() == ("a_b", "ACG", "sss")
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\nr1\t0\tchr1\t7\t60\t4M\t*\t0\t0\tACGT\tIIII\tXT:Z:g1\tNH:i:2\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n")
    rows = tables.sam(spark, str(tmp_path / "a.sam"), ["XT", "NH"]).orderBy("qname").collect()
    assert (rows[0]["chrom"], rows[0]["pos"], rows[0]["XT"], rows[0]["NH"]) == ("chr1", 7, "g1", "2") and rows[1]["XT"] is None and rows[1]["chrom"] is None
    tables.write_sam(tables.sam(spark, str(tmp_path / "a.sam"), ["XT"]), str(tmp_path / "sam"), ["XT"])
    assert tables.sam(spark, str(tmp_path / "sam"), ["XT"]).where("XT = 'g1'").count() == 1


def _bgzf(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def test_bam(spark, tmp_path):
    def record(name, ref, pos, flag, seq, tags):
        packed = bytes(("=ACMGRSVTWYHKDBN".index(a) << 4) | "=ACMGRSVTWYHKDBN".index(b) for a, b in zip(seq[::2], (seq + "=")[1::2], strict=True))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, 1, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + b"\x1e" * len(seq) + tags
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    data = head + record("r1", 0, 9, 64, "ACGTN", b"XTZgene\0NHC\x02") + record("r2", -1, -1, 20, "AC", b"")
    (tmp_path / "a.bam").write_bytes(_bgzf(data[:50]) + _bgzf(data[50:]) + _bgzf(b""))
    spark.dataSource.register(bam.BamDataSource)
    df = spark.read.format("bam").option("bam_fields", "qname,chrom,pos,cigar,seq,is_read1,is_reverse").option("tag_whitelist", "XT,NH").load(str(tmp_path / "a.bam"))
    assert [tuple(r) for r in df.collect()] == [("r1", "chr1", 9, "5M", "ACGTN", True, False, "gene", "2"), ("r2", None, -1, "2M", "AC", False, True, None, None)]
    for name in ("b.bam", "b.bam.bai"):
        (tmp_path / name).write_bytes(_bgzf(data) if name.endswith("bam") else b"index")
    for path in (str(tmp_path), f"{tmp_path}/*.bam", f"{tmp_path}/a.bam,{tmp_path}/b.bam"):
        ids = [r["id"] for r in spark.read.format("bam").option("bam_fields", "id").load(path).collect()]
        assert sorted(ids) == [0, 1, 1 << bam.ID_BITS, (1 << bam.ID_BITS) + 1]


def test_names_and_bundles(spark):
    df = tables.tag_from_name(spark.createDataFrame([("a_BC:UM",), ("x",)], "qname string"))
    assert [(r["CB"], r["MB"]) for r in df.collect()] == [("BC", "UM"), (None, "x")]
    assert tables.mock_reads(spark, {"A": "ACG", "B": "TTT"}, {"A": 2, "B": 1}).count() == 3
    assert value(spark, tables.slice_at(F.lit("ACGTAC"), -2, 2)) == "AC"


def test_config():
    got = config.parse("work_dir: /x\nfixed:\n  n: 50\n  birch_n_clusters: None\nvaried:\n  seq:\n  - 0.1\n  - 1e-3\n  list: [1, 2]\ndedup:\n  method: directional\n")
    assert got == {"work_dir": "/x", "fixed": {"n": 50, "birch_n_clusters": None}, "varied": {"seq": [0.1, 0.001], "list": [1, 2]}, "dedup": {"method": "directional"}}


@pytest.mark.parametrize(("n", "lengths", "block"), [(10_500, (9,), None), (300, (9,), 70), (300, (7, 9), 70)])
def test_healing_at_every_size(spark, monkeypatch, n, lengths, block):
    if block:
        monkeypatch.setattr(pipeline, "LIBRARY_BLOCK", block, raising=False)
    rng = random.Random(n)
    say = lambda bases: "".join(rng.choice(bases) for _ in range(rng.choice(lengths)))
    known = set()
    while len(known) < n:
        known.add(say("ACG"))
    monomers = [*sorted(known)[:10], *(say("ACG") for _ in range(20)), *(say("ACGTTT") for _ in range(20)), "TTTTTTTTT", "AC", None]
    far = lambda a, b: sum(x != y for x, y in zip(a, b, strict=False))
    want = {i: min((far(m, r), r) for r in known) if m else (None, None) for i, m in enumerate(monomers)}
    reads = spark.createDataFrame([(i, m and "".join(3 * c for c in m)) for i, m in enumerate(monomers)], "id long, umi string")
    library = spark.createDataFrame([(r,) for r in [*known, *sorted(known)[:5], None]], "reference string")
    assert {r["id"]: (r["ed"], r["reference"]) for r in pipeline.heal(reads, library).collect()} == want
    assert max(w[0] for w in want.values() if w[0] is not None) >= 2
    assert {r["id"] for r in pipeline.heal(reads, library, most=2).collect()} == {i for i, w in want.items() if w[0] is not None and w[0] <= 2}
    assert pipeline.heal(reads, library.limit(0)).where("reference is null").count() == len(monomers)
