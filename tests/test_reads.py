"""Read selection, writers, dialects, presets and sweeps on worked examples."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tagmill.plans import pipeline, statistics
from tagmill.sources import dialects, sinks, tables


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_asarusim_with_an_adapter(spark):
    records = spark.createDataFrame([("c-1-UU-T5-7 x", "ACGTTTTTGAGAGAG", "I"), ("c-2-VV-T6-8", "ACGAGAGAAAAAAAA", "I"), ("odd", "AC", "I")], "name string, seq string, qual string")
    truth = spark.createDataFrame([("c-1-UU-T5-7",), ("c-1-UU-T5-7",)], "id string")
    got = dialects.asarusim(records, truth, cb_len=3, umi_len=2, adapter="GAGA")
    assert rows(got, "name", "CB", "MB", "TB", "XT") == [("c-1-UU-T5-7", "ACG", "TT", "UU", "T5"), ("c-2-VV-T6-8", "ACG", "AG", "", "T6"), ("odd", "AC", "", "", "")]


def test_molecules_across_parts_of_a_file(spark):
    lines = ["", "chr0 1 2 +", "+A\tdepth=1", "chr1 1 2 +", "AAAA 0 4", "ACGTA 0 5", "+B info(CB=cb;TB=tb;tid=t;)", "chr2 1 2 +"]
    far = 1 << 17  # the last molecule's lines lie in another part
    df = spark.createDataFrame([(i if i < 7 else far + i, v) for i, v in enumerate(lines)], "line long, value string")
    assert rows(dialects.molecules(df, 5), "id", "CB", "TB", "tid", "XT") == [("A", None, "ACGTA", None, "chr1"), ("B", "cb", "tb", "t", "chr2")]


def test_short_reads_fail_or_have_no_tags(spark):
    df = spark.createDataFrame([("a:b", "ACG")], "name string, seq string")
    assert rows(dialects.screadsim(df, cb_len=2, umi_len=2), "CB", "MB", "TB", "XT") == [("AC", None, None, "NA")]
    with pytest.raises(Exception, match="slice outside the read"):
        dialects.minnow(df, cb_len=2, umi_len=2).collect()


def test_tagged_records_go_to_alignment_lines_and_back(spark, tmp_path):
    records = spark.createDataFrame([("1*c*4*g*9*_x", "ACGT", "IIII")], "name string, seq string, qual string")
    tagged = dialects.unaligned(dialects.starred(records, "SP"))
    tables.write_sam(tagged, str(tmp_path / "sam"), ["SP", "XT", "XS"])
    assert rows(tables.sam(spark, str(tmp_path / "sam"), ["SP", "XT", "XS"]), "qname", "flag", "chrom", "SP", "XT", "XS") == [("1*c*4*g*9*_x", 4, None, "4", "9", "Assigned")]


def test_selection_order_and_tags(spark, tmp_path):
    reads = spark.createDataFrame([(1, "b", 5, "x", 1), (2, "a", 9, "y", 3), (3, None, 1, "x", 2), (4, "a", 2, None, 9), (2, "a", 9, "y", 3)], "id long, chrom string, pos int, qname string, qual int")
    assert rows(sinks.unique_reads(reads, reads.where("id < 3").select("id")), "id", "pos") == [(1, 5), (2, 9)]
    once = reads.dropDuplicates(["id"])
    assert rows(sinks.with_ordinal(once), "ordinal", "id") == [(0, 4), (1, 2), (2, 1), (3, 3)]
    sinks.coordinate_sorted(once, partitions=2).write.parquet(str(tmp_path / "sorted"))
    files = sorted((tmp_path / "sorted").glob("part-*.parquet"))
    assert [r["id"] for f in files for r in spark.read.parquet(str(f)).collect()] == [4, 2, 1, 3]
    tags = spark.createDataFrame([("x", "t2", 1), ("x", "t1", 2), (None, "n", 3)], "qname string, XT string, qual int")
    assert rows(sinks.with_tags(once, tags), "id", "XT", "qual") == [(1, "t1", 2), (2, None, None), (3, "t1", 2), (4, None, None)]
    best = sinks.representatives(once, ["qname"], best=F.col("qual"), mode="mark")
    assert rows(best, "id", "PD") == [(1, 1), (2, 0), (3, 0), (4, 1)]
    assert rows(sinks.representatives(once, ["qname"]), "id") == [(1,), (2,)]
    with pytest.raises(ValueError):
        sinks.representatives(once, ["qname"], mode="drop")


@pytest.mark.parametrize(("compression", "ending"), [("none", ".csv"), ("gzip", ".csv.gz"), ("bzip2", ".csv.bz2")])
def test_delimited_tables_come_back(spark, tmp_path, compression, ending):
    df = spark.createDataFrame([("a", 1, None), ("b\"q", 2, "x y")], "gene string, n int, note string")
    sinks.write_delimited(df, str(tmp_path / "t"), compression=compression)
    assert all(f.name.endswith(ending) for f in (tmp_path / "t").glob("part-*"))
    back = tables.delimited(spark, str(tmp_path / "t"))
    assert rows(back, "gene", "n", "note") == [("a", "1", None), ('b"q', "2", "x y")]


def test_representatives_as_json(spark, tmp_path):
    a = spark.createDataFrame([("g", 1, 1), ("g", 5, 1), ("h", 7, 7)], "gene string, node long, rep long")
    sinks.write_representatives(a, str(tmp_path / "j"), ["gene"])
    lines = [json.loads(x) for f in sorted((tmp_path / "j").glob("part-*")) for x in f.read_text().splitlines()]
    assert sorted(lines, key=str) == [{"gene": "g", "rep": 1, "nodes": [1, 5]}, {"gene": "h", "rep": 7, "nodes": [7]}]


def test_result_files(spark, tmp_path):
    for name, text in (("a", "target_id\tdedup_cnt\nt1\t5\nt2\tx\n"), ("b", "gene\tdedup_cnt\ng\t2\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r_0.1.tsv.gz").write_bytes(gzip.compress(text.encode()))
    files = statistics.file_map({"A": "a", "B": "b"}, [0.1], str(tmp_path) + "/{method}/r_{er}.tsv.gz")
    assert rows(statistics.load_results(spark, files), "method", "error_rate", "transcript_id", "dedup_cnt") == [("A", 0.1, "t1", 5.0), ("B", 0.1, "g", 2.0)]
    with pytest.raises(ValueError):
        statistics.load_results(spark, {})
    with pytest.raises(ValueError):
        statistics.counts_of(spark.createDataFrame([(1,)], "dedup_cnt int"))


def test_presets_and_sweeps(spark):
    reads = spark.createDataFrame([(1, "AAAA", "c", "g", "spike"), (2, "AAAA", "c", "g", "spike"), (3, "AAAT", "c", "g", "chr1"), (4, "CCCC", "c", None, "chr1"), (5, None, "c", "g", "chr1")], "id long, MB string, CB string, XT string, contig string")
    count = lambda run: run.assign("unique").count()
    assert count(pipeline.preset("tksm", reads)) == 2 and count(pipeline.preset("cmi", reads)) == 3 and count(pipeline.preset("spikein", reads, spikes=["spike"])) == 1
    with pytest.raises(ValueError):
        pipeline.preset("spikein", reads)
    with pytest.raises(KeyError):
        pipeline.preset("none", reads)
    swept = pipeline.sweep(pipeline.preset("cmi", reads), "directional", "ratio", [1.0, 5.0])
    assert rows(swept, "CB", "ratio", "dedup_cnt") == [("c", 1.0, 2), ("c", 5.0, 3)]


def test_fastq_parts_hold_every_record_once(spark, tmp_path):
    rng = random.Random(2)
    want = []
    for name in ("a.fastq", "b.fq.gz"):
        text = ""
        for i in range(300):
            n = rng.randint(1, 40)
            seq, qual = "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@+I#") for _ in range(n))
            want.append((f"{name}{i} x", seq, qual))
            text += f"@{name}{i} x\n{seq}\n+{rng.choice(['', name])}\n{qual}\n"
        data = text.encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    for split in (97, 1000, 1 << 26):
        for path in (str(tmp_path), f"{tmp_path}/a.*,{tmp_path}/b.fq.gz", f"file://{tmp_path}"):
            assert rows(tables.fastq(spark, path, split_bytes=split), "name", "seq", "qual") == sorted(want, key=str)
    (tmp_path / "c.fastq").write_bytes(b"@x\r\nAC\r\n+\r\nII\r\n\r\n")
    assert rows(tables.fastq(spark, str(tmp_path / "c.fastq")), "name", "seq", "qual") == [("x", "AC", "II")]
    (tmp_path / "d.fastq").write_bytes(b"@x\nAC\n+\nII\n@y\nAC\n")
    with pytest.raises(Exception, match="no complete record"):
        tables.fastq(spark, str(tmp_path / "d.fastq")).collect()
    (tmp_path / "e.fastq").write_bytes(b"")
    assert tables.fastq(spark, str(tmp_path / "e.fastq")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        tables.fastq(spark, str(tmp_path / "nowhere.fastq")).collect()
