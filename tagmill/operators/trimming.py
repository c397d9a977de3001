"""Read-structure trimming: segments of a read as substrings at planned offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan(structure: str, lengths: dict[str, int]) -> list[tuple[str, int, int]]:
    """(segment, start, length) of ``bc_1+umi_1+seq_1`` and the like; starts are sums of what precedes."""
    out, at = [], 0
    for segment in structure.split("+"):
        segment = segment.strip()
        if segment not in lengths:
            raise KeyError(f"no length for segment {segment}")
        out.append((segment, at, lengths[segment]))
        at += lengths[segment]
    return out


def trim(reads: DataFrame, structure: str, lengths: dict[str, int], seq: str = "seq_raw") -> DataFrame:
    """Add a column for each bc, umi and seq segment, ``umi`` and ``seq`` joined from theirs.

    Primers and other segments only move the offsets. A read without seq segment gets
    seq_1 = "B".
    """
    kinds: dict[str, list[str]] = {"bc": [], "umi": [], "seq": []}
    for segment, start, length in plan(structure, lengths):
        kind = segment.split("_")[0]
        if kind in kinds:
            reads = reads.withColumn(segment, F.substring(seq, start + 1, length))
            kinds[kind].append(segment)
    if not kinds["seq"]:
        reads = reads.withColumn("seq_1", F.lit("B"))
        kinds["seq"] = ["seq_1"]
    for kind in ("bc", "umi", "seq"):
        if kinds[kind]:
            reads = reads.withColumn(kind, F.concat(*kinds[kind]))
    return reads


def between(seq: Column, before: str, after: str) -> Column:
    """What lies between the first ``before`` and the next ``after``; null if either is missing."""
    start = F.locate(before, seq) + len(before)
    rest = F.substr(seq, start)
    return F.when((F.locate(before, seq) > 0) & (F.locate(after, rest) > 0), F.substr(rest, F.lit(1), F.locate(after, rest) - 1))


def spike_barcode(reads: DataFrame, *, before: str | None = None, after: str | None = None, start: int | None = None, end: int | None = None, length: int | None = None, seq: str = "seq") -> DataFrame:
    """spikeUMI by motifs, or by 1-based places (with seqAfterUMI up to base 48 of longer reads)."""
    if before is not None:
        df = reads.withColumn("spikeUMI", between(F.col(seq), before, after))
    else:
        df = reads.withColumn("spikeUMI", F.when(F.length(seq) >= end, F.substring(seq, start, end - start + 1)))
        df = df.withColumn("seqAfterUMI", F.when(F.length(seq) >= 48, F.substring(seq, end + 1, 48 - end)))
    df = df.where("spikeUMI is not null")
    return df.where(F.length("spikeUMI") == length) if length else df


def anchor_share(reads: DataFrame, anchor: str, seq: str = "seq", full_length: int = 92) -> DataFrame:
    """anchored: share of reads with the anchor; full: share of full length."""
    return reads.agg(F.avg(F.contains(F.col(seq), F.lit(anchor)).cast("int")).alias("anchored"), F.avg((F.length(seq) == full_length).cast("int")).alias("full"))
