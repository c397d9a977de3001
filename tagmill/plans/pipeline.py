"""Pipelines over many conditions at once: permutation and condition are key columns, not loops."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import umi as U
from tagmill.operators import dedup, local, summary
from tagmill.operators.graphs import build_edges, build_nodes, settle


class Dedup:
    """Reads grouped at any granularity; nodes and edges are built once for all methods.

    ``collapse`` is a column function applied to the barcode first (homopolymer votes);
    ``quality``, where the reads have it, goes into the Bayesian merges.
    """

    def __init__(self, reads: DataFrame, keys: list[str], umi: str = "umi", read_id: str = "id", ed: int = 1, rule: str = "eq", collapse=None, quality: str = "qual"):
        self.reads = reads.withColumn(umi, collapse(F.col(umi))) if collapse else reads
        self.keys, self.umi, self.read_id, self.quality = keys, umi, read_id, quality
        self.nodes = settle(build_nodes(self.reads, keys, umi, read_id))
        self.edges = settle(build_edges(self.nodes, keys, ed, rule, counts=True))

    def assign(self, method: str, **options) -> DataFrame:
        if method in dedup.METHODS:
            return dedup.METHODS[method](self.nodes, self.edges, self.keys, **options)
        if method in ("mcl", "mcl_val", "mcl_ed"):
            return getattr(local, method)(self.nodes, self.edges, self.keys, **options)
        if method in ("dbscan", "birch", "affinity_propagation", "hdbscan"):
            return local.point_clusters(self.nodes, self.edges, self.keys, method, **options)
        if method == "set_cover":
            return local.set_cover(self.nodes, self.keys, **options)
        if method == "dropest":
            nodes = build_nodes(self.reads, self.keys, self.umi, self.read_id, self.quality) if self.quality in self.reads.columns else self.nodes
            return local.bayes_merge(settle(nodes), self.edges, self.keys, **options)
        if method == "dropest_classic":
            return local.classic_merge(self.nodes, self.edges, self.keys, **options)
        raise KeyError(f"no method {method}")

    def summary(self, method: str, **options) -> DataFrame:
        return summary.summarize(self.assign(method, **options), self.keys)

    def marked(self, method: str, **options) -> DataFrame:
        return summary.mark(self.reads, self.assign(method, **options), self.keys, self.umi, self.read_id)

    def kept(self, method: str, **options) -> DataFrame:
        return summary.kept_reads(self.reads, self.assign(method, **options), self.read_id)


def multi_position(reads: DataFrame, **o) -> Dedup:
    return Dedup(reads, ["PO"], **o)


def one_position(reads: DataFrame, **o) -> Dedup:
    return Dedup(reads.withColumn("source", F.lit(1)), ["source"], **o)


def by_gene(reads: DataFrame, gene: str = "XT", assigned: str | None = "XS", **o) -> Dedup:
    return Dedup(reads.where(F.col(assigned) == "Assigned") if assigned else reads, [gene], **o)


def single_cell(reads: DataFrame, cell: str = "bc", gene: str = "XT", assigned: str | None = "XS", **o) -> Dedup:
    return Dedup(reads.where(F.col(assigned) == "Assigned") if assigned else reads, [cell, gene], **o)


#: Grouping, barcode column and what a preset does to the reads first, by technology.
PRESETS = {
    "spikein": {"keys": ["CB"], "spikes": True},
    "cmi": {"keys": ["CB"]},
    "tresor": {"keys": ["CB", "XF"]},
    "tksm": {"keys": ["CB", "XT"]},
    "minnow": {"keys": ["CB", "XT"]},
    "screadsim": {"keys": ["CB", "XT"]},
    "asarusim": {"keys": ["CB", "XT"]},
    "seqtech": {"keys": ["XT"]},
}


def preset(name: str, reads: DataFrame, *, umi: str = "MB", spikes: list[str] | None = None, contig: str = "contig", **options) -> Dedup:
    """A technology's reads at its grouping; reads without a key or barcode take no part, of spike-ins only the named contigs'."""
    if name not in PRESETS:
        raise KeyError(f"no preset {name}")
    keys = PRESETS[name]["keys"]
    if PRESETS[name].get("spikes"):
        if not spikes:
            raise ValueError("name the contigs of the spike-ins")
        reads = reads.where(F.col(contig).isin(spikes))
    return Dedup(reads.dropna(subset=[*keys, umi]), keys, umi=umi, **options)


def sweep(run: Dedup, method: str, parameter: str, values: list, **options) -> DataFrame:
    """keys, the parameter's value and dedup_cnt of a method under each value, over the same nodes and edges."""
    out = None
    for value in values:
        part = run.assign(method, **{parameter: value}, **options).groupBy(*run.keys).agg(F.sum((F.col("node") == F.col("rep")).cast("long")).alias("dedup_cnt"))
        part = part.select(*run.keys, F.lit(value).alias(parameter), "dedup_cnt")
        out = part if out is None else out.unionByName(part)
    return out


def majority_vote(reads: DataFrame, keys: list[str], umi: str = "umi", k: int = 3, seed: int | None = None, read_id: str = "id") -> DataFrame:
    """keys, monomer, multimers, shortlisted (the last multimer by first read), cnt."""
    nodes = build_nodes(reads, keys, umi, read_id).withColumn("monomer", U.majority_vote(F.col("umi"), k, seed))
    return nodes.groupBy(*keys, "monomer").agg(F.count("*").alias("multimers"), F.max_by("umi", "node").alias("shortlisted"), F.sum("cnt").alias("cnt"))


def standard(reads: DataFrame, method: str = "directional", by: tuple[str, ...] = ("permutation", "condition"), **options) -> DataFrame:
    """permutation, condition, dedup_cnt of a whole experiment in one job."""
    return Dedup(reads, list(by)).summary(method, **options).select(*by, "dedup_cnt")


def as_matrix(counts: DataFrame) -> DataFrame:
    """One row a condition, one column a permutation."""
    return counts.groupBy("condition").pivot("permutation").agg(F.first("dedup_cnt"))


def heterogeneity(reads: DataFrame, origin: Column, by: tuple[str, ...] = ("permutation", "condition"), method: str = "directional") -> tuple[DataFrame, DataFrame]:
    """Counts, and trace edges by origin of both ends."""
    from tagmill.plans.statistics import origin_edges

    d = Dedup(reads.withColumn("origin", origin), list(by))
    assignment = settle(d.assign(method))
    origins = d.reads.join(d.nodes.select("node"), F.col(d.read_id) == F.col("node"), "left_semi").select(F.col(d.read_id).alias("node"), "origin")
    traced = dedup.trace(assignment, d.nodes, d.edges).join(d.nodes.select(F.col("node").alias("src"), *by), "src")
    return summary.summarize(assignment, list(by)).select(*by, "dedup_cnt"), origin_edges(traced, origins, list(by))


#: Library barcodes that are broadcast at a time.
LIBRARY_BLOCK = 20_000


def heal(reads: DataFrame, library: DataFrame, umi: str = "umi", most: int | None = None) -> DataFrame:
    """Reads with the library barcode closest to their collapsed one, and its distance; ties by name.

    Barcodes of the library's one length find a reference at most one base away by masked
    equi-joins. All others are compared with the whole library, in broadcast blocks of a
    fixed size. Null barcodes have no reference, null references take no part.
    """
    known = library.where("reference is not null").select("reference").distinct()
    collapsed = reads.withColumn("monomer", F.when(F.col(umi).isNotNull(), U.majority_vote(F.col(umi))))
    distinct = settle(collapsed.where("monomer is not null").select("monomer").distinct())
    size, shortest, longest = known.agg(F.count("*"), F.min(F.length("reference")), F.max(F.length("reference"))).first()
    best, rest = [], distinct
    if size and shortest == longest and shortest > 0:
        # one length: a reference within one base agrees in all but one place
        masks = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.lit(shortest)), lambda i: F.struct(i.alias("i"), F.overlay(c, F.lit("*"), i).alias("t"))))
        alike = distinct.where(F.length("monomer") == shortest)
        pairs = alike.select("monomer", masks(F.col("monomer")).alias("m")).join(known.select("reference", masks(F.col("reference")).alias("m")), "m")
        near = pairs.withColumn("ed", (F.col("monomer") != F.col("reference")).cast("int"))
        near = settle(near.groupBy("monomer").agg(F.min(F.struct("ed", "reference")).alias("b")))
        best, rest = [near], settle(distinct.join(near.select("monomer"), "monomer", "left_anti"))
    blocks = -(-size // LIBRARY_BLOCK)
    for b in range(blocks):
        block = known.where(F.pmod(F.xxhash64("reference"), F.lit(blocks)) == b)
        rows = [r["reference"] for r in block.collect()]
        best.append(_nearest(rest, rows))
    pairs = reduce(DataFrame.unionByName, best) if best else distinct.limit(0).withColumn("b", F.struct(F.lit(0).alias("ed"), F.col("monomer").alias("reference")))
    nearest = pairs.groupBy("monomer").agg(F.min("b").alias("b")).select("monomer", "b.reference", "b.ed")
    out = collapsed.join(nearest, "monomer", "left")
    return out.where(F.col("ed") <= most) if most is not None else out


def _nearest(distinct: DataFrame, references: list[str]) -> DataFrame:
    """monomer and b: the least (ed, reference) of a list, over the common length of both."""
    shared = distinct.sparkSession.sparkContext.broadcast(sorted(references))

    def search(batches):
        by_length: dict[int, list[str]] = {}
        for r in shared.value:
            by_length.setdefault(len(r), []).append(r)
        codes = {k: np.array([list(map(ord, r)) for r in rs], np.int32).reshape(len(rs), k) for k, rs in by_length.items()}
        for batch in batches:
            out = []
            for monomer in batch.column(0).to_pylist():
                own, found = np.array(list(map(ord, monomer)), np.int32), []
                for k, table in codes.items():
                    n = min(k, len(own))
                    differ = (table[:, :n] != own[:n]).sum(axis=1)
                    at = int(differ.argmin())  # the first of the least: names are sorted
                    found.append({"ed": int(differ[at]), "reference": by_length[k][at]})
                out.append(min(found, key=lambda b: (b["ed"], b["reference"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.struct([("ed", pa.int32()), ("reference", pa.string())]))], ["monomer", "b"])

    return distinct.select("monomer").mapInArrow(search, "monomer string, b struct<ed:int,reference:string>") if references else distinct.limit(0).withColumn("b", F.struct(F.lit(0).alias("ed"), F.col("monomer").alias("reference")))
