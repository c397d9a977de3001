"""Molecule counting that works on reads: evidence, positions, loss correction, equivalence classes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagmill.functions import umi as U
from tagmill.operators import kernels as K
from tagmill.operators.graphs import both_ways, build_edges

#: Flag bits of alignments.
PAIRED, UNMAPPED, REVERSE, READ1, READ2, SECONDARY, SUPPLEMENTARY = 1, 4, 16, 64, 128, 256, 2048


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


# evidence counting
def umis_evidence(reads: DataFrame, cell: str = "cell", gene: str = "gene", umi: str = "umi", hits: str = "nh", position: str | None = None) -> DataFrame:
    """cell, gene, umi, evidence: reads weigh one over their number of hits (none or less than one: 1)."""
    keys = [cell, gene, umi] + ([position] if position else [])
    weight = 1.0 / F.when(F.col(hits) > 0, F.col(hits)).otherwise(1)
    return reads.dropna(subset=[cell, gene, umi]).groupBy(*keys).agg(F.sum(weight).alias("evidence"))


def umis_counts(evidence: DataFrame, least: float = 1.0, cell: str = "cell", gene: str = "gene") -> DataFrame:
    """cell, gene, molecules with evidence of at least ``least``."""
    return evidence.where(F.round("evidence", 9) >= least).groupBy(cell, gene).agg(F.count("*").alias("molecules"))


def resolve_gene(reads: DataFrame, tag: str = "tag", reference: str = "contig") -> DataFrame:
    """gene: first name of a comma list, without placeholders; the reference only if no read has a tag."""
    first = F.trim(F.split(tag, ",")[0])
    gene = F.when(first.isin("None", "nan", ""), None).otherwise(first)
    df = reads.withColumn("gene", gene)
    tagged = df.where("gene is not null").limit(1).isEmpty()
    return df.withColumn("gene", F.col(reference)) if tagged else df


def to_matrix(counts: DataFrame, row: str = "gene", column: str = "cell", value: str = "molecules") -> DataFrame:
    return counts.groupBy(row).pivot(column).agg(F.sum(value)).na.fill(0)


def from_matrix(matrix: DataFrame, row: str = "gene", column: str = "cell", value: str = "molecules") -> DataFrame:
    """Long form without zeros."""
    return matrix.unpivot([row], [c for c in matrix.columns if c != row], column, value).where(F.col(value) > 0)


# position- and barcode-based duplicate marks
def mark_by_position(reads: DataFrame, *, umi: str = "umi", name: str = "qname") -> DataFrame:
    """PD 1 for reads whose name belongs to a later read of the same strand, place, length and barcode.

    A read's place is judged on the first mates; every read of a duplicate's name is marked.
    """
    forward = F.col("chrom").isNotNull() & F.col("is_read1") & ~F.col("is_reverse")
    reverse = F.col("chrom").isNotNull() & F.col("is_read1") & F.col("is_reverse")
    judged = reads.where(forward | reverse)
    later = F.row_number().over(W.partitionBy("chrom", "is_reverse", "pos", umi, "tlen").orderBy("id"))
    names = judged.withColumn("n_", later).where("n_ > 1").select(name).distinct().withColumn("dup_", F.lit(1))
    return reads.join(names, name, "left").withColumn("PD", F.coalesce("dup_", F.lit(0))).drop("dup_")


def mark_by_gene(reads: DataFrame, *, umi: str = "umi", name: str = "qname") -> DataFrame:
    """PD 1 for reads whose name belongs to a later read of the same chromosome, cell, gene and barcode."""
    later = F.row_number().over(W.partitionBy("chrom", "cell", "gene", umi).orderBy("id"))
    names = reads.where("chrom is not null").withColumn("n_", later).where("n_ > 1").select(name).distinct().withColumn("dup_", F.lit(1))
    return reads.join(names, name, "left").withColumn("PD", F.coalesce("dup_", F.lit(0))).drop("dup_")


def duplicate_totals(marked: DataFrame, *by: str) -> DataFrame:
    return marked.groupBy(*by).agg(F.count("*").alias("total"), F.sum((F.col("PD") == 0).cast("long")).alias("nondup"), F.sum((F.col("PD") == 1).cast("long")).alias("dup"))


def first_per_key(reads: DataFrame, keys: list[str], order: Column | str = "id") -> DataFrame:
    """One representative row a key: the first by ``order``."""
    return reads.withColumn("n_", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("n_ = 1").drop("n_")


# loss-corrected counting
def primary_reads(reads: DataFrame, mapq: int = 0) -> DataFrame:
    """Mapped primary reads with cell and barcode, of a pair only the first; gene falls back to the contig."""
    flag = F.col("flag")
    keep = ~has_flag(flag, UNMAPPED | SECONDARY | SUPPLEMENTARY) & (F.col("mapq") >= mapq) & (~has_flag(flag, PAIRED) | has_flag(flag, READ1))
    return reads.where(keep & F.col("cell").isNotNull() & F.col("umi").isNotNull()).withColumn("gene", F.coalesce("gene", "contig"))


def molecule_reads(reads: DataFrame) -> DataFrame:
    """cell, gene, umi, reads."""
    return reads.groupBy("cell", "gene", "umi").agg(F.count("*").alias("reads"))


def auto_threshold(molecules: DataFrame, q: float = 0.05) -> int:
    """Read count at place floor(q (n - 1)) in ascending order, from a histogram."""
    hist = molecules.groupBy("reads").agg(F.count("*").alias("n"))
    upto = hist.withColumn("upto", F.sum("n").over(W.orderBy("reads")))  # a row a distinct count
    total = hist.agg(F.sum("n")).first()[0] or 0
    row = upto.where(F.col("upto") > int(q * max(total - 1, 0))).orderBy("reads").first()
    return max(1, row["reads"]) if row else 1


def loss_corrected(molecules: DataFrame, threshold: int = 1, by: tuple[str, ...] = ("cell", "gene"), efficiencies: int = 95) -> DataFrame:
    """by, n_obs, depth, efficiency, loss, n_tot = n_obs / (1 - loss).

    Of the efficiencies 0.05, 0.06, ... the one whose expected mean of passing molecules is
    closest to the observed mean; the first of equals.
    """
    passed = molecules.where(F.col("reads") >= threshold)
    groups = passed.groupBy(*by).agg(F.count("*").alias("n_obs"), F.avg("reads").alias("depth"))
    grid = groups.sparkSession.range(efficiencies).select((F.col("id") / 100 + 0.05).alias("efficiency"))
    fit = groups.join(F.broadcast(grid))  # a constant number of candidates a group
    fit = fit.withColumn("loss", U.loss_probability(F.lit(threshold), F.col("depth") * F.col("efficiency")))
    fit = fit.withColumn("miss", F.abs(F.col("depth") * F.col("efficiency") / F.greatest(1 - F.col("loss"), F.lit(1e-12)) - F.col("depth")))
    best = fit.groupBy(*by, "n_obs", "depth").agg(F.min(F.struct(F.round("miss", 9).alias("m"), "efficiency", "loss")).alias("b"))
    return best.select(*by, "n_obs", "depth", "b.efficiency", "b.loss", (F.col("n_obs") / F.greatest(1 - F.col("b.loss"), F.lit(1e-12))).alias("n_tot"))


# cell and gene tables
def cell_gene_summary(molecules: DataFrame) -> DataFrame:
    """cell, gene, umis (distinct) and reads."""
    return molecules.groupBy("cell", "gene").agg(F.count_distinct("umi").alias("umis"), F.sum("reads").alias("reads"))


def quality_counts(reads: DataFrame) -> DataFrame:
    """cell, gene, umi, reads and mean quality, in one aggregation."""
    return reads.groupBy("cell", "gene", "umi").agg(F.count("*").alias("reads"), F.avg("qual").alias("quality"))


def collision_table(counts: DataFrame, possible: float, umis: str = "umis") -> DataFrame:
    return counts.withColumn("corrected", U.collision_corrected(F.col(umis).cast("double"), possible))


# spikes
def overrepresented(spikes: DataFrame, most_reads: int, most_cells: int, umi: str = "umi", cell: str = "cell") -> tuple[DataFrame, DataFrame]:
    """Per spike: reads, cells and running sums; and the spikes above either limit."""
    stats = spikes.groupBy(umi).agg(F.count("*").alias("N"), F.count_distinct(cell).alias("nBCs"))
    hist = stats.groupBy("N").agg(F.sum("N").alias("reads"))  # running sums over distinct counts, not over rows
    running = hist.select("N", F.sum("reads").over(W.orderBy("N")).alias("cs"))
    by_cells = stats.groupBy("nBCs").agg(F.count("*").alias("k"))
    running_cells = by_cells.select("nBCs", F.sum("k").over(W.orderBy("nBCs")).alias("row"))
    stats = stats.join(running, "N").join(running_cells, "nBCs")
    return stats, stats.where((F.col("N") > most_reads) | (F.col("nBCs") > most_cells)).select(umi)


def subsample_spikes(spikes: DataFrame, mean: float, seed: int = 42, cell: str = "cell", umi: str = "umi") -> DataFrame:
    """Cells with at least 0.8 mean spikes, each cut to a seeded normal number of distinct spikes."""
    distinct = spikes.select(cell, umi).distinct()
    place = F.row_number().over(W.partitionBy(cell).orderBy(F.md5(F.concat_ws("/", F.col(cell).cast("string"), umi, F.lit(str(seed))).cast("binary")), umi))
    size = F.count("*").over(W.partitionBy(cell))
    u = lambda name: U.draw(F.col(cell), name, seed)
    normal = F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * F.pi() * u("b"))
    return distinct.withColumn("n_", size).withColumn("p_", place).where((F.col("n_") >= 0.8 * mean) & (F.col("p_") <= F.round(mean + mean**0.5 * normal))).select(cell, umi)


# equivalence classes of ambiguous reads
def equivalence_classes(reads: DataFrame, cell: str = "cell", umi: str = "umi", feature: str = "feature", read: str | None = "read") -> DataFrame:
    """cell, umi, features (sorted), cnt, node: reads of a barcode with the same set of features."""
    if read:
        per = reads.groupBy(cell, read).agg(F.array_sort(F.collect_set(feature)).alias("features"), F.min(umi).alias("umi"))
        return per.groupBy(cell, "umi", "features").agg(F.count("*").alias("cnt"), F.min(read).alias("node"))
    return reads.groupBy(cell, umi, feature).agg(F.count("*").alias("cnt")).select(cell, umi, F.array(feature).alias("features"), "cnt", F.xxhash64(cell, umi, feature).alias("node"))


def class_arcs(classes: DataFrame, cell: str = "cell", k: int = 1, ratio: float = 2.0) -> DataFrame:
    """src -> dst of classes with near barcodes (or the same), a shared feature and cnt(src) >= ratio cnt(dst) - 1."""
    nodes = classes.select(cell, "umi", "node")
    same = nodes.withColumnRenamed("node", "src").join(nodes.withColumnRenamed("node", "dst"), [cell, "umi"]).where("src < dst").select("src", "dst")
    near = build_edges(nodes, [cell], k, "le").select("src", "dst").unionByName(same).distinct()
    ends = lambda s: classes.select(F.col("node").alias(s), F.col("cnt").alias(f"cnt_{s}"), F.col("features").alias(f"f_{s}"))
    arcs = both_ways(near).join(ends("src"), "src").join(ends("dst"), "dst")
    return arcs.where((F.col("cnt_src") >= ratio * F.col("cnt_dst") - 1) & F.arrays_overlap("f_src", "f_dst")).select("src", "dst")


def class_molecules(classes: DataFrame, arcs: DataFrame, cell: str = "cell") -> DataFrame:
    """cell, parent, features: molecules of each component of classes; features common to the parent's path."""
    from tagmill.graph import components

    named = components(arcs)
    df = classes.join(named, "node", "left").withColumn("cc", F.coalesce("component", "node"))
    out = arcs.groupBy("src").agg(F.collect_list("dst").alias("near")).withColumnRenamed("src", "node")
    df = df.join(out, "node", "left").select(cell, "cc", "node", "cnt", "features", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}[cell]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        features = {n: set(f) for n, f in zip(frame["node"], frame["features"], strict=True)}
        count = dict(zip(frame["node"], frame["cnt"], strict=True))
        pairs = sorted((int(u), int(v)) for u, near in zip(frame["node"], frame["near"], strict=True) for v in near)
        rows = []
        for parent, own in K.parent_paths(count, features, pairs):
            common = set.intersection(*(features[n] for n in own))
            rows.append((frame[cell].iloc[0], parent, sorted(common or features[parent])))
        return pd.DataFrame(rows, columns=[cell, "parent", "features"])

    return df.groupBy("cc").applyInPandas(run, f"`{cell}` {kind}, parent bigint, features array<string>")


def redistributed(molecules: DataFrame, cell: str = "cell") -> DataFrame:
    """cell, feature, counts: unique molecules count one, ambiguous ones by expectation maximisation in the cell."""
    rows = molecules.groupBy(cell, "features").agg(F.count("*").alias("n"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}[cell]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("features", key=lambda s: s.map(lambda f: ",".join(f)))
        counts: dict[str, float] = {}
        several = []
        for features, n in zip(frame["features"], frame["n"], strict=True):
            if len(features) == 1:
                counts[features[0]] = counts.get(features[0], 0.0) + n
            else:
                several.append(dict.fromkeys(features, float(n)))
        for f, w in K.redistribute(several).items():
            counts[f] = counts.get(f, 0.0) + w
        return pd.DataFrame([(frame[cell].iloc[0], f, round(c, 6)) for f, c in sorted(counts.items())], columns=[cell, "feature", "counts"])

    return rows.groupBy(cell).applyInPandas(run, f"`{cell}` {kind}, feature string, counts double")


def class_summary(dump: DataFrame, cell: str = "cell") -> DataFrame:
    """cell, gene statistics of a dump of classes: UMI, Dedup_UMI and comma-separated features."""
    df = dump.withColumn("canonical", F.coalesce("Dedup_UMI", "UMI")).withColumn("gene", F.explode(F.split("features", ",")))
    return df.groupBy(cell, "gene").agg(
        F.count_distinct("canonical").alias("dedup_cnt"),
        F.count_distinct("UMI").alias("num_uniq_umis"),
        F.size(F.array_except(F.collect_set("UMI"), F.collect_set("canonical"))).alias("num_removed_umis"),
        F.sum((F.col("canonical") != F.col("UMI")).cast("long")).alias("num_replaced"),
    )
