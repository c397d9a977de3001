"""Delimited, FASTQ and SAM-text readers and writers, and parsers of read names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns of an alignment line before its tags.
SAM_FIELDS = ("qname", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "tlen", "seq", "qual")


def delimited(spark: SparkSession, path: str, sep: str = "\t", header: bool = True, skip: int = 0, **options) -> DataFrame:
    """A delimited text table; ``skip`` drops that many lines of each file's start."""
    if not skip:
        return spark.read.csv(path, sep=sep, header=header, encoding="UTF-8", **options)
    lines = spark.read.text(path, wholetext=True).select(F.slice(F.split("value", r"\r?\n"), skip + 1, 1 << 30).alias("lines"))
    rows = lines.select(F.explode("lines").alias("value")).where("value <> ''")
    return spark.read.csv(rows.rdd.map(lambda r: r["value"]), sep=sep, header=header, **options)


def fastq(spark: SparkSession, path: str, **options) -> DataFrame:
    """name, seq, qual of (gzipped) FASTQ files, a list, a folder or a pattern; an incomplete record is an error."""
    from tagmill.sources.fastq import FastqDataSource

    spark.dataSource.register(FastqDataSource)
    return spark.read.format("fastq").options(**options).load(path)


def write_fastq(df: DataFrame, path: str, names: list[str], seq: str = "seq", quality: str = "s") -> None:
    """Gzipped FASTQ; the header joins the name fields by ``_``, quality is constant."""
    record = F.concat_ws("\n", F.concat(F.lit("@"), F.concat_ws("_", *names)), F.col(seq), F.lit("+"), F.repeat(F.lit(quality), F.length(seq)))
    df.select(record.alias("value")).write.text(path, compression="gzip")


def sam(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """Alignment lines as columns; ``tags`` adds a column each, otherwise a map of all tags. Missing is null."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@"))
    return _sam_columns(lines.select(F.split("value", "\t").alias("f")), tags)


def _sam_columns(fields: DataFrame, tags: list[str] | None) -> DataFrame:
    number = {"flag", "pos", "mapq", "mate_pos", "tlen"}
    base = [(F.col("f")[i].cast("int") if n in number else F.nullif(F.col("f")[i], F.lit("*"))).alias(n) for i, n in enumerate(SAM_FIELDS)]
    rest = F.slice("f", len(SAM_FIELDS) + 1, 1 << 30)
    all_tags = F.map_from_entries(F.transform(rest, lambda t: F.struct(F.substr(t, F.lit(1), F.lit(2)).alias("key"), F.substr(t, F.lit(6)).alias("value"))))
    df = fields.select(*base, all_tags.alias("tags"))
    return df if tags is None else df.select(*SAM_FIELDS, *(F.col("tags")[t].alias(t) for t in tags))


def write_sam(df: DataFrame, path: str, tags: list[str] = ()) -> None:
    """Alignment lines with string tags."""
    base = [F.coalesce(F.col(n).cast("string"), F.lit("*")) for n in SAM_FIELDS]
    extra = [F.when(F.col(t).isNotNull(), F.concat(F.lit(f"{t}:Z:"), F.col(t).cast("string"))) for t in tags]
    df.select(F.concat_ws("\t", *base, *extra).alias("value")).write.text(path)


def mapped_names(alignments: DataFrame) -> DataFrame:
    return alignments.where("chrom is not null").select("qname")


# read names
def name_umi(name: Column) -> Column:
    return F.element_at(F.split(name, "_"), -1)


def name_barcode(name: Column) -> Column:
    """Second field from the end; null for short names."""
    return F.try_element_at(F.split(name, "_"), F.lit(-2))


def origin(name: Column) -> dict[str, Column]:
    """Simulated names: molecule, source, cycle (-1 for the original)."""
    head = F.split(F.split(name, "_")[0], "-")
    cycle = F.try_element_at(head, F.lit(3))
    return {"molecule": head[0], "source": F.try_element_at(head, F.lit(2)), "cycle": F.when(cycle == "init", -1).otherwise(F.expr("0") + cycle.try_cast("int"))}


def tag_from_name(df: DataFrame, tags: dict[str, int] | None = None, name: str = "qname", strip: str | None = None) -> DataFrame:
    """Columns from name fields (split at _ and :), counted from the end; null if the name is too short."""
    fields = F.split(F.regexp_replace(name, f"{re.escape(strip)}.*$", "") if strip else F.col(name), "[_:]")
    for tag, place in (tags or {"CB": -2, "MB": -1}).items():
        df = df.withColumn(tag, F.when(F.size(fields) >= abs(place), F.try_element_at(fields, F.lit(place))))
    return df


def star_fields(name: Column, kind: str) -> Column:
    """Number after ``kind*`` in a simulated name."""
    return F.nullif(F.regexp_extract(name, rf"{kind}\*(\d+)", 1), F.lit(""))


def molecule_id(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"molecule_id=([^\s;]+)", 1), F.lit(""))


def gene_token(name: Column) -> Column:
    """First header token that starts with GENE, else with ENS."""
    tokens = F.split(name, "[:_#]")
    pick = lambda p: F.try_element_at(F.filter(tokens, lambda t: t.startswith(p)), F.lit(1))
    return F.coalesce(pick("GENE"), pick("ENS"))


def slice_at(seq: Column, start: int, length: int) -> Column:
    """Bases from a place; negative places count from the end; fails outside the read."""
    begin = F.lit(start) if start >= 0 else F.length(seq) + start
    return F.when((begin < 0) | (begin + length > F.length(seq)), F.raise_error(F.lit("slice outside the read")).cast("string")).otherwise(F.substr(seq, begin + 1, F.lit(length)))


def with_truth(reads: DataFrame, truth: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Left lookup of true barcodes by read id."""
    return reads.join(truth.select(on, *columns), on, "left")


def bundle_positions(reads: DataFrame) -> DataFrame:
    """PO: ordinal of the read's (chrom, pos, strand) in coordinate order.

    Bundles are numbered over their distinct places, not over reads.
    """
    at = ["chrom", "pos", "is_reverse"]
    places = reads.select(*at).distinct()
    # ordinal = bundles of earlier chromosomes + rank in the chromosome
    per = places.groupBy("chrom").agg(F.count("*").alias("n"))
    before = per.select(F.col("chrom"), (F.sum("n").over(W.orderBy("chrom")) - F.col("n")).alias("before"))
    ranked = places.withColumn("r", F.row_number().over(W.partitionBy("chrom").orderBy("pos", "is_reverse")))
    named = ranked.join(F.broadcast(before), "chrom").select(*at, (F.col("before") + F.col("r") - 1).alias("PO"))
    return reads.join(named, at)


def repeat_rows(df: DataFrame, count: str) -> DataFrame:
    return df.withColumn("copy", F.explode(F.when(F.col(count) > 0, F.sequence(F.lit(1), F.col(count).cast("int")))))


def mock_reads(spark: SparkSession, umis: dict[str, str], counts: dict[str, int], step: int = 0) -> DataFrame:
    """id, label, umi, pos: reads of labelled barcodes; ``step`` staggers the positions."""
    rows = spark.createDataFrame([(i, k, umis[k], counts[k]) for i, k in enumerate(umis)], "o int, label string, umi string, cnt int")
    df = repeat_rows(rows, "cnt")
    order = W.orderBy("o", "copy")  # a fixture: as many rows as the dictionary says
    return df.select((F.row_number().over(order) - 1).cast("long").alias("id"), "label", "umi", (F.lit(1) + F.col("o") * step).alias("pos"))
