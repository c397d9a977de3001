"""Simulated FASTQ records (name, seq, qual) as tagged reads, one function a simulator's naming.

Every function adds CB (cell), MB (observed barcode), TB (true barcode) and XT or XF
(transcript or gene) as string columns and keeps the others. True barcodes come from the
name or by a left join with a truth table, which has to be unique by its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagmill.sources.tables import molecule_id, slice_at, star_fields

_EMPTY = ""


def _head(seq: Column, start: int, length: int) -> Column:
    """Bases from a place, null if the read is too short."""
    return F.when(F.length(seq) >= start + length, F.substr(seq, F.lit(start + 1), F.lit(length)))


def dashed(name: Column) -> dict[str, Column]:
    """cell, umi, transcript and read of names "cell-umi-transcript-read"; the cell may hold dashes itself."""
    fields = F.split(name, "-")
    at = lambda i: F.when(F.size(fields) >= 4, F.try_element_at(fields, F.lit(i)))
    cell = F.when(F.size(fields) >= 4, F.array_join(F.slice(fields, 1, F.greatest(F.size(fields) - 3, F.lit(0))), "-"))
    return {"cell": cell, "umi": at(-3), "transcript": at(-2), "read": at(-1)}


def asarusim(records: DataFrame, truth: DataFrame, *, cb_len: int = 16, umi_len: int = 12, adapter: str | None = None) -> DataFrame:
    """Names are ids of ``truth`` (column ``id``, "cell-umi-transcript-read"); observed tags stand at the read's start.

    With ``adapter`` they stand before its first place, if there is room for them.
    """
    name = F.split("name", r"\s")[0]
    known = truth.select(F.col("id").alias("id_"), dashed(F.col("id"))["umi"].alias("TB")).dropDuplicates(["id_"])
    head = F.col("seq")
    if adapter:
        at = F.locate(adapter, head)
        head = F.when(at > cb_len + umi_len, F.substr(head, F.lit(1), at - 1)).otherwise(head)
    df = records.withColumn("head_", head).withColumn("name", name).join(known, F.col("name") == F.col("id_"), "left").drop("id_")
    cell = F.coalesce(_head(F.col("head_"), 0, cb_len), F.col("head_"))
    tags = {"CB": cell, "MB": F.coalesce(_head(F.col("head_"), cb_len, umi_len), F.lit(_EMPTY)), "TB": F.coalesce("TB", F.lit(_EMPTY)), "XT": F.coalesce(dashed(F.col("name"))["transcript"], F.lit(_EMPTY))}
    return df.withColumns(tags).drop("head_")


def screadsim(records: DataFrame, *, cb_len: int = 16, umi_len: int = 10) -> DataFrame:
    """Names "barcodes:cell:region#n": the true barcode is in the first field, the gene is a token of the region."""
    fields = F.split("name", ":")
    region = F.nullif(F.split(F.try_element_at(fields, F.lit(3)), "#")[0], F.lit(""))
    tokens = F.split(region, "_")
    first = lambda mark: F.try_element_at(F.filter(tokens, lambda t: t.startswith(mark)), F.lit(1))
    gene = F.coalesce(first("GENE"), first("ENS"), region, F.lit("NA"))
    return records.withColumns({"CB": _head(F.col("seq"), 0, cb_len), "MB": _head(F.col("seq"), cb_len, umi_len), "TB": _head(fields[0], cb_len, umi_len), "XT": gene})


def molecules(lines: DataFrame, umi_len: int = 10) -> DataFrame:
    """id, CB, TB, tid, XT of a molecule description: a line "+id ... info(k=v;...)" and interval lines under it.

    ``lines`` has the text (value) and its place (line) in the file. A true barcode may
    also stand, as a sequence of its length, after a run of A; the transcript is the
    contig of the first interval otherwise.
    """
    text = F.trim("value")
    rows = lines.select("line", text.alias("t")).where(F.col("t") != "")
    heads = rows.where(F.col("t").startswith("+")).select(F.col("line").alias("from"), F.split(F.trim(F.substr("t", F.lit(2))), r"\s+")[0].alias("id"), "t")
    # a line belongs to the last head before it: heads are counted up to each line, by parts of the file
    block = 1 << 16
    counted = rows.withColumn("part", F.floor(F.col("line") / block)).withColumn("head", F.col("t").startswith("+"))
    per = counted.groupBy("part").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("last"))
    before = per.select("part", F.last("last", ignorenulls=True).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("last"))
    inside = F.last(F.when(F.col("head"), F.col("line")), ignorenulls=True).over(W.partitionBy("part").orderBy("line"))
    own = counted.withColumn("inside", inside).join(F.broadcast(before), "part").select("line", "t", "head", F.coalesce("inside", "last").alias("from")).where("not head and `from` is not null")
    words = F.split("t", r"\s+")
    own = own.withColumn("w", words[0])
    bases = F.col("w").rlike("^[ACGTNacgtn]+$")
    tail = F.min(F.when(F.col("w").rlike("^[Aa]+$"), F.col("line")))
    first = own.where(~bases).groupBy("from").agg(F.min_by("w", "line").alias("contig"))
    tails = own.where(bases).groupBy("from").agg(tail.alias("tail"))
    barcode = own.where(bases & ~F.col("w").rlike("^[Aa]+$") & (F.length("w") == umi_len)).join(tails, "from").where("line > tail").groupBy("from").agg(F.min_by(F.upper("w"), "line").alias("after"))
    info = lambda k: F.nullif(F.regexp_extract("t", rf"(?:info\(|;)\s*{k}=([^;)]+)", 1), F.lit(""))
    plain = lambda k: F.nullif(F.regexp_extract(F.regexp_replace("t", r"info\(.*", ""), rf"\b{k}=([^\s;]+)", 1), F.lit(""))
    named = heads.join(first, "from", "left").join(barcode, "from", "left")
    transcript = F.coalesce(*(info(k) for k in ("XT", "TX", "TR", "Transcript", "transcript")), "contig")
    out = named.select("from", "id", F.coalesce(info("CB"), plain("CB")).alias("CB"), F.coalesce(info("TB"), plain("TB"), "after").alias("TB"), F.coalesce(plain("tid"), info("tid")).alias("tid"), transcript.alias("XT"))
    return out.groupBy("id").agg(*(F.max_by(c, "from").alias(c) for c in ("CB", "TB", "tid", "XT")))


def tksm(records: DataFrame, template: DataFrame, amplified: DataFrame, *, cb_len: int = 16, umi_len: int = 10) -> DataFrame:
    """Names with "molecule_id=": the amplified molecule first, then its root (up to the first dot) in ``template``.

    Both tables are as ``molecules`` gives them. The observed barcode is the read's end.
    """
    side = lambda df, p: df.select(*(F.col(c).alias(p + c) for c in ("id", "CB", "TB", "tid", "XT")))
    df = records.withColumn("MI", molecule_id(F.col("name")))
    df = df.join(side(amplified, "p_"), F.col("MI") == F.col("p_id"), "left").join(side(template, "t_"), F.split("MI", r"\.")[0] == F.col("t_id"), "left")
    seq, none = F.col("seq"), F.lit("NA")
    seen = F.when(F.length(seq) >= umi_len, F.substr(seq, F.length(seq) - umi_len + 1, F.lit(umi_len))).otherwise(none)
    tags = {
        "name": F.split("name", r"\s")[0], "CB": F.coalesce("t_CB", "p_CB", _head(seq, 0, cb_len), none), "MB": seen, "TB": F.coalesce("p_TB", "t_TB", seen),
        "XT": F.coalesce("p_tid", "t_tid", "p_XT", "t_XT", none), "MI": F.coalesce("MI", none),
    }
    return df.withColumns(tags).drop(*(f"{p}_{c}" for p in "pt" for c in ("id", "CB", "TB", "tid", "XT")))


def minnow(records: DataFrame, *, cb_len: int = 16, umi_len: int = 12) -> DataFrame:
    """Both barcodes at the read's start (a shorter read fails); the transcript is the name's second field; truth is what is seen."""
    umi = slice_at(F.col("seq"), cb_len, umi_len)
    return records.withColumns({"CB": slice_at(F.col("seq"), 0, cb_len), "MB": umi, "TB": umi, "XT": F.coalesce(F.try_element_at(F.split("name", ":"), F.lit(2)), F.lit(_EMPTY))})


def tresor(records: DataFrame, *, umi_start: int, umi_len: int) -> DataFrame:
    """Names "...s*cell*g*gene*...": cell and gene (XF) by number; the barcode at a place, counted from the end if negative."""
    umi = slice_at(F.col("seq"), umi_start, umi_len)
    return records.withColumns({"CB": star_fields(F.col("name"), "s"), "XF": star_fields(F.col("name"), "g"), "MB": umi})


# names as alignments: what the converters write as tags
def bulk(records: DataFrame) -> DataFrame:
    """All reads at one place: PO 1."""
    return records.withColumn("PO", F.lit(1))


def bulk_genes(records: DataFrame) -> DataFrame:
    """XT: the fifth dash field of the name."""
    return records.withColumns({"XT": F.split("name", "-")[4].cast("int"), "XS": F.lit("Assigned")})


def starred(records: DataFrame, tag: str = "BC") -> DataFrame:
    """Names "..*..*cell*..*gene..": the third star field as ``tag`` (BC, or SP for samples) and the fifth as XT."""
    fields = F.split("name", r"\*")
    return records.withColumns({tag: fields[2].cast("int"), "XT": fields[4].cast("int"), "XS": F.lit("Assigned")})


def unaligned(tagged: DataFrame) -> DataFrame:
    """Tagged records with the fields of an alignment line, unmapped, for ``write_sam``."""
    none = F.lit(None).cast("string")
    return tagged.withColumnRenamed("name", "qname").withColumns({"flag": F.lit(4), "chrom": none, "pos": F.lit(0), "mapq": F.lit(0), "cigar": none, "mate_chrom": none, "mate_pos": F.lit(0), "tlen": F.lit(0)})
