"""Benchmark and expression statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_form(wide: DataFrame, ids: list[str], values: list[str], name: str = "permutation", value: str = "count") -> DataFrame:
    return wide.unpivot(ids, values, name, value)


def permutation_stats(long: DataFrame, by: list[str], truth: float, value: str = "count", compat: bool = False) -> DataFrame:
    """by, mean, max, min, std of the relative error (x - truth) / truth over permutations.

    ``compat`` takes the deviation over the values with their mean, maximum and minimum, as
    tables made by adding columns one after the other have it.
    """
    df = long.withColumn("e", (F.col(value) - truth) / truth)
    plain = df.groupBy(*by).agg(F.avg("e").alias("mean"), F.max("e").alias("max"), F.min("e").alias("min"), F.stddev_samp("e").alias("std"), F.collect_list("e").alias("all"))
    if compat:
        all_values = F.concat("all", F.array("mean", "max", "min"))
        n = F.size(all_values)
        mean = F.aggregate(all_values, F.lit(0.0), lambda s, x: s + x) / n
        square = F.aggregate(F.transform(all_values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x)
        plain = plain.withColumn("std", F.sqrt(square / (n - 1)))
    return plain.drop("all")


def method_table(long: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, mean, sum, quartiles and standard error of each group."""
    return long.groupBy(*by).agg(
        F.percentile(value, F.lit(0.5)).alias("median"), F.avg(value).alias("mean"), F.sum(value).alias("total"),
        F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
    )


def best_method(table: DataFrame, by: list[str], score: str, method: str = "method") -> DataFrame:
    """The method of the least absolute score; the first by name of equals."""
    return table.groupBy(*by).agg(F.min_by(method, F.struct(F.abs(score), F.col(method))).alias("best"))


def relative_to_count(counts: DataFrame, truth: DataFrame, key: str, count: str = "cnt", true: str = "tpm", absolute: bool = False) -> DataFrame:
    """error = (count - truth) / count, null for a zero count. Truth must be unique by key."""
    e = (F.col(count) - F.col(true)) / F.nullif(F.col(count).cast("double"), F.lit(0.0))
    return counts.join(truth.select(key, true), key, "left").withColumn("error", F.abs(e) if absolute else e)


def relative_to_truth(counts: DataFrame, truth: DataFrame, key: str, count: str = "cnt", true: str = "tpm") -> DataFrame:
    """error = (count - truth) / truth over all truths; missing counts are 0."""
    df = truth.select(key, true).join(counts.select(key, count), key, "left").withColumn(count, F.coalesce(count, F.lit(0)))
    return df.withColumn("error", (F.col(count) - F.col(true)) / F.nullif(F.col(true).cast("double"), F.lit(0.0)))


def abundance(df: DataFrame) -> DataFrame:
    """Truth table with transcript_id and tpm, under either naming; other columns stay."""
    df = df.withColumnsRenamed({"target_id": "transcript_id", "TPM": "tpm"})
    missing = {"transcript_id", "tpm"} - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return df


def union_results(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """All tables by (method, error rate) with both as columns; rows without a count go."""
    out = None
    for (method, rate), df in tables.items():
        df = df.withColumn("cnt", F.expr("try_cast(cnt AS double)")).where("cnt is not null").withColumn("method", F.lit(method)).withColumn("error_rate", F.lit(rate))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


#: Names that an id column goes by.
ID_NAMES = ("transcript_id", "target_id")


def counts_of(table: DataFrame) -> DataFrame:
    """transcript_id and dedup_cnt of a result table; rows without a number go.

    The id is a column of a known name, else the first one that is not the count.
    """
    if "dedup_cnt" not in table.columns:
        raise ValueError("no column dedup_cnt")
    names = [c for c in ID_NAMES if c in table.columns] or [c for c in table.columns if c != "dedup_cnt"]
    if not names:
        raise ValueError("no id column")
    counts = table.select(F.col(names[0]).cast("string").alias("transcript_id"), F.col("dedup_cnt").cast("string").try_cast("double").alias("dedup_cnt"))
    return counts.where(F.col("dedup_cnt").isNotNull() & ~F.isnan("dedup_cnt"))


def file_map(methods: dict[str, str], rates: list[float], template: str) -> dict[str, dict[float, str]]:
    """{method: {rate: path}} from a template with {method} and {er}."""
    return {name: {rate: template.format(method=folder, er=rate) for rate in rates} for name, folder in methods.items()}


def load_results(spark, files: dict[str, dict[float, str]], sep: str = "\t") -> DataFrame:
    """method, error_rate, transcript_id, dedup_cnt of all files of a map."""
    out = None
    for method, rates in files.items():
        for rate, path in rates.items():
            part = counts_of(spark.read.csv(path, sep=sep, header=True)).select(F.lit(method).alias("method"), F.lit(float(rate)).alias("error_rate"), "transcript_id", "dedup_cnt")
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no files")
    return out


def trace_table(edges: DataFrame, by: tuple[str, ...] = ("scenario", "method", "metric", "approved")) -> DataFrame:
    """by, and over permutations the mean, largest and smallest number of edges of different and of same origin."""
    return edges.groupBy(*by).agg(*(f(c).alias(c + end) for c in ("diff_origin", "same_origin") for f, end in ((F.avg, ""), (F.max, "_max"), (F.min, "_min"))))


def sweep_error(counts: DataFrame, truth: float, value: str = "cnt") -> DataFrame:
    """``error`` of a parameter sweep: (count - truth) / truth for each scenario, parameter and its value."""
    return counts.withColumn("error", (F.col(value) - F.lit(truth)) / F.lit(float(truth)))


def representative_matches(traced: DataFrame, nodes: DataFrame, origins: DataFrame, components: DataFrame) -> DataFrame:
    """cc, approved, rep, origin, same, diff: ends of a component's edges by whether they have the representative's origin.

    The representative is the node of most reads among the edges' ends, the first by name of equals.
    An end stands in the lists as often as it ends an edge, in order.
    """
    ends = traced.select("approved", F.explode(F.array("src", "dst")).alias("node"))
    ends = ends.join(nodes.select("node", "cnt"), "node").join(origins.select("node", "origin"), "node").join(components.select("node", "cc"), "node")
    best = ends.groupBy("cc", "approved").agg(F.min(F.struct((-F.col("cnt")).alias("c"), "node", "origin")).alias("r"))
    named = ends.join(best.select("cc", "approved", F.col("r.node").alias("rep"), F.col("r.origin").alias("of")), ["cc", "approved"])
    lists = lambda same: F.sort_array(F.collect_list(F.when((F.col("origin") == F.col("of")) == same, F.col("node"))))
    return named.groupBy("cc", "approved", "rep", "of").agg(lists(True).alias("same"), lists(False).alias("diff")).withColumnRenamed("of", "origin")


def spike_union(tables: dict[str, DataFrame]) -> DataFrame:
    """All spike summaries with the method as a column."""
    out = None
    for method, df in tables.items():
        part = df.withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def expression_stats(long: DataFrame, by: str, others: int, value: str = "value") -> DataFrame:
    """by, mean and population variance of a long matrix whose zeros are absent; ``others`` is the other axis' length."""
    s, q = F.sum(value), F.sum(F.col(value) * F.col(value))
    return long.groupBy(by).agg((s / others).alias("mean"), (q / others - (s / others) * (s / others)).alias("variance"))


def extreme_genes(long: DataFrame, n: int, cells: int, largest: bool = True, gene: str = "gene", value: str = "value") -> DataFrame:
    """The ``n`` genes of the largest (smallest) mean; ties by name."""
    stats = long.groupBy(gene).agg((F.sum(value) / cells).alias("mean"))
    return stats.orderBy(F.col("mean").desc() if largest else F.col("mean"), gene).limit(n)


def dominant_genes(long: DataFrame, ratio: float, cells: int, gene: str = "gene", cell: str = "cell", value: str = "value") -> DataFrame:
    """Genes that are the largest of more than ``ratio`` of the cells."""
    top = long.groupBy(cell).agg(F.min_by(gene, F.struct(-F.col(value), F.col(gene))).alias(gene))
    return top.groupBy(gene).agg(F.count("*").alias("n")).where(F.col("n") > ratio * cells)


def class_statistics(long: DataFrame, label: str, cells_of: DataFrame, value: str = "value", gene: str = "gene") -> DataFrame:
    """label, gene: mean, variance, negative-binomial theta and share of zeros; ``cells_of`` has label and n."""
    s, q = F.sum(value), F.sum(F.col(value) * F.col(value))
    df = long.groupBy(label, gene).agg(s.alias("s"), q.alias("q"), F.count_if(F.col(value) > 0).alias("nz")).join(cells_of, label)
    df = df.withColumn("mean", F.col("s") / F.col("n")).withColumn("variance", F.col("q") / F.col("n") - F.col("mean") * F.col("mean"))
    theta = F.when(F.col("variance") > F.col("mean"), F.col("mean") * F.col("mean") / (F.col("variance") - F.col("mean")))
    return df.select(label, gene, "mean", "variance", theta.alias("theta"), (1 - F.col("nz") / F.col("n")).alias("zeros"))


def origin_edges(traced: DataFrame, origins: DataFrame, by: list[str]) -> DataFrame:
    """Edges of a trace by whether both ends have the same origin: by, approved, same, diff, total."""
    o = origins.select("node", "origin")
    df = traced.join(o.withColumnsRenamed({"node": "src", "origin": "o1"}), "src").join(o.withColumnsRenamed({"node": "dst", "origin": "o2"}), "dst")
    same = (F.col("o1") == F.col("o2")).cast("long")
    return df.groupBy(*by, "approved").agg(F.sum(same).alias("same"), F.sum(1 - same).alias("diff"), F.count("*").alias("total"))


def origin_shares(traced: DataFrame, origins: DataFrame, components: DataFrame) -> DataFrame:
    """Mean over components of the share of approved edges of one origin; components without any count 0."""
    o = origins.select("node", "origin")
    df = traced.where("approved").join(o.withColumnsRenamed({"node": "src", "origin": "o1"}), "src").join(o.withColumnsRenamed({"node": "dst", "origin": "o2"}), "dst")
    df = df.join(components.select(F.col("node").alias("src"), "cc"), "src").groupBy("cc").agg(F.avg((F.col("o1") == F.col("o2")).cast("int")).alias("share"))
    return components.select("cc").distinct().join(df, "cc", "left").agg(F.avg(F.coalesce("share", F.lit(0.0))).alias("share"))


def stratified(df: DataFrame, by: str, share: float, seed: int = 42, order: str = "id") -> DataFrame:
    """A share of each stratum, at least rounded, by a seeded hash order."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(by).orderBy(F.md5(F.concat_ws("/", F.col(order).cast("string"), F.lit(str(seed))).cast("binary")), order))
    size = F.count("*").over(W.partitionBy(by))
    return df.withColumn("p_", place).withColumn("n_", size).where(F.col("p_") <= F.round(F.col("n_") * share)).drop("p_", "n_")
