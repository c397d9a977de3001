"""Queries of the barcode operators with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.fixtures import COMPONENTS_SQL, NODES_SQL, READS_SQL, reads, table
from tagmill.functions import umi as U
from tagmill.operators import counting, dedup, graphs, local, summary, trimming
from tagmill.plans import pipeline, statistics
from tagmill.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
GENE = ["gene"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _nodes(spark, sf):
    return graphs.settle(graphs.build_nodes(reads(spark, sf), GENE))


def _graph(spark, sf):
    nodes = _nodes(spark, sf)
    return nodes, graphs.settle(graphs.build_edges(nodes, GENE, 1, length=6, counts=True))


# sources and parsing
query("a2_mapped_names", f"WITH {READS_SQL} SELECT qname FROM reads WHERE chrom IS NOT NULL")(lambda s, d: tables.mapped_names(reads(s, d)))
query("a5_pruned_scan", f"WITH {READS_SQL} SELECT qname, pos::INTEGER AS pos, tlen, is_reverse FROM reads WHERE is_read1")(lambda s, d: reads(s, d).where("is_read1").select("qname", F.col("pos").cast("int").alias("pos"), "tlen", "is_reverse"))


@query("a12_position_bundles", f"WITH {READS_SQL}, b AS (SELECT *, dense_rank() OVER (ORDER BY chrom, pos, is_reverse) - 1 AS PO FROM reads) SELECT PO, count(*) AS n, count(DISTINCT umi) AS umis FROM b GROUP BY PO")
def a12(s, d):
    return tables.bundle_positions(reads(s, d)).groupBy("PO").agg(F.count("*").alias("n"), F.count_distinct("umi").alias("umis"))


@query("a12_repeated_reads", f"WITH {READS_SQL} SELECT gene, umi, unnest(generate_series(1, c)) AS copy FROM (SELECT gene, umi, count(*) AS c FROM reads GROUP BY gene, umi)")
def a12_repeat(s, d):
    return tables.repeat_rows(reads(s, d).groupBy("gene", "umi").agg(F.count("*").alias("c")), "c").select("gene", "umi", F.col("copy").cast("long").alias("copy"))


@query("a14_abundance", "SELECT s_name AS transcript_id, s_acctbal AS tpm, s_suppkey FROM supplier")
def a14(s, d):
    return statistics.abundance(table(s, d, "supplier").select(F.col("s_name").alias("target_id"), F.col("s_acctbal").alias("TPM"), "s_suppkey"))


@query("b4_tags_from_names", f"WITH {READS_SQL} SELECT id, qname, string_split(qname, '_')[-2] AS \"CB\", string_split(qname, '_')[-1] AS \"MB\" FROM reads")
def b4(s, d):
    return tables.tag_from_name(reads(s, d).select("id", "qname"))


@query("c3_name_fields", f"WITH {READS_SQL} SELECT id, string_split(qname, '_')[-1] AS u, string_split(qname, '_')[-2] AS bc FROM reads")
def c3(s, d):
    return reads(s, d).select("id", tables.name_umi(F.col("qname")).alias("u"), tables.name_barcode(F.col("qname")).alias("bc"))


@query("c9_origin", "SELECT p_partkey, (p_partkey % 50)::VARCHAR AS molecule, 'pcr' AS source, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE p_partkey % 9 END::INTEGER AS cycle FROM part")
def c9(s, d):
    p = table(s, d, "part")
    cycle = F.when(F.col("p_partkey") % 3 == 0, F.lit("init")).otherwise((F.col("p_partkey") % 9).cast("string"))
    name = F.concat((F.col("p_partkey") % 50).cast("string"), F.lit("-pcr-"), cycle, F.lit("_ACGT"))
    o = tables.origin(name)
    return p.select("p_partkey", o["molecule"].alias("molecule"), o["source"].alias("source"), o["cycle"].cast("int").alias("cycle"))


@query("c10_gene_resolution", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS gene FROM part")
def c10(s, d):
    p = table(s, d, "part").withColumn("tag", F.when(F.col("p_size") % 4 == 0, F.lit("None")).otherwise(F.concat("p_brand", F.lit(",other")))).withColumn("contig", F.col("p_type"))
    return counting.resolve_gene(p).select("p_partkey", "gene")


@query("c11_anchor_share", "SELECT round(avg(contains(text, 'the')::INTEGER), 9) AS anchored, round(avg((length(text) = 92)::INTEGER), 9) AS \"full\" FROM documents WHERE text IS NOT NULL")
def c11(s, d):
    df = trimming.anchor_share(table(s, d, "documents").where("text is not null"), "the", "text")
    return df.select(F.round("anchored", 9).alias("anchored"), F.round("full", 9).alias("full"))


@query("c13_read_structure", f"WITH {READS_SQL} SELECT id, substr(umi || qname, 3, 4) AS umi_1, substr(umi || qname, 1, 2) AS bc_1, substr(umi || qname, 7, 5) AS seq_1 FROM reads")
def c13(s, d):
    df = reads(s, d).select("id", F.concat("umi", "qname").alias("seq_raw"))
    return trimming.trim(df, "bc_1+umi_1+seq_1", {"bc_1": 2, "umi_1": 4, "seq_1": 5}).select("id", "umi_1", "bc_1", "seq_1")


@query("c14_between_motifs", "SELECT * FROM (SELECT doc_id, CASE WHEN strpos(text, 'the ') > 0 AND strpos(substr(text, strpos(text, 'the ') + 4), ' of') > 0 THEN substr(substr(text, strpos(text, 'the ') + 4), 1, strpos(substr(text, strpos(text, 'the ') + 4), ' of') - 1) END AS \"spikeUMI\" FROM documents) WHERE \"spikeUMI\" IS NOT NULL")
def c14(s, d):
    return trimming.spike_barcode(table(s, d, "documents"), before="the ", after=" of", seq="text").select("doc_id", "spikeUMI")


# graph
query("e1_umi_histogram", f"WITH {NODES_SQL} SELECT gene, umi, cnt, node FROM nodes")(lambda s, d: graphs.build_nodes(reads(s, d), GENE).select("gene", "umi", "cnt", "node"))
query("f1_node_numbers", f"WITH {NODES_SQL} SELECT gene, umi, row_number() OVER (PARTITION BY gene ORDER BY node) - 1 AS node_id FROM nodes")(lambda s, d: graphs.numbered(graphs.build_nodes(reads(s, d), GENE), GENE).select("gene", "umi", F.col("node_id").cast("long").alias("node_id")))
query("d2_hamming_edges", f"WITH {NODES_SQL} SELECT gene, src, dst, 1 AS ed FROM edges")(lambda s, d: graphs.build_edges(_nodes(s, d), GENE, 1, length=6))
query("d3_hamming_edges_le2", f"WITH {NODES_SQL} SELECT a.gene, a.node AS src, b.node AS dst, hamming(a.umi, b.umi)::INTEGER AS ed FROM nodes a JOIN nodes b ON a.gene = b.gene AND a.node < b.node AND hamming(a.umi, b.umi) <= 2")(lambda s, d: graphs.build_edges(graphs.build_nodes(reads(s, d), GENE), GENE, 2, "le", 6))
query("d1_all_pairs", f"WITH {NODES_SQL} SELECT a.gene, a.node AS src, b.node AS dst, hamming(a.umi, b.umi)::INTEGER AS ed FROM nodes a JOIN nodes b ON a.gene = b.gene AND a.node < b.node AND hamming(a.umi, b.umi) = 2")(lambda s, d: summary.all_pairs(graphs.build_nodes(reads(s, d), GENE), GENE, 2))


@query("e2_average_distance", f"WITH {NODES_SQL}, p AS (SELECT a.gene, avg(hamming(a.umi, b.umi)) AS m FROM nodes a JOIN nodes b ON a.gene = b.gene AND a.node < b.node GROUP BY a.gene) SELECT gene, CASE WHEN count(*) = 1 THEN -1 ELSE ceil(round(any_value(m), 9)) END::DOUBLE AS ave_ed FROM nodes LEFT JOIN p USING (gene) GROUP BY gene")
def e2(s, d):
    return graphs.average_distance(graphs.build_nodes(reads(s, d), GENE), GENE)


@query("i4_components", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT node, cc FROM cc")
def i4(s, d):
    return graphs.with_components(*_graph(s, d)).select("node", "cc")


@query("i3_adjacency_list", f"WITH {NODES_SQL} SELECT src, count(*) AS degree, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS near FROM arcs GROUP BY src")
def i3(s, d):
    e = graphs.both_ways(_graph(s, d)[1])
    return e.groupBy("src").agg(F.count("*").alias("degree"), F.array_join(F.transform(F.sort_array(F.collect_list("dst")), lambda x: x.cast("string")), ",").alias("near"))


# deduplication
_SUMMARY = """,
counts AS (SELECT gene, count(*) FILTER (node = rep) AS dedup_cnt, count(*) AS num_uniq_umis, count(*) FILTER (node <> rep) AS num_diff_dedup_uniq_umis,
                  coalesce(sum(cnt) FILTER (node <> rep), 0)::BIGINT AS num_diff_dedup_reads FROM assigned GROUP BY gene),
reps AS (SELECT gene, node, umi FROM assigned WHERE node = rep),
dist AS (SELECT a.gene, avg(hamming(a.umi, b.umi)) AS m FROM reps a JOIN reps b ON a.gene = b.gene AND a.node < b.node GROUP BY a.gene)
SELECT gene, dedup_cnt, coalesce(ceil(round(m, 9)), -1)::DOUBLE AS ave_ed, num_uniq_umis, num_diff_dedup_uniq_umis, num_diff_dedup_reads FROM counts LEFT JOIN dist USING (gene)"""
_RANKED = COMPONENTS_SQL + """,
ranked AS (SELECT nodes.*, cc, row_number() OVER (PARTITION BY cc ORDER BY cnt DESC, {tie}) AS r FROM nodes JOIN cc USING (node))"""
_DIRECTIONAL = _RANKED + """,
walk AS (SELECT src, dst FROM arcs WHERE cnt_src >= 2 * cnt_dst - 1),
best AS (SELECT node, r AS low, cc FROM ranked UNION SELECT walk.dst, best.low, best.cc FROM best JOIN walk ON best.node = walk.src JOIN ranked t ON t.node = walk.dst WHERE best.low < t.r),
assigned AS (SELECT ranked.gene, ranked.node, ranked.umi, ranked.cnt, ranked.cc, top.node AS rep FROM ranked JOIN (SELECT node, min(low) AS low FROM best GROUP BY node) USING (node) JOIN ranked top ON top.cc = ranked.cc AND top.r = low)"""
_CLUSTER = _RANKED + ", assigned AS (SELECT a.gene, a.node, a.umi, a.cnt, a.cc, b.node AS rep FROM ranked a JOIN ranked b ON a.cc = b.cc AND b.r = 1)"
_ADJACENCY = _RANKED + """,
near AS (SELECT arcs.dst AS node, min(s.r) AS r_near FROM arcs JOIN ranked s ON s.node = arcs.src GROUP BY arcs.dst),
popped AS (SELECT cc, max(least(r, coalesce(r_near, r))) AS popped FROM ranked LEFT JOIN near USING (node) GROUP BY cc),
assigned AS (SELECT a.gene, a.node, a.umi, a.cnt, a.cc, b.node AS rep FROM ranked a LEFT JOIN near USING (node) JOIN popped USING (cc) JOIN ranked b ON b.cc = a.cc AND b.r = CASE WHEN a.r <= popped THEN a.r ELSE r_near END)"""
_SQL = {
    "cluster": _CLUSTER.replace("{tie}", "node"),
    "adjacency": _ADJACENCY.replace("{tie}", "node"),
    "directional": _DIRECTIONAL.replace("{tie}", "node"),
    "starsolo": _DIRECTIONAL.replace("{tie}", "umi"),
    "component_lexical": _CLUSTER.replace("{tie}", "umi"),
}


def _summary_query(method):
    def run(s, d):
        nodes, edges = _graph(s, d)
        return summary.summarize(graphs.settle(dedup.METHODS[method](nodes, edges, GENE)), GENE)

    return run


for _number, _method in (("j2", "cluster"), ("j3", "adjacency"), ("j4", "directional"), ("j5", "starsolo"), ("j10", "component_lexical")):
    query(f"{_number}_{_method}", f"WITH RECURSIVE {_SQL[_method]}{_SUMMARY}")(_summary_query(_method))


@query("j1_unique", f"WITH {NODES_SQL} SELECT gene, count(*) AS dedup_cnt, count(*) AS num_uniq_umis FROM nodes GROUP BY gene HAVING count(*) > 1")
def j1(s, d):
    return reads(s, d).groupBy("gene").agg(F.count_distinct("umi").alias("dedup_cnt")).where("dedup_cnt > 1").withColumn("num_uniq_umis", F.col("dedup_cnt"))


@query("j4_directional_count", f"""WITH RECURSIVE {COMPONENTS_SQL},
into_ AS (SELECT DISTINCT dst FROM arcs WHERE cnt_src >= 2 * cnt_dst - 1 AND (cnt_src > 1 OR cnt_dst > 1)),
heavy AS (SELECT gene, count(*) AS n FROM nodes WHERE cnt > 1 AND node NOT IN (SELECT dst FROM into_) GROUP BY gene),
one AS (SELECT src, dst FROM arcs WHERE cnt_src = 1 AND cnt_dst = 1),
reach1 AS (SELECT node, node AS low, gene FROM nodes WHERE cnt = 1 UNION SELECT one.dst, reach1.low, reach1.gene FROM reach1 JOIN one ON reach1.node = one.src WHERE reach1.low < one.dst),
c1 AS (SELECT gene, node, min(low) AS c FROM reach1 GROUP BY gene, node),
touched AS (SELECT DISTINCT c FROM c1 JOIN arcs ON arcs.dst = c1.node WHERE cnt_src > 1),
light AS (SELECT gene, count(DISTINCT c) AS n FROM c1 WHERE c NOT IN (SELECT c FROM touched) GROUP BY gene)
SELECT gene, (coalesce(h.n, 0) + coalesce(l.n, 0))::BIGINT AS dedup_cnt FROM (SELECT DISTINCT gene FROM nodes) LEFT JOIN heavy h USING (gene) LEFT JOIN light l USING (gene)""")
def j4_count(s, d):
    nodes, edges = _graph(s, d)
    return dedup.directional(nodes, edges, GENE).groupBy("gene").agg(F.sum((F.col("node") == F.col("rep")).cast("long")).alias("dedup_cnt"))


@query("j4_trace", f"WITH RECURSIVE {_SQL['directional']} SELECT e.src, e.dst, a.rep AS rep_src, b.rep AS rep_dst, (greatest(e.cnt_src, e.cnt_dst) >= 2 * least(e.cnt_src, e.cnt_dst) - 1) AND a.rep = b.rep AS approved FROM edges e JOIN assigned a ON a.node = e.src JOIN assigned b ON b.node = e.dst")
def j4_trace(s, d):
    nodes, edges = _graph(s, d)
    return dedup.trace(dedup.directional(nodes, edges, GENE), nodes, edges)


@query("j6_gencore", f"WITH RECURSIVE {_SQL['component_lexical']}, b AS (SELECT rep, i, substr(umi, i, 1) AS base, sum(cnt) AS w FROM assigned, (SELECT unnest(generate_series(1, 6))::INTEGER AS i) GROUP BY rep, i, base), c AS (SELECT rep, i, base, row_number() OVER (PARTITION BY rep, i ORDER BY w DESC, base) AS r FROM b), t AS (SELECT rep, string_agg(base, '' ORDER BY i) AS consensus FROM c WHERE r = 1 GROUP BY rep) SELECT rep, count(*) AS size, any_value(consensus) AS consensus FROM assigned JOIN t USING (rep) GROUP BY rep")
def j6(s, d):
    nodes, edges = _graph(s, d)
    return dedup.consensus(dedup.METHODS["gencore"](nodes, edges, GENE))


@query("e7_distance_bins", f"WITH RECURSIVE {_SQL['directional']}{_SUMMARY.replace('SELECT gene, dedup_cnt', ', s AS (SELECT gene, dedup_cnt')}) SELECT ave_ed, count(*) AS count FROM s GROUP BY ave_ed")
def e7(s, d):
    return summary.distance_bins(QUERIES["j4_directional"](s, d))


@query("e6_weighted_distance", f"WITH RECURSIVE {_SQL['directional']}, reps AS (SELECT * FROM assigned WHERE node = rep) SELECT gene, coalesce(round_even(sum(hamming(a.umi, b.umi) * a.cnt * b.cnt)::DOUBLE / sum(a.cnt * b.cnt), 0), -1)::DOUBLE AS eds FROM reps a JOIN reps b USING (gene) WHERE a.node < b.node GROUP BY gene")
def e6(s, d):
    nodes, edges = _graph(s, d)
    return summary.weighted_distance(dedup.directional(nodes, edges, GENE), GENE).where("eds >= 0").select("gene", F.col("eds").cast("double").alias("eds"))


@query("b1_kept_reads", f"WITH RECURSIVE {_SQL['directional']} SELECT DISTINCT id, umi, gene FROM reads WHERE id IN (SELECT node FROM assigned WHERE node = rep)")
def b1(s, d):
    nodes, edges = _graph(s, d)
    return summary.kept_reads(reads(s, d), dedup.directional(nodes, edges, GENE)).select("id", "umi", "gene").distinct()


@query("b10_marked_reads", f"WITH RECURSIVE {_SQL['directional']} SELECT r.id, t.umi AS \"UMI_mapped\", CASE WHEN r.id = a.rep THEN 0 ELSE 1 END AS \"PD\" FROM reads r JOIN assigned a ON a.gene = r.gene AND a.umi = r.umi JOIN nodes t ON t.node = a.rep")
def b10(s, d):
    nodes, edges = _graph(s, d)
    return summary.mark(reads(s, d), dedup.directional(nodes, edges, GENE), GENE).select("id", "UMI_mapped", "PD")


@query("g4_removed_nodes", f"WITH RECURSIVE {_SQL['directional']} SELECT gene, node, rep FROM assigned WHERE node <> rep")
def g4(s, d):
    nodes, edges = _graph(s, d)
    return summary.removed_nodes(dedup.directional(nodes, edges, GENE)).select("gene", "node", "rep")


# greedy methods: by rank, one step a row, over a list of the representatives so far
_GREEDY = _RANKED.replace("{tie}", "node") + """,
taken_by AS (SELECT a.node AS node, s.r AS r_src, a.cc, a.r FROM arcs JOIN ranked a ON a.node = arcs.dst JOIN ranked s ON s.node = arcs.src WHERE s.r < a.r AND {may}),
takers AS (SELECT ranked.node, ranked.cc, ranked.r, coalesce(list(r_src ORDER BY r_src) FILTER (r_src IS NOT NULL), []) AS t FROM ranked LEFT JOIN taken_by USING (node) GROUP BY ranked.node, ranked.cc, ranked.r),
steps AS (SELECT cc, 1::BIGINT AS r, [1::BIGINT] AS reps FROM takers WHERE r = 1
          UNION ALL SELECT s.cc, t.r, CASE WHEN list_has_any(s.reps, t.t) THEN s.reps ELSE list_append(s.reps, t.r) END FROM steps s JOIN takers t ON t.cc = s.cc AND t.r = s.r + 1),
last AS (SELECT cc, arg_max(reps, r) AS reps FROM steps GROUP BY cc)
SELECT gene, sum(len(reps))::BIGINT AS dedup_cnt FROM last JOIN (SELECT DISTINCT gene, cc FROM ranked) USING (cc) GROUP BY gene"""


def _greedy_query(method):
    def run(s, d):
        nodes, edges = _graph(s, d)
        a = dedup.METHODS[method](nodes, edges, GENE)
        return a.groupBy("gene").agg(F.sum((F.col("node") == F.col("rep")).cast("long")).alias("dedup_cnt"))

    return run


for _number, _method, _may in (("j7", "greedy", "TRUE"), ("j8", "greedy_directional", "cnt_dst <= 0.5 * cnt_src"), ("j9", "greedy_singleton", "cnt_dst = 1")):
    query(f"{_number}_{_method}", "WITH RECURSIVE " + _GREEDY.replace("{may}", _may))(_greedy_query(_method))


# kernels: rows only, goldens in the tests
def _kernel_query(make):
    def run(s, d):
        nodes, edges = _graph(s, d)
        return summary.summarize(graphs.settle(make(nodes, edges)), GENE)

    return run


for _name, _make in {
    "j11_mcl": lambda n, e: local.mcl(n, e, GENE),
    "j12_mcl_val": lambda n, e: local.mcl_val(n, e, GENE),
    "j13_mcl_ed": lambda n, e: local.mcl_ed(n, e, GENE),
    "j14_mcl_whole_group": lambda n, e: local.mcl(n, e, GENE, whole_group=True),
    "j15_birch": lambda n, e: local.point_clusters(n, e, GENE, "birch"),
    "j15_affinity_propagation": lambda n, e: local.point_clusters(n, e, GENE, "affinity_propagation"),
    "j15_hdbscan": lambda n, e: local.point_clusters(n, e, GENE, "hdbscan"),
    "j19_dropest_classic": lambda n, e: local.classic_merge(n, e, GENE),
}.items():
    query(_name)(_kernel_query(_make))


@query("j18_dropest")
def j18(s, d):
    nodes = graphs.settle(graphs.build_nodes(reads(s, d), GENE, quality="qual"))
    edges = graphs.settle(graphs.build_edges(nodes, GENE, 1, length=6))
    return summary.summarize(graphs.settle(local.bayes_merge(nodes, edges, GENE)), GENE)


@query("j15_dbscan", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT gene, count(DISTINCT cc) AS dedup_cnt FROM nodes JOIN cc USING (node) GROUP BY gene")
def j15(s, d):
    return local.dbscan_components(_nodes(s, d), GENE).groupBy("gene").agg(F.count_distinct("rep").alias("dedup_cnt"))


# homopolymers: barcodes of parts, tripled, with a base changed by arithmetic
_TRIMERS_SQL = """
trimers AS (
  SELECT p_partkey AS id, p_size AS g, substr(t, 1, p) || substr('ACGT', (p_partkey % 4)::INTEGER + 1, 1) || substr(t, p + 2) AS umi
  FROM (SELECT *, (p_partkey * 7 % 12)::INTEGER AS p, list_reduce(list_transform(generate_series(0, 3), lambda i: repeat(substr('ACGT', ((p_partkey % 60) // (4 ** i)::BIGINT % 4)::INTEGER + 1, 1), 3)), lambda x, y: x || y) AS t FROM part)
), blocks AS (SELECT id, g, umi, i, substr(umi, 3 * i + 1, 3) AS b FROM trimers, (SELECT unnest(generate_series(0, 3))::INTEGER AS i)),
voted AS (SELECT id, g, umi, string_agg(CASE WHEN b[2] = b[3] THEN b[2] ELSE b[1] END, '' ORDER BY i) AS monomer FROM blocks GROUP BY id, g, umi)"""


def _trimers(s, d):
    p = table(s, d, "part")
    t = U.expand(U.number_to_umi(F.col("p_partkey") % 60, 4))
    at = (F.col("p_partkey") * 7 % 12).cast("int")
    changed = F.concat(F.substr(t, F.lit(1), at), F.substr(F.lit("ACGT"), (F.col("p_partkey") % 4).cast("int") + 1, F.lit(1)), F.substr(t, at + 2))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("g"), changed.alias("umi"))


query("h3_majority_vote", f"WITH {_TRIMERS_SQL} SELECT id, monomer FROM voted")(lambda s, d: _trimers(s, d).select("id", U.majority_vote(F.col("umi")).alias("monomer")))
query("h4_take_by_order", f"WITH {_TRIMERS_SQL} SELECT id, string_agg(b[2], '' ORDER BY i) AS monomer FROM blocks GROUP BY id")(lambda s, d: _trimers(s, d).select("id", U.take_by_order(F.col("umi"), 1).alias("monomer")))
query("h5_split_to_all", f"""WITH RECURSIVE {_TRIMERS_SQL}, c AS (SELECT DISTINCT id, i, unnest(string_split(b, '')) AS base FROM blocks),
m AS (SELECT id, 0 AS i, base AS monomer FROM c WHERE i = 0 UNION ALL SELECT m.id, c.i, monomer || base FROM m JOIN c ON c.id = m.id AND c.i = m.i + 1) SELECT id, monomer FROM m WHERE i = 3""")(lambda s, d: _trimers(s, d).select("id", F.explode(U.split_to_all(F.col("umi"))).alias("monomer")))
query("h6_split_by_vote", f"""WITH RECURSIVE {_TRIMERS_SQL}, n AS (SELECT id, i, base, count(*) AS k FROM (SELECT id, i, unnest(string_split(b, '')) AS base FROM blocks) GROUP BY id, i, base),
c AS (SELECT id, i, base FROM n QUALIFY k = max(k) OVER (PARTITION BY id, i)),
m AS (SELECT id, 0 AS i, base AS monomer FROM c WHERE i = 0 UNION ALL SELECT m.id, c.i, monomer || base FROM m JOIN c ON c.id = m.id AND c.i = m.i + 1) SELECT id, monomer FROM m WHERE i = 3""")(lambda s, d: _trimers(s, d).select("id", F.explode(U.split_by_vote(F.col("umi"))).alias("monomer")))
query("h8_expand", "SELECT p_partkey, regexp_replace(upper(substr(p_name, 1, 3)), '(.)', '\\1\\1\\1', 'g') AS umi FROM part".replace("\\\\", "\\"))(lambda s, d: table(s, d, "part").select("p_partkey", U.expand(F.upper(F.substring("p_name", 1, 3))).alias("umi")))
query("h10_conflicts", f"WITH {_TRIMERS_SQL} SELECT id, bool_or(b[1] <> b[2] AND b[2] <> b[3] AND b[1] <> b[3]) AS three, bool_or(b[1] <> b[2] OR b[2] <> b[3]) AS two FROM blocks GROUP BY id")(lambda s, d: _trimers(s, d).select("id", U.has_conflict(F.col("umi"), 3).alias("three"), U.has_conflict(F.col("umi"), 2).alias("two")))
query("h9_dimers", f"WITH {_TRIMERS_SQL}, x AS (SELECT id, umi, i, substr(umi, 2 * i + 1, 2) AS b FROM trimers, (SELECT unnest(generate_series(0, 5))::INTEGER AS i)) SELECT id, string_agg(b[1], '' ORDER BY i) AS left_, string_agg(b[2], '' ORDER BY i) AS right_, bool_or(b[1] <> b[2]) AS conflict FROM x GROUP BY id")(lambda s, d: _trimers(s, d).select("id", U.strand(F.col("umi"), 0, 2).alias("left_"), U.strand(F.col("umi"), 1, 2).alias("right_"), U.has_conflict(F.col("umi"), 2, 2).alias("conflict")))
query("j17_majority_vote", f"WITH {_TRIMERS_SQL}, n AS (SELECT g, umi, any_value(monomer) AS monomer, count(*) AS cnt, min(id) AS node FROM voted GROUP BY g, umi) SELECT g, monomer, count(*) AS multimers, arg_max(umi, node) AS shortlisted, sum(cnt)::BIGINT AS cnt FROM n GROUP BY g, monomer")(lambda s, d: pipeline.majority_vote(_trimers(s, d), ["g"]))


@query("j16_set_cover")
def j16(s, d):
    a = local.set_cover(graphs.build_nodes(_trimers(s, d), ["g"]), ["g"])
    return a.groupBy("g").agg(F.count_distinct("rep").alias("dedup_cnt"), F.count("*").alias("multimers"))


@query("k5_healing", f"WITH {_TRIMERS_SQL}, lib AS (SELECT DISTINCT monomer AS reference FROM voted WHERE id % 9 = 0), p AS (SELECT monomer, reference, hamming(monomer, reference)::INTEGER AS ed, row_number() OVER (PARTITION BY monomer ORDER BY hamming(monomer, reference), reference) AS r FROM (SELECT DISTINCT monomer FROM voted), lib) SELECT id, reference, ed FROM voted JOIN p USING (monomer) WHERE r = 1")
def k5(s, d):
    t = _trimers(s, d)
    library = t.where("id % 9 = 0").select(U.majority_vote(F.col("umi")).alias("reference"))  # every ninth part is a reference
    return pipeline.heal(t, library).select("id", "reference", "ed")


# scalar functions
query("h1_hamming", f"WITH {READS_SQL} SELECT id, hamming(umi, 'ACGTAC')::INTEGER AS h, hamming(substr(umi, 1, 4), 'ACGT')::INTEGER AS h4, CASE WHEN gene % 2 = 0 THEN 6 ELSE hamming(umi, 'ACGTAC') END::INTEGER AS hs FROM reads")(lambda s, d: reads(s, d).select("id", U.packed_hamming(U.pack(F.col("umi")), U.pack(F.lit("ACGTAC"))).alias("h"), U.hamming(F.col("umi"), F.lit("ACGT")).alias("h4"), U.hamming_strict(F.when(F.col("gene") % 2 == 0, F.substring("umi", 1, 3)).otherwise(F.col("umi")), F.lit("ACGTAC")).alias("hs")))
query("h2_one_hot", f"WITH {READS_SQL} SELECT DISTINCT umi, array_to_string(flatten(list_transform(string_split(umi, ''), lambda c: [(c = 'A')::INTEGER, (c = 'C')::INTEGER, (c NOT IN ('A', 'C', 'T'))::INTEGER, (c = 'T')::INTEGER])), '') AS bits FROM reads")(lambda s, d: reads(s, d).select("umi").distinct().select("umi", F.array_join(F.transform(U.one_hot(F.col("umi")), lambda x: x.cast("string")), "").alias("bits")))
query("h13_error_model", "SELECT p_partkey, round(7.0 / 3 * p * p * (1 - p) + p * p * p, 12) AS block, round(3 * p * p - 2 * p * p * p, 12) AS flip, round(1 - (1 - (7.0 / 3 * p * p * (1 - p) + p * p * p)) ** 12, 9) AS code FROM (SELECT p_partkey, p_size / 1000.0::DOUBLE AS p FROM part)")(lambda s, d: table(s, d, "part").withColumn("p", F.col("p_size") / 1000.0).select("p_partkey", F.round(U.block_error(F.col("p")), 12).alias("block"), F.round(U.bitflip_error(F.col("p")), 12).alias("flip"), F.round(U.barcode_error(U.block_error(F.col("p")), 12), 9).alias("code")))
query("h14_digitize", "SELECT p_partkey, ((p_size >= 5)::INTEGER + (p_size >= 20)::INTEGER + (p_size >= 35)::INTEGER) AS bin FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", U.digitize(F.col("p_size").cast("double"), [5.0, 20.0, 35.0]).alias("bin")))
query("h15_loss", "SELECT p_partkey, round(exp(-m) * (1 + m + m * m / 2), 9) AS loss FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS m FROM part)")(lambda s, d: table(s, d, "part").select("p_partkey", F.round(U.loss_probability(F.lit(3), F.col("p_size") / 10.0), 9).alias("loss")))
query("h16_logistic", "SELECT p_partkey, round(10 / (1 + exp(-0.2 * (p_size - 25))), 9) AS y FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", F.round(U.logistic(F.col("p_size").cast("double"), 10.0, 0.2, 25.0), 9).alias("y")))
query("j20_collision", f"WITH {NODES_SQL}, k AS (SELECT gene, count(*) AS umis FROM nodes GROUP BY gene) SELECT gene, umis, round(-4096 * ln(1 - umis / 4096.0), 6) AS corrected FROM k")(lambda s, d: counting.collision_table(reads(s, d).groupBy("gene").agg(F.count_distinct("umi").alias("umis")), 4096.0).withColumn("corrected", F.round("corrected", 6)))


@query("h11_errors")
def h11(s, d):
    u = F.col("umi")
    return reads(s, d).select("id", "umi", U.substitute(u, 0.1, 7).alias("substituted"), U.delete(u, 0.1, 7).alias("deleted"), U.insert(u, 0.1, 7).alias("inserted"))


# counting methods
query("e8_umis_evidence", f"WITH {READS_SQL} SELECT cell, gene, count(*) AS molecules FROM (SELECT cell, gene, umi FROM reads GROUP BY cell, gene, umi HAVING round(sum(1.0::DOUBLE / CASE WHEN nh > 0 THEN nh ELSE 1 END), 9) >= 1) GROUP BY cell, gene")(lambda s, d: counting.umis_counts(counting.umis_evidence(reads(s, d))))
query("e9_cell_gene", f"WITH {READS_SQL} SELECT cell, gene, count(DISTINCT umi) AS umis, count(*) AS reads FROM reads GROUP BY cell, gene")(lambda s, d: counting.cell_gene_summary(counting.molecule_reads(reads(s, d))))
query("d7_quality_counts", f"WITH {READS_SQL} SELECT cell, gene, umi, count(*) AS reads, round(avg(qual), 9) AS quality FROM reads GROUP BY cell, gene, umi")(lambda s, d: counting.quality_counts(reads(s, d)).withColumn("quality", F.round("quality", 9)))


@query("g6_matrix", f"WITH {READS_SQL} SELECT gene, " + ", ".join(f"count(DISTINCT umi) FILTER (cell = {c}) AS \"{c}\"" for c in range(7)) + " FROM reads GROUP BY gene")
def g6(s, d):
    return counting.to_matrix(counting.cell_gene_summary(counting.molecule_reads(reads(s, d))).withColumnRenamed("umis", "molecules"))


query("g6_long", f"WITH {READS_SQL} SELECT gene, cell::VARCHAR AS cell, count(DISTINCT umi) AS molecules FROM reads GROUP BY gene, cell")(lambda s, d: counting.from_matrix(QUERIES["g6_matrix"](s, d)))
query("j24_position_duplicates", f"WITH {READS_SQL}, n AS (SELECT qname, row_number() OVER (PARTITION BY chrom, is_reverse, pos, umi, tlen ORDER BY id) AS r FROM reads WHERE is_read1 AND chrom IS NOT NULL) SELECT id, qname, CASE WHEN qname IN (SELECT qname FROM n WHERE r > 1) THEN 1 ELSE 0 END AS \"PD\" FROM reads")(lambda s, d: counting.mark_by_position(reads(s, d)).select("id", "qname", "PD"))
query("j24_gene_duplicates", f"WITH {READS_SQL}, n AS (SELECT qname, row_number() OVER (PARTITION BY chrom, cell, gene, umi ORDER BY id) AS r FROM reads WHERE chrom IS NOT NULL), m AS (SELECT chrom, CASE WHEN qname IN (SELECT qname FROM n WHERE r > 1) THEN 1 ELSE 0 END AS pd FROM reads) SELECT chrom, count(*) AS total, count(*) FILTER (pd = 0) AS nondup, count(*) FILTER (pd = 1) AS dup FROM m GROUP BY chrom")(lambda s, d: counting.duplicate_totals(counting.mark_by_gene(reads(s, d)), "chrom"))
query("b11_first_per_key", f"WITH {READS_SQL} SELECT cell, gene, umi, min(id) AS id FROM reads GROUP BY cell, gene, umi")(lambda s, d: counting.first_per_key(reads(s, d), ["cell", "gene", "umi"]).select("cell", "gene", "umi", "id"))
query("e12_threshold", f"WITH {READS_SQL}, m AS (SELECT count(*) AS r FROM reads GROUP BY cell, gene, umi) SELECT list_sort(list(r))[(floor(0.9 * (count(*) - 1)) + 1)::BIGINT]::BIGINT AS threshold FROM m")(lambda s, d: s.range(1).select(F.lit(counting.auto_threshold(counting.molecule_reads(reads(s, d)), 0.9)).cast("long").alias("threshold")))


@query("j25_loss_corrected", f"""WITH {READS_SQL}, m AS (SELECT cell, gene, umi, count(*) AS r FROM reads GROUP BY cell, gene, umi),
g AS (SELECT cell, gene, count(*) AS n_obs, avg(r) AS depth FROM m WHERE r >= 2 GROUP BY cell, gene),
f AS (SELECT *, i / 100.0::DOUBLE + 0.05::DOUBLE AS e FROM g, (SELECT unnest(generate_series(0, 94)) AS i)),
l AS (SELECT *, exp(-depth * e) * (1 + depth * e) AS loss FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY cell, gene ORDER BY round(abs(depth * e / greatest(1 - loss, 1e-12) - depth), 9), e) AS k FROM l)
SELECT cell, gene, n_obs, round(depth, 9) AS depth, round(e, 9) AS efficiency, round(loss, 6) AS loss, round(n_obs / greatest(1 - loss, 1e-12), 6) AS n_tot FROM b WHERE k = 1""")
def j25(s, d):
    df = counting.loss_corrected(counting.molecule_reads(reads(s, d)), 2)
    return df.select("cell", "gene", "n_obs", F.round("depth", 9).alias("depth"), F.round("efficiency", 9).alias("efficiency"), F.round("loss", 6).alias("loss"), F.round("n_tot", 6).alias("n_tot"))


query("e13_spikes", f"WITH {READS_SQL}, s AS (SELECT umi, count(*) AS \"N\", count(DISTINCT cell) AS \"nBCs\" FROM reads GROUP BY umi) SELECT umi, \"N\", \"nBCs\", (sum(\"N\") OVER (ORDER BY \"N\"))::BIGINT AS cs, count(*) OVER (ORDER BY \"nBCs\") AS row FROM s")(lambda s, d: counting.overrepresented(reads(s, d), 1000, 5)[0])


@query("f6_spike_subsample")
def f6(s, d):
    return counting.subsample_spikes(reads(s, d), 100.0)


@query("j26_spike_correction")
def j26(s, d):
    return summary.spike_corrected(reads(s, d).select("id", "cell", "umi"), ["cell"], dedup.greedy, 1)


def _features(s, d):
    r = reads(s, d)
    return r.select("cell", "umi", F.col("id").alias("read"), F.explode(F.array(F.col("pos").cast("string"), ((F.col("pos") + F.col("nh")) % 50).cast("string"))).alias("feature"))


query("e10_equivalence_classes", f"WITH {READS_SQL}, x AS (SELECT DISTINCT cell, umi, id, unnest([pos::VARCHAR, ((pos + nh) % 50)::VARCHAR]) AS f FROM reads), r AS (SELECT cell, id, min(umi) AS umi, string_agg(f, ',' ORDER BY f) AS features FROM x GROUP BY cell, id) SELECT cell, umi, features, count(*) AS cnt FROM r GROUP BY cell, umi, features")(lambda s, d: counting.equivalence_classes(_features(s, d)).select("cell", "umi", F.array_join("features", ",").alias("features"), "cnt"))


@query("j21_irescue_molecules")
def j21(s, d):
    classes = graphs.settle(counting.equivalence_classes(_features(s, d)))
    return counting.class_molecules(classes, graphs.settle(counting.class_arcs(classes)))


@query("j22_redistributed_counts")
def j22(s, d):
    return counting.redistributed(j21(s, d))


# benchmark tables
query("d8_relative_to_count", "SELECT s_suppkey, cnt, tpm, CASE WHEN cnt <> 0 THEN round((cnt - tpm) / cnt, 9) END AS error FROM (SELECT l_suppkey AS s_suppkey, count(*) % 600 AS cnt FROM lineitem GROUP BY l_suppkey) LEFT JOIN (SELECT s_suppkey, s_acctbal AS tpm FROM supplier) USING (s_suppkey)")(lambda s, d: statistics.relative_to_count(table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg((F.count("*") % 600).alias("cnt")), table(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("tpm")), "s_suppkey").withColumn("error", F.round("error", 9)))
query("d9_relative_to_truth", "SELECT c_custkey, coalesce(cnt, 0) AS cnt, tpm, CASE WHEN tpm <> 0 THEN round((coalesce(cnt, 0) - tpm) / tpm, 9) END AS error FROM (SELECT c_custkey, c_acctbal AS tpm FROM customer) LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS cnt FROM orders GROUP BY 1) USING (c_custkey)")(lambda s, d: statistics.relative_to_truth(table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("cnt")), table(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("tpm")), "c_custkey").withColumn("error", F.round("error", 9)))


def _permutations(s, d):
    return reads(s, d).groupBy(F.col("cell").alias("permutation"), F.col("chrom").alias("method"), F.col("pos").alias("condition")).agg(F.count_distinct("umi").alias("count"))


_PERM_SQL = "perm AS (SELECT cell AS permutation, chrom AS method, pos AS condition, count(DISTINCT umi) AS count FROM reads GROUP BY cell, chrom, pos)"


@query("e15_permutation_stats", f"WITH {READS_SQL}, {_PERM_SQL} SELECT method, condition, round(avg((count - 50) / 50.0), 9) AS mean, round(max((count - 50) / 50.0), 9)::DOUBLE AS max, round(min((count - 50) / 50.0), 9)::DOUBLE AS min, round(stddev_samp((count - 50) / 50.0), 9) AS std FROM perm GROUP BY method, condition")
def e15(s, d):
    df = statistics.permutation_stats(_permutations(s, d), ["method", "condition"], 50.0)
    return df.select("method", "condition", *(F.round(c, 9).alias(c) for c in ("mean", "max", "min", "std")))


@query("e15_permutation_stats_compat", f"WITH {READS_SQL}, {_PERM_SQL}, a AS (SELECT method, condition, list((count - 50) / 50.0::DOUBLE) AS l FROM perm GROUP BY method, condition) SELECT method, condition, round(list_stddev_samp(l || [list_avg(l), list_max(l), list_min(l)]), 9) AS std FROM a")
def e15_compat(s, d):
    return statistics.permutation_stats(_permutations(s, d), ["method", "condition"], 50.0, compat=True).select("method", "condition", F.round("std", 9).alias("std"))


@query("e19_method_table", f"WITH {READS_SQL}, {_PERM_SQL} SELECT method, condition, median(count) AS median, round(avg(count), 9) AS mean, sum(count)::BIGINT AS total, quantile_cont(count, 0.25) AS q1, quantile_cont(count, 0.75) AS q3, round(stddev_samp(count) / sqrt(count(*)), 9) AS sem FROM perm GROUP BY method, condition")
def e19(s, d):
    df = statistics.method_table(_permutations(s, d), ["method", "condition"], "count")
    return df.withColumn("mean", F.round("mean", 9)).withColumn("sem", F.round("sem", 9))


@query("e19_best_method", f"WITH {READS_SQL}, {_PERM_SQL}, t AS (SELECT method, condition, avg((count - 50) / 50.0::DOUBLE) AS e FROM perm GROUP BY method, condition) SELECT condition, arg_min(method, (round(abs(e), 9), method)) AS best FROM t GROUP BY condition")
def e19_best(s, d):
    t = statistics.permutation_stats(_permutations(s, d), ["method", "condition"], 50.0).withColumn("mean", F.round(F.abs("mean"), 9))
    return statistics.best_method(t, ["condition"], "mean")


def _expression(s, d):
    return reads(s, d).groupBy("gene", "cell").agg(F.count("*").alias("value"))


_EXPR_SQL = "expr AS (SELECT gene, cell, count(*) AS value FROM reads GROUP BY gene, cell)"
query("e20_expression_stats", f"WITH {READS_SQL}, {_EXPR_SQL} SELECT gene, round(sum(value) / 7.0, 9)::DOUBLE AS mean, round(sum(value * value) / 7.0 - (sum(value) / 7.0) * (sum(value) / 7.0), 6)::DOUBLE AS variance FROM expr GROUP BY gene")(lambda s, d: statistics.expression_stats(_expression(s, d), "gene", 7).select("gene", F.round("mean", 9).alias("mean"), F.round("variance", 6).alias("variance")))
query("g2_extreme_genes", f"WITH {READS_SQL}, {_EXPR_SQL} SELECT gene, round(sum(value) / 7.0, 9)::DOUBLE AS mean FROM expr GROUP BY gene ORDER BY sum(value) DESC, gene LIMIT 10")(lambda s, d: statistics.extreme_genes(_expression(s, d), 10, 7).select("gene", F.round("mean", 9).alias("mean")))
query("g2_dominant_genes", f"WITH {READS_SQL}, {_EXPR_SQL}, t AS (SELECT cell, gene FROM expr QUALIFY row_number() OVER (PARTITION BY cell ORDER BY value DESC, gene) = 1) SELECT gene, count(*) AS n FROM t GROUP BY gene HAVING count(*) > 0.1 * 7")(lambda s, d: statistics.dominant_genes(_expression(s, d), 0.1, 7))


# pipelines
_K1 = _SQL["directional"].replace("gene", "pc").replace("l_suppkey AS pc", "(l_orderkey % 7) * 100 + l_partkey % 50 AS pc").replace("pcrate_series", "generate_series")


@query("k1_standard", f"WITH RECURSIVE {_K1} SELECT pc // 100 AS permutation, pc % 100 AS condition, count(*) FILTER (node = rep) AS dedup_cnt FROM assigned GROUP BY pc")
def k1(s, d):
    r = reads(s, d).withColumn("permutation", F.col("cell")).withColumn("condition", F.col("pos"))
    return pipeline.standard(r.select("id", "umi", "permutation", "condition"))


@query("k2_heterogeneity")
def k2(s, d):
    r = reads(s, d).select("id", "umi", "pos", F.col("cell").alias("permutation"), F.lit(0).alias("condition"))
    return pipeline.heterogeneity(r, F.col("pos"))[1]
