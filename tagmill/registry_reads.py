"""Queries of read selection, dialects, presets, traces and sweeps, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.fixtures import NODES_SQL, READS_SQL, reads, table
from tagmill.functions import umi as U
from tagmill.operators import counting, dedup, graphs, summary
from tagmill.plans import pipeline, statistics
from tagmill.registry import _GREEDY, _SQL, GENE, ORACLE_SQL, QUERIES, _graph, query
from tagmill.sources import dialects, sinks, tables

__all__ = ["ORACLE_SQL", "QUERIES"]


# selection, order and tags of reads
@query("b2_unique_reads", f"WITH {READS_SQL} SELECT id, gene, umi, pos FROM reads WHERE cell = 3")
def b2(s, d):
    r = reads(s, d).select("id", "gene", "umi", "pos", "cell")
    twice = r.unionByName(r.where("pos < 20"))
    return sinks.unique_reads(twice, r.where("cell = 3").select("id")).select("id", "gene", "umi", "pos")


@query(
    "b3_tags_by_name",
    f"""WITH {READS_SQL}, t AS (SELECT qname, min(gene) AS gene_tag, max(nh) AS hits FROM reads WHERE cell < 3 GROUP BY qname)
SELECT id, gene_tag, hits FROM reads LEFT JOIN t USING (qname)""",
)
def b3(s, d):
    r = reads(s, d)
    tags = r.where("cell < 3").groupBy("qname").agg(F.min("gene").alias("gene_tag"), F.max("nh").alias("hits"))
    return sinks.with_tags(r, tags).select("id", "gene_tag", "hits")


@query("b5_coordinate_order", f"WITH {READS_SQL} SELECT id, row_number() OVER (ORDER BY CASE WHEN nh = 0 THEN NULL ELSE chrom END NULLS LAST, pos, id) - 1 AS ordinal FROM reads")
def b5(s, d):
    r = reads(s, d).withColumn("chrom", F.when(F.col("nh") != 0, F.col("chrom")))
    return sinks.with_ordinal(r).select("id", "ordinal")


_BEST = f"""WITH {READS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY cell, gene, umi ORDER BY qual DESC, id) AS k FROM reads)
SELECT id, cell, gene, umi, {{columns}}"""


@query("b11_best_quality", _BEST.replace("{columns}", "qual FROM r WHERE k = 1"))
def b11_best(s, d):
    return sinks.representatives(reads(s, d), ["cell", "gene", "umi"], best=F.col("qual")).select("id", "cell", "gene", "umi", "qual")


@query("b11_marked", _BEST.replace("{columns}", 'CASE WHEN k = 1 THEN 0 ELSE 1 END AS "PD" FROM r'))
def b11_marked(s, d):
    return sinks.representatives(reads(s, d), ["cell", "gene", "umi"], best=F.col("qual"), mode="mark").select("id", "cell", "gene", "umi", "PD")


@query(
    "b12_representative_map",
    f"WITH RECURSIVE {_SQL['directional']} SELECT gene, rep, string_agg(node::VARCHAR, ',' ORDER BY node) AS nodes FROM assigned GROUP BY gene, rep",
)
def b12(s, d):
    nodes, edges = _graph(s, d)
    found = sinks.representative_map(dedup.directional(nodes, edges, GENE), GENE)
    return found.select("gene", "rep", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"))


# predicates
_FLAGS = "(id // 7 % 4096)::INTEGER AS flag, (id % 60)::INTEGER AS mapq, CASE WHEN nh = 0 THEN NULL ELSE gene::VARCHAR END AS g, CASE WHEN cell = 6 THEN NULL ELSE cell END AS c"


@query(
    "c7_primary_reads",
    f"""WITH {READS_SQL}, r AS (SELECT id, umi, chrom, {_FLAGS} FROM reads)
SELECT id, c AS cell, coalesce(g, chrom) AS gene FROM r
WHERE flag & 4 = 0 AND flag & 256 = 0 AND flag & 2048 = 0 AND mapq >= 20 AND (flag & 1 = 0 OR flag & 64 <> 0) AND c IS NOT NULL""",
)
def c7(s, d):
    r = reads(s, d).select(
        "id", "umi", F.col("chrom").alias("contig"), F.expr("cast(id div 7 % 4096 as int)").alias("flag"), F.expr("cast(id % 60 as int)").alias("mapq"),
        F.when(F.col("nh") != 0, F.col("gene").cast("string")).alias("gene"), F.when(F.col("cell") != 6, F.col("cell")).alias("cell"),
    )
    return counting.primary_reads(r, 20).select("id", "cell", "gene")


@query(
    "c12_stratified",
    f"""WITH {READS_SQL}, r AS (SELECT id, cell, row_number() OVER (PARTITION BY cell ORDER BY md5(id::VARCHAR || '/42'), id) AS p, count(*) OVER (PARTITION BY cell) AS n FROM reads)
SELECT id, cell FROM r WHERE p <= round(n * 0.1)""",
)
def c12(s, d):
    return statistics.stratified(reads(s, d).select("id", "cell"), "cell", 0.1)


# names and dialects
_NAMED = {"cb_len": 6, "umi_len": 5}


def _records(s, d, name):
    r = reads(s, d)
    return r.select("id", "gene", "cell", "umi", "pos", "nh", name(r).alias("name"), F.concat("umi", F.reverse("umi"), "umi").alias("seq"))


def _say(*parts):
    return F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))


_SEQ = "umi || reverse(umi) || umi"


@query(
    "a11_asarusim",
    f"""WITH {READS_SQL}, r AS (SELECT *, {_SEQ} AS seq FROM reads)
SELECT id, substr(seq, 1, 6) AS "CB", substr(seq, 7, 5) AS "MB", CASE WHEN id % 2 = 0 THEN umi ELSE '' END AS "TB", 'T' || gene AS "XT" FROM r""",
)
def a11_asarusim(s, d):
    records = _records(s, d, lambda r: _say("c-", r["cell"], "-", r["umi"], "-T", r["gene"], "-", r["id"]))
    truth = records.where("id % 2 = 0").select(F.col("name").alias("id"))
    return dialects.asarusim(records, truth, **_NAMED).select("id", "CB", "MB", "TB", "XT")


@query(
    "a11_screadsim",
    f"""WITH {READS_SQL}, r AS (SELECT *, {_SEQ} AS seq FROM reads)
SELECT id, substr(seq, 1, 6) AS "CB", substr(seq, 7, 5) AS "MB", CASE WHEN nh = 0 THEN NULL ELSE substr(seq, 7, 5) END AS "TB",
       CASE nh WHEN 0 THEN 'GENE' || gene WHEN 1 THEN 'ENS' || gene ELSE 'chr1_' || pos || '_+' END AS "XT" FROM r""",
)
def a11_screadsim(s, d):
    def name(r):
        mark = F.when(r["nh"] == 0, _say("_GENE", r["gene"])).when(r["nh"] == 1, _say("_ENS", r["gene"])).otherwise("")
        truth = F.when(r["nh"] == 0, r["umi"]).otherwise(F.concat("umi", F.reverse("umi")))
        return F.concat(truth, F.lit(":CellNo1:chr1_"), r["pos"].cast("string"), mark, F.lit("_+#"), r["id"].cast("string"))

    return dialects.screadsim(_records(s, d, name), **_NAMED).select("id", "CB", "MB", "TB", "XT")


@query(
    "a11_minnow",
    f"""WITH {READS_SQL}, r AS (SELECT *, {_SEQ} AS seq FROM reads)
SELECT id, substr(seq, 1, 6) AS "CB", substr(seq, 7, 5) AS "MB", substr(seq, 7, 5) AS "TB", 'tx' || gene AS "XT" FROM r""",
)
def a11_minnow(s, d):
    return dialects.minnow(_records(s, d, lambda r: _say("n", r["id"], ":tx", r["gene"], ":0")), **_NAMED).select("id", "CB", "MB", "TB", "XT")


@query("a11_tresor", f"""WITH {READS_SQL} SELECT id, cell::VARCHAR AS "CB", gene::VARCHAR AS "XF", substr({_SEQ}, 15, 4) AS "MB" FROM reads""")
def a11_tresor(s, d):
    return dialects.tresor(_records(s, d, lambda r: _say("29*s*", r["cell"], "*g*", r["gene"], "*_1-pcr-5")), umi_start=-4, umi_len=4).select("id", "CB", "XF", "MB")


def _molecule_lines(s, d):
    """A description of parts as molecules, four lines each."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("k"))
    info = F.when(F.col("k") % 3 == 0, _say("depth=1 info(CB=C", F.col("k") % 10, ";XT=x", F.col("k") % 4, ";)")).when(F.col("k") % 3 == 1, _say("tid=t", F.col("k") % 7, " info(TB=ACGT;)")).otherwise(F.lit("depth=2"))
    lines = F.array(F.concat(F.lit("+M"), F.col("k").cast("string"), F.lit("\t"), info), _say("chr", F.col("k") % 5, " 10 20 +"), F.lit("AAAAAAAA 0 8 +"), F.concat(U.number_to_umi(F.col("k"), 6), F.lit(" 0 6 +")))
    return p.select("k", F.posexplode(lines).alias("j", "value")).select((F.col("k") * 4 + F.col("j")).alias("line"), "value")


_MOLECULES = """molecules AS (SELECT 'M' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'C' || p_partkey % 10 END AS cb,
  CASE WHEN p_partkey % 3 = 1 THEN 'ACGT'
       ELSE list_reduce(list_transform(generate_series(0, 5), lambda i: substr('ACGT', (p_partkey // (4 ** i)::BIGINT % 4)::INTEGER + 1, 1)), lambda x, y: x || y) END AS tb_seen,
  CASE WHEN p_partkey % 3 = 1 THEN 't' || p_partkey % 7 END AS tid, CASE WHEN p_partkey % 3 = 0 THEN 'x' || p_partkey % 4 ELSE 'chr' || p_partkey % 5 END AS xt FROM part),
told AS (SELECT id, cb, CASE WHEN tb_seen = 'AAAAAA' THEN NULL ELSE tb_seen END AS tb, tid, xt FROM molecules)"""


@query("a11_molecules", f'WITH {_MOLECULES} SELECT id, cb AS "CB", tb AS "TB", tid, xt AS "XT" FROM told')
def a11_molecules(s, d):
    return dialects.molecules(_molecule_lines(s, d), umi_len=6)


@query(
    "a11_tksm",
    f"""WITH {READS_SQL}, {_MOLECULES}, r AS (SELECT *, {_SEQ} AS seq, id % 400 + 1 AS m FROM reads),
j AS (SELECT r.*, p.cb AS pcb, p.tb AS ptb, p.tid AS ptid, p.xt AS pxt, t.cb AS tcb, t.tb AS ttb, t.tid AS ttid, t.xt AS txt
      FROM r LEFT JOIN (SELECT * FROM told WHERE substr(id, 2)::BIGINT % 2 = 0) p ON nh = 0 AND p.id = 'M' || m LEFT JOIN told t ON nh <> 2 AND t.id = 'M' || m)
SELECT id, coalesce(tcb, pcb, substr(seq, 1, 6)) AS "CB", substr(seq, 14, 5) AS "MB", coalesce(ptb, ttb, substr(seq, 14, 5)) AS "TB", coalesce(ptid, ttid, pxt, txt, 'NA') AS "XT" FROM j""",
)
def a11_tksm(s, d):
    def name(r):
        m = (r["id"] % 400 + 1).cast("string")
        return F.when(r["nh"] == 2, F.lit("plain")).when(r["nh"] == 1, F.concat(F.lit("x molecule_id=M"), m, F.lit(".1.2;y"))).otherwise(F.concat(F.lit("x molecule_id=M"), m))

    told = graphs.settle(dialects.molecules(_molecule_lines(s, d), umi_len=6))
    amplified = told.where("cast(substr(id, 2) as bigint) % 2 = 0")
    return dialects.tksm(_records(s, d, name), told, amplified, **_NAMED).select("id", "CB", "MB", "TB", "XT")


@query("b7_bulk_genes", "SELECT p_partkey, (p_partkey % 90)::INTEGER AS \"XT\", 'Assigned' AS \"XS\", 1 AS \"PO\" FROM part")
def b7_bulk(s, d):
    p = table(s, d, "part").withColumn("name", _say("a-b-pcr-1-", F.col("p_partkey") % 90, "-z"))
    return dialects.bulk(dialects.bulk_genes(p)).select("p_partkey", "XT", "XS", "PO")


@query("b7_starred", "SELECT p_partkey, (p_partkey % 12)::INTEGER AS \"BC\", p_size::INTEGER AS \"XT\" FROM part")
def b7_star(s, d):
    p = table(s, d, "part").withColumn("name", _say("1*c*", F.col("p_partkey") % 12, "*g*", F.col("p_size"), "*_x"))
    return dialects.starred(p).select("p_partkey", "BC", "XT")


# result tables
@query("a13_counts", "SELECT p_partkey::VARCHAR AS transcript_id, p_size::DOUBLE AS dedup_cnt FROM part WHERE p_size % 5 <> 0")
def a13(s, d):
    count = F.when(F.col("p_size") % 5 == 0, F.lit("NA")).otherwise(F.col("p_size").cast("string"))
    return statistics.counts_of(table(s, d, "part").select(F.col("p_partkey").alias("target_id"), count.alias("dedup_cnt"), "p_name"))


# presets: reads of one technology at their own grouping
_ASSIGNED = f"WITH {READS_SQL}, a AS (SELECT * FROM reads WHERE nh <> 0)"


def _tagged(s, d):
    return reads(s, d).withColumns({"XS": F.when(F.col("nh") != 0, "Assigned").otherwise("Unassigned"), "XT": F.col("gene"), "BC": F.col("cell"), "PO": F.col("pos")})


def _unique(d):
    return d.assign("unique").groupBy(*d.keys).agg(F.count("*").alias("dedup_cnt"))


@query("c2_assigned_by_gene", f'{_ASSIGNED} SELECT gene AS "XT", count(DISTINCT umi) AS dedup_cnt FROM a GROUP BY gene')
def c2(s, d):
    return _unique(pipeline.by_gene(_tagged(s, d)))


@query("j28_single_cell", f'{_ASSIGNED} SELECT cell AS "BC", gene AS "XT", count(DISTINCT umi) AS dedup_cnt FROM a GROUP BY cell, gene')
def j28_cell(s, d):
    return _unique(pipeline.single_cell(_tagged(s, d), cell="BC"))


@query("j28_multi_position", f'WITH {READS_SQL} SELECT pos AS "PO", count(DISTINCT umi) AS dedup_cnt FROM reads GROUP BY pos')
def j28_positions(s, d):
    return _unique(pipeline.multi_position(_tagged(s, d)))


@query("j28_one_position", f"WITH {READS_SQL} SELECT 1 AS source, count(DISTINCT umi) AS dedup_cnt FROM reads")
def j28_one(s, d):
    return _unique(pipeline.one_position(_tagged(s, d)))


@query(
    "j27_presets",
    f"""WITH {READS_SQL} SELECT 'minnow' AS preset, cell::VARCHAR AS cell, gene::VARCHAR AS gene, count(DISTINCT umi) AS dedup_cnt FROM reads WHERE length(umi) = 6 GROUP BY cell, gene
UNION ALL SELECT 'spikein', cell::VARCHAR, NULL, count(DISTINCT umi) FROM reads WHERE chrom = 'A' GROUP BY cell
UNION ALL SELECT 'cmi', cell::VARCHAR, NULL, count(DISTINCT umi) FROM (SELECT cell, umi, nh FROM reads) GROUP BY cell""",
)
def j27(s, d):
    r = reads(s, d).select("id", F.col("umi").alias("MB"), F.col("cell").cast("string").alias("CB"), F.col("gene").cast("string").alias("XT"), F.col("chrom").alias("contig"))
    out = None
    for name, extra in (("minnow", {}), ("spikein", {"spikes": ["A"]}), ("cmi", {})):
        run = pipeline.preset(name, r, **extra)
        part = run.assign("unique").groupBy(*run.keys).agg(F.count("*").alias("dedup_cnt"))
        gene = F.col("XT") if "XT" in run.keys else F.lit(None).cast("string")
        part = part.select(F.lit(name).alias("preset"), F.col("CB").alias("cell"), gene.alias("gene"), "dedup_cnt")
        out = part if out is None else out.unionByName(part)
    return out


# traces by origin: a molecule's origin is the place of its first read
_TRACE = f"""WITH RECURSIVE {_SQL["directional"]},
traced AS (SELECT e.gene, e.src, e.dst, a.cc, (greatest(e.cnt_src, e.cnt_dst) >= 2 * least(e.cnt_src, e.cnt_dst) - 1) AND a.rep = b.rep AS approved
           FROM edges e JOIN assigned a ON a.node = e.src JOIN assigned b ON b.node = e.dst),
origins AS (SELECT node, pos % 3 AS origin, cnt FROM nodes JOIN (SELECT DISTINCT id, pos FROM reads) r ON r.id = nodes.node),
named AS (SELECT t.*, x.origin AS o1, y.origin AS o2 FROM traced t JOIN origins x ON x.node = t.src JOIN origins y ON y.node = t.dst)"""


def _traced(s, d):
    nodes, edges = _graph(s, d)
    assignment = graphs.settle(dedup.directional(nodes, edges, GENE))
    origins = graphs.settle(reads(s, d).select(F.col("id").alias("node"), (F.col("pos") % 3).alias("origin")).join(nodes.select("node"), "node", "left_semi"))
    traced = dedup.trace(assignment, nodes, edges).join(nodes.select(F.col("node").alias("src"), "gene"), "src")
    return nodes, edges, graphs.settle(traced), origins


_EDGE_CLASSES = "SELECT gene, approved, sum((o1 = o2)::INTEGER)::BIGINT AS same, sum((o1 <> o2)::INTEGER)::BIGINT AS diff, count(*) AS total FROM named GROUP BY gene, approved"


@query("e21_edge_classes", f"{_TRACE} {_EDGE_CLASSES}")
def e21(s, d):
    _, _, traced, origins = _traced(s, d)
    return statistics.origin_edges(traced, origins, GENE)


@query("e21_edge_shares", f"{_TRACE}, s AS (SELECT cc, avg((o1 = o2)::INTEGER) FILTER (approved) AS share FROM (SELECT DISTINCT cc FROM assigned) LEFT JOIN named USING (cc) GROUP BY cc) SELECT round(avg(coalesce(share, 0)), 9) AS share FROM s")
def e21_shares(s, d):
    nodes, edges, traced, origins = _traced(s, d)
    return statistics.origin_shares(traced, origins, graphs.with_components(nodes, edges).select("node", "cc")).select(F.round("share", 9).alias("share"))


@query(
    "e21_representative_matches",
    f"""{_TRACE}, ends AS (SELECT cc, approved, node, origin, cnt FROM (SELECT cc, approved, unnest([src, dst]) AS node FROM traced) JOIN origins USING (node)),
tops AS (SELECT cc, approved, node AS rep, origin AS of_ FROM ends QUALIFY row_number() OVER (PARTITION BY cc, approved ORDER BY cnt DESC, node) = 1)
SELECT cc, approved, rep, of_ AS origin, coalesce(string_agg(node::VARCHAR, ',' ORDER BY node) FILTER (origin = of_), '') AS same,
       coalesce(string_agg(node::VARCHAR, ',' ORDER BY node) FILTER (origin <> of_), '') AS diff
FROM ends JOIN tops USING (cc, approved) GROUP BY cc, approved, rep, of_""",
)
def e21_matches(s, d):
    nodes, edges, traced, origins = _traced(s, d)
    found = statistics.representative_matches(traced, nodes, origins, graphs.with_components(nodes, edges).select("node", "cc"))
    text = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",").alias(c)
    return found.select("cc", "approved", "rep", "origin", text("same"), text("diff"))


@query(
    "e16_trace_table",
    f"""{_TRACE}, e AS ({_EDGE_CLASSES}) SELECT gene % 5 AS metric, approved, round(avg(diff), 9) AS diff_origin, max(diff) AS diff_origin_max, min(diff) AS diff_origin_min,
       round(avg(same), 9) AS same_origin, max(same) AS same_origin_max, min(same) AS same_origin_min FROM e GROUP BY gene % 5, approved""",
)
def e16(s, d):
    edges = QUERIES["e21_edge_classes"](s, d).select((F.col("gene") % 5).alias("metric"), "approved", F.col("diff").alias("diff_origin"), F.col("same").alias("same_origin"))
    found = statistics.trace_table(edges, ("metric", "approved"))
    return found.withColumn("diff_origin", F.round("diff_origin", 9)).withColumn("same_origin", F.round("same_origin", 9))


_K2 = _TRACE.replace("gene", "pc").replace("l_suppkey AS pc", "l_orderkey % 7 AS pc").replace("pcrate_series", "generate_series").replace("pos % 3 AS origin", "pos AS origin")
query("k2_heterogeneity", f"{_K2} SELECT pc AS permutation, 0 AS condition, approved, sum((o1 = o2)::INTEGER)::BIGINT AS same, sum((o1 <> o2)::INTEGER)::BIGINT AS diff, count(*) AS total FROM named GROUP BY pc, approved")(QUERIES["k2_heterogeneity"])

# a sweep: counts of the directional method under several ratios
_RATIO = "SELECT gene, {r}::DOUBLE AS ratio, count(*) AS dedup_cnt FROM assigned WHERE node = rep GROUP BY gene"
_SWEEP = [(f"WITH RECURSIVE {_SQL['directional'].replace('2 * cnt_dst', f'{r} * cnt_dst')} {_RATIO.replace('{r}', str(r))}") for r in (1, 2, 3)]


@query("k2_sweep", " UNION ALL ".join(f"SELECT * FROM ({q})" for q in _SWEEP))
def k2_sweep(s, d):
    run = pipeline.Dedup(reads(s, d), GENE)
    return pipeline.sweep(run, "directional", "ratio", [1.0, 2.0, 3.0])


@query("e17_sweep_error", f"WITH {READS_SQL} SELECT cell AS scenario, pos AS value, round((count(DISTINCT umi) - 50) / 50.0, 9) AS error FROM reads GROUP BY cell, pos")
def e17(s, d):
    counts = reads(s, d).groupBy(F.col("cell").alias("scenario"), F.col("pos").alias("value")).agg(F.count_distinct("umi").alias("cnt"))
    return statistics.sweep_error(counts, 50).select("scenario", "value", F.round("error", 9).alias("error"))


@query("e18_spike_union", f"WITH {NODES_SQL} SELECT gene, 'unique' AS method, count(*) AS dedup_cnt FROM nodes GROUP BY gene UNION ALL SELECT gene, 'seen_twice', count(*) FROM nodes WHERE cnt > 1 GROUP BY gene")
def e18(s, d):
    nodes = graphs.build_nodes(reads(s, d), GENE)
    count = lambda df: df.groupBy("gene").agg(F.count("*").alias("dedup_cnt"))
    return statistics.spike_union({"unique": count(nodes), "seen_twice": count(nodes.where("cnt > 1"))}).select("gene", "method", "dedup_cnt")


@query(
    "e11_class_summary",
    f"""WITH {READS_SQL}, x AS (SELECT cell, umi, CASE WHEN nh = 0 THEN NULL ELSE substr(umi, 1, 5) || 'A' END AS d, unnest([gene::VARCHAR, (gene % 10)::VARCHAR]) AS gene FROM reads),
y AS (SELECT cell, gene, umi, coalesce(d, umi) AS c FROM x)
SELECT cell, gene, count(DISTINCT c) AS dedup_cnt, count(DISTINCT umi) AS num_uniq_umis, (count(DISTINCT umi) - len(list_intersect(list(DISTINCT umi), list(DISTINCT c))))::BIGINT AS num_removed_umis,
       sum((c <> umi)::INTEGER)::BIGINT AS num_replaced FROM y GROUP BY cell, gene""",
)
def e11(s, d):
    short = F.concat(F.substring("umi", 1, 5), F.lit("A"))
    dump = reads(s, d).select("cell", F.col("umi").alias("UMI"), F.when(F.col("nh") != 0, short).alias("Dedup_UMI"), _say(F.col("gene"), ",", F.col("gene") % 10).alias("features"))
    return counting.class_summary(dump).withColumn("num_removed_umis", F.col("num_removed_umis").cast("long"))


# seeded draws
_U = "(('0x' || substr(md5({key}), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496.0"


def _draw_sql(what: str) -> str:
    return _U.replace("{key}", f"umi || '/' || i || '/{what}/7'")


_SUB = f"CASE WHEN {_draw_sql('sub')} < 0.1 THEN substr(replace('ACGT', b, ''), (ceil({_draw_sql('base')} * 3))::INTEGER, 1) ELSE b END"
_INS = f"CASE WHEN {_draw_sql('ins')} < 0.1 THEN b || substr('ACGT', (ceil({_draw_sql('new')} * 4))::INTEGER, 1) ELSE b END"
query(
    "h11_errors",
    f"""WITH {READS_SQL}, u AS (SELECT DISTINCT umi FROM reads), p AS (SELECT umi, i, substr(umi, i + 1, 1) AS b FROM u, (SELECT unnest(generate_series(0, 5))::INTEGER AS i)),
e AS (SELECT umi, string_agg({_SUB}, '' ORDER BY i) AS substituted, coalesce(string_agg(b, '' ORDER BY i) FILTER ({_draw_sql("del")} >= 0.1), '') AS deleted, string_agg({_INS}, '' ORDER BY i) AS inserted FROM p GROUP BY umi)
SELECT id, umi, substituted, deleted, inserted FROM reads JOIN e USING (umi)""",
)(QUERIES["h11_errors"])

_CELL = _U.replace("{key}", "cell::VARCHAR || '/{what}/42'")
query(
    "f6_spike_subsample",
    f"""WITH {READS_SQL}, x AS (SELECT DISTINCT cell, umi FROM reads),
y AS (SELECT cell, umi, row_number() OVER (PARTITION BY cell ORDER BY md5(cell::VARCHAR || '/' || umi || '/42'), umi) AS p, count(*) OVER (PARTITION BY cell) AS n FROM x)
SELECT cell, umi FROM y WHERE n >= 80 AND p <= round(100 + 10 * sqrt(-2 * ln({_CELL.replace("{what}", "a")})) * cos(2 * pi() * {_CELL.replace("{what}", "b")}))""",
)(QUERIES["f6_spike_subsample"])

# spike correction: the greedy walk by cell, each node with the representative that takes it
_J26 = _GREEDY.replace("{may}", "TRUE").split("SELECT gene, sum(len(reps))")[0].replace("gene", "pc").replace("l_suppkey AS pc", "l_orderkey % 7 AS pc").replace("pcrate_series", "generate_series")
query(
    "j26_spike_correction",
    f"""WITH RECURSIVE {_J26}, taken AS (SELECT r.node, r.pc, r.umi, r.cc, CASE WHEN list_contains(reps, r.r) THEN r.r ELSE list_min(list_intersect(reps, t.t)) END AS by_
  FROM ranked r JOIN last USING (cc) JOIN takers t ON t.node = r.node)
SELECT reads.id, reads.pc AS cell, reads.umi, s.umi AS corrected FROM reads JOIN taken a ON a.pc = reads.pc AND a.umi = reads.umi JOIN ranked s ON s.cc = a.cc AND s.r = a.by_""",
)(QUERIES["j26_spike_correction"])
