"""Queries by survey id over the derived fact tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import patterns, sqlguard
from ..operators import collectors, graph, impact, incremental, taint, trace, types
from ..scratch import spread, written
from ..sources.catalog import FactCatalog, changed_files, digests
from . import facts

Load = Callable[[str], DataFrame]
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers ``f(load)`` under its name; ``sql`` is the oracle over ``{facts}``."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made: dict[str, DataFrame] = {}

            def load(name: str) -> DataFrame:
                return facts.frame(spark, sf_dir, name, made)

            load.made = made
            return f(load)

        run.__doc__ = f.__doc__
        _queries[f.__name__] = run
        if sql is not None:
            _sql[f.__name__] = facts.oracle(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def catalog(load: Load) -> FactCatalog:
    names = ("entrypoints", "nodes", "edges", "callgraph", "builtin_sources", "module_deps")
    made = {n: load(n) for n in names}
    return FactCatalog(next(iter(made.values())).sparkSession, made)


def stored(load: Load, names: tuple[str, ...] = ("items", "edges", "callgraph")) -> FactCatalog:
    """The catalog of a fact store: what is derived by a shuffle is written once, before many steps read it. names: in the order in which they build on each other; others are projections."""
    for name in names:
        load.made[name] = written(load(name), name)
    return catalog(load)


# Conditions that several statements share.
_SUFFIX = "lower(ltrim({f}, '/')) LIKE concat('%', lower(ltrim(c.path, '/')))"
_BODY = "SELECT DISTINCT c.change_id, e.id AS ep FROM {entrypoints} e JOIN {changes} c ON " + _SUFFIX.replace("{f}", "e.file") + " AND e.start_line <= c.last_line AND e.end_line >= c.first_line"
_SITE = "SELECT DISTINCT c.change_id, g.ep_id AS ep FROM {callgraph} g JOIN {changes} c ON " + _SUFFIX.replace("{f}", "g.call_site_file") + " AND g.call_site_line BETWEEN c.first_line AND c.last_line"
_NODES = "SELECT c.change_id, n.id, n.qid FROM {nodes} n JOIN {changes} c ON " + _SUFFIX.replace("{f}", "n.file") + " AND n.line BETWEEN c.first_line AND c.last_line"
_SOURCES = "SELECT DISTINCT c.change_id, e.id AS ep FROM {builtin_sources} b JOIN {changes} c ON " + _SUFFIX.replace("{f}", "b.file") + " AND b.line BETWEEN c.first_line AND c.last_line JOIN {entrypoints} e ON e.ep_id = b.ep_id"
_HOP = "SELECT DISTINCT n.change_id, g.ep_id AS ep FROM (" + _NODES + ") n JOIN {edges} g ON g.from_node_id = n.id OR g.to_node_id = n.id"
_DEPS = "SELECT DISTINCT c.change_id, e.id AS ep FROM {module_deps} d JOIN {changes} c ON " + _SUFFIX.replace("{f}", "d.imported_file") + " JOIN {entrypoints} e ON e.id = d.consumer_ep_id WHERE d.confidence >= 90"
_RANGES = (
    "SELECT change_id, ltrim(path, '/') AS path, first_line, last_line FROM {changes} UNION SELECT c.change_id, ltrim(c.path, '/'), g.callee_start_line, g.callee_end_line FROM {callgraph} g JOIN {changes} c ON NOT ("
    + _SUFFIX.replace("{f}", "g.call_site_file")
    + ") AND g.callee_start_line <= c.last_line AND g.callee_end_line >= c.first_line WHERE g.callee_start_line > 0 AND g.callee_qid IN (SELECT n.qid FROM {nodes} n WHERE "
    + _SUFFIX.replace("{f}", "n.file")
    + ")"
)
_CALLEE = "SELECT DISTINCT q.change_id, g.ep_id AS ep FROM {callgraph} g JOIN (SELECT DISTINCT c.change_id, n.qid FROM {nodes} n JOIN (" + _RANGES + ") c ON " + _SUFFIX.replace("{f}", "n.file") + " AND n.line BETWEEN c.first_line AND c.last_line) q ON q.qid = g.callee_qid"
_KINDS = {"entrypoint_body": _BODY, "call_site": _SITE, "callee_qid": _CALLEE, "builtin_sources": _SOURCES, "module_deps": _DEPS, "edges_one_hop": _HOP}
_EVIDENCE = " UNION ALL ".join(f"SELECT '{k}' AS evidence, change_id, ep FROM ({v}) x_{k}" for k, v in _KINDS.items())


@query(_BODY)
def s01_entrypoint_body(load):
    return impact.entrypoint_body(catalog(load), load("changes"))


@query(_SITE)
def s02_call_site(load):
    return impact.call_site(catalog(load), load("changes"))


@query(_CALLEE)
def s03_callee_qid(load):
    return impact.callee_qid(catalog(load), load("changes"))


@query(_SOURCES)
def s04_builtin_sources(load):
    return impact.builtin_sources(catalog(load), load("changes"))


@query(_HOP)
def s05_edges_one_hop(load):
    return impact.edges_one_hop(catalog(load), load("changes"))


@query(_DEPS.replace("{changes}", "{wide_changes}"))
def s06_module_deps(load):
    return impact.module_deps(catalog(load), load("wide_changes"))


@query(_RANGES)
def s08_enclosing_ranges(load):
    return impact.enclosing_ranges(catalog(load), load("changes"))


@query("SELECT evidence, count(DISTINCT ep) AS n_eps FROM (" + _EVIDENCE + ") v GROUP BY evidence")
def a04_evidence_counts(load):
    return impact.evidence_counts(impact.evidence(stored(load), load("changes"), tuple(_KINDS)))


@query("SELECT ep, CASE min(CASE WHEN evidence IN ('entrypoint_body','call_site','callee_qid','builtin_sources') THEN 0 WHEN evidence = 'edges_one_hop' THEN 1 ELSE 2 END) WHEN 0 THEN 'structural' WHEN 1 THEN 'edges_only' ELSE 'provenance_only' END AS seed FROM (" + _EVIDENCE + ") v GROUP BY ep")
def s10_seeds(load):
    return impact.seeds(impact.evidence(stored(load), load("changes"), tuple(_KINDS)))


@query(
    "SELECT e.id AS ep, e.ep_id, e.file, count(DISTINCT v.evidence) AS n_evidence, string_agg(DISTINCT concat(v.evidence, ': ', ltrim(c.path, '/'), ':', c.first_line, '-', c.last_line), '; ' ORDER BY concat(v.evidence, ': ', ltrim(c.path, '/'), ':', c.first_line, '-', c.last_line)) AS reasons FROM ("
    + _EVIDENCE
    + ") v JOIN {changes} c ON c.change_id = v.change_id JOIN {entrypoints} e ON e.id = v.ep GROUP BY e.id, e.ep_id, e.file"
)
def impact_affected(load):
    """The flagship: all evidence, reasons by entry point."""
    return impact.affected(stored(load), load("changes"), tuple(_KINDS))


@query("SELECT c.change_id, count(n.id) AS nodes FROM {changes} c LEFT JOIN (" + _NODES + ") n ON n.change_id = c.change_id GROUP BY c.change_id")
def a01_changed_node_counts(load):
    return impact.node_counts(catalog(load), load("changes"))


@query("SELECT DISTINCT file FROM {nodes} WHERE lower(file) LIKE '%m1/h2_.go'")
def p01_suffix_like(load):
    return load("nodes").where(P.suffix(F.col("file"), F.lit("M1/h2_.go"))).select("file").distinct()


@query("SELECT id, ep_id FROM {nodes} WHERE line BETWEEN 100 AND 120")
def p03_point_in_range(load):
    return load("nodes").where(P.encloses(F.lit(100), F.lit(120), F.col("line"))).select("id", "ep_id")


@query("SELECT id FROM {entrypoints} WHERE start_line <= 250 AND end_line >= 205")
def p04_interval_overlap(load):
    return load("entrypoints").where(P.overlaps(F.col("start_line"), F.col("end_line"), F.lit(205), F.lit(250))).select("id")


@query("SELECT framework, count(*) AS n FROM {entrypoints} WHERE framework IS NOT NULL AND framework <> '' GROUP BY framework")
def p06_present(load):
    return load("entrypoints").where(P.present(F.col("framework"))).groupBy("framework").agg(F.count("*").alias("n"))


@query("SELECT resolution_kind, count(*) AS n FROM {callgraph} WHERE confidence >= 70 GROUP BY resolution_kind")
def p07_confidence(load):
    return load("callgraph").where("confidence >= 70").groupBy("resolution_kind").agg(F.count("*").alias("n"))


@query("SELECT file, count(*) AS n FROM {entrypoints} WHERE lower(file) LIKE '%.go' GROUP BY file")
def p09_go_files(load):
    return load("entrypoints").where(P.is_go(F.col("file"))).groupBy("file").agg(F.count("*").alias("n"))


@query("SELECT a.id AS ep, b.id AS other FROM {entrypoints} a JOIN {entrypoints} b ON a.func_name IS NOT DISTINCT FROM b.func_name AND a.file IS NOT DISTINCT FROM b.file AND a.id < b.id")
def p10_null_safe_equal(load):
    a = load("entrypoints").select("id", "func_name", "file")
    b = a.toDF("other", "f2", "p2")
    return a.join(b, F.col("func_name").eqNullSafe(F.col("f2")) & F.col("file").eqNullSafe(F.col("p2")) & (F.col("id") < F.col("other"))).select(F.col("id").alias("ep"), "other")


@query("SELECT e.id, coalesce(d.dep_kind, e.framework) AS framework FROM {entrypoints} e LEFT JOIN {module_deps} d ON d.consumer_ep_id = e.id")
def p11_keep_first_present(load):
    return load("entrypoints").join(load("module_deps"), load("entrypoints")["id"] == F.col("consumer_ep_id"), "left").select(load("entrypoints")["id"], F.coalesce("dep_kind", "framework").alias("framework"))


@query("SELECT a.id AS node, b.id AS other FROM {nodes} a JOIN {nodes} b ON a.file = b.file AND a.line = b.line AND a.id < b.id AND abs(a.col - b.col) <= 1")
def p15_location_match(load):
    a = load("nodes").select(F.col("id").alias("node"), "file", "line", "col")
    b = load("nodes").select(F.col("id").alias("other"), "file", "line", F.col("col").alias("c2"))
    return a.join(b, ["file", "line"]).where((F.col("node") < F.col("other")) & (F.abs(F.col("col") - F.col("c2")) <= 1)).select("node", "other")


@query("SELECT n_name, (length(trim(n_name)) < 3 OR lower(trim(n_name)) IN ('get','set','init','config','handler','main') OR left(trim(n_name), 1) = '_' OR right(trim(n_name), 1) = '_' OR trim(n_name) = '...') AS weak FROM {nation}")
def p16_weak_class_names(load):
    return load("nation").select("n_name", P.weak_class_name(F.col("n_name")).alias("weak"))


@query("SELECT b.id, e.id AS ep, b.line FROM {builtin_sources} b JOIN {entrypoints} e ON e.ep_id = b.ep_id")
def j01_inner(load):
    return load("builtin_sources").select(F.col("id").alias("i"), "ep_id", "line").join(load("entrypoints").select(F.col("id").alias("ep"), "ep_id"), "ep_id").select(F.col("i").alias("id"), "ep", "line")


@query("SELECT n.id, n.qid FROM {nodes} n WHERE n.qid IN (SELECT callee_qid FROM {callgraph} WHERE confidence >= 95)")
def j06_semi(load):
    return load("nodes").join(load("callgraph").where("confidence >= 95").select(F.col("callee_qid").alias("qid")), "qid", "left_semi").select("id", "qid")


@query("SELECT e.id FROM {entrypoints} e WHERE NOT EXISTS (SELECT 1 FROM {callgraph} g WHERE g.ep_id = e.id)")
def j10_anti(load):
    return load("entrypoints").join(load("callgraph").select(F.col("ep_id").alias("id")), "id", "left_anti").select("id")


@query(
    "SELECT seed, row_id, distance FROM (SELECT *, rank() OVER (PARTITION BY seed ORDER BY level, distance) AS r FROM (SELECT c.change_id AS seed, e.id AS row_id, CASE WHEN e.start_line <= c.last_line AND e.end_line >= c.first_line THEN 0 WHEN e.start_line BETWEEN c.last_line AND c.last_line + 10 THEN 1 ELSE 2 END AS level, CASE WHEN e.start_line <= c.last_line AND e.end_line >= c.first_line THEN 0 WHEN e.start_line BETWEEN c.last_line AND c.last_line + 10 THEN e.start_line - c.last_line ELSE least(abs(e.start_line - c.last_line), abs(c.first_line - e.end_line)) END AS distance FROM {changes} c JOIN {entrypoints} e ON concat('src/', ltrim(replace(c.path, 'src/', ''), '/')) = e.file) x) y WHERE r = 1"
)
def j11_nearest(load):
    seeds = load("changes").select(F.col("change_id").alias("seed"), F.concat(F.lit("src/"), P.trimmed(F.replace("path", F.lit("src/"), F.lit("")))).alias("file"), F.col("first_line").alias("first"), F.col("last_line").alias("last"))
    rows = load("entrypoints").select(F.col("id").alias("row"), "file", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    return impact.nearest_rows(seeds, rows).withColumnRenamed("row", "row_id")


@query("SELECT a.file AS ep, count(*) AS n FROM (SELECT DISTINCT file FROM {entrypoints}) a JOIN (SELECT DISTINCT imported_file AS file FROM {module_deps}) b ON substr(a.file, 1, length(a.file) - length(replace(a.file, '/', ''))) = substr(b.file, 1, length(b.file) - length(replace(b.file, '/', ''))) AND a.file <> b.file AND right(a.file, 6) = right(b.file, 6) GROUP BY a.file")
def j12_same_directory(load):
    """How many neighbours a file has by the fact store's directory expression, among files with the same end."""
    tail = lambda c: F.right(c, F.lit(6))
    a = load("entrypoints").select(F.col("file").alias("ep")).distinct().withColumn("t", tail("ep"))
    b = load("module_deps").select(F.col("imported_file").alias("other")).distinct().withColumn("t", tail("other"))
    return a.join(b, "t").where((F.col("ep") != F.col("other")) & P.same_directory_quirk(F.col("ep"), F.col("other"))).groupBy("ep").agg(F.count("*").alias("n"))


@query("SELECT g.id, n.line, e.file FROM {callgraph} g JOIN {nodes} n ON n.id = g.id JOIN {entrypoints} e ON e.id = g.ep_id WHERE g.caller_func <> e.func_name OR e.start_line <= 101")
def j14_three_tables(load):
    g, n = load("callgraph").select("id", "ep_id", "caller_func"), load("nodes").select("id", "line")
    e = load("entrypoints").select(F.col("id").alias("ep_id"), "file", "func_name", "start_line")
    return g.join(n, "id").join(e, "ep_id").where("caller_func <> func_name or start_line <= 101").select("id", "line", "file")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' ELSE 'same' END AS status FROM (SELECT DISTINCT file AS k FROM {entrypoints}) a FULL OUTER JOIN (SELECT DISTINCT imported_file AS k FROM {module_deps}) b ON a.k = b.k")
def j16_full_outer(load):
    a, b = load("entrypoints").select(F.col("file").alias("a")).distinct(), load("module_deps").select(F.col("imported_file").alias("b")).distinct()
    j = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return j.select(F.coalesce("a", "b").alias("k"), F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").otherwise("same").alias("status"))


@query("SELECT DISTINCT edge_type, ep_id % 10 AS bucket FROM {edges}")
def a02_distinct(load):
    return load("edges").select("edge_type", (F.col("ep_id") % 10).alias("bucket")).distinct()


@query("SELECT super, string_agg(DISTINCT sub, ',' ORDER BY sub) AS subs FROM {class_edges} GROUP BY super")
def a05_subclass_lists(load):
    return load("class_edges").groupBy("super").agg(F.array_join(F.array_sort(F.collect_set("sub")), ",").alias("subs"))


@query("SELECT resolution_kind, quantile_disc(confidence, 0.5) AS p50, quantile_disc(confidence, 0.95) AS p95 FROM {callgraph} GROUP BY resolution_kind")
def a08_percentiles(load):
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY confidence)").cast("int")
    return load("callgraph").groupBy("resolution_kind").agg(q(0.5).alias("p50"), q(0.95).alias("p95"))


@query("SELECT framework, count(*) AS n, min(start_line) AS first_line, max(end_line) AS last_line, count(DISTINCT file) AS files FROM {entrypoints} GROUP BY framework")
def a10_metrics(load):
    return load("entrypoints").groupBy("framework").agg(F.count("*").alias("n"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.countDistinct("file").alias("files"))


@query("SELECT callee_qid, count(*) AS calls, count(DISTINCT caller_func) AS callers FROM {callgraph} GROUP BY callee_qid HAVING count(*) > 1")
def a12_incoming(load):
    calls = spread(load("callgraph").select("callee_qid", "caller_func"), load("lineitem").count(), "callee_qid", "caller_func")
    return calls.groupBy("callee_qid").agg(F.count("*").alias("calls"), F.countDistinct("caller_func").alias("callers")).where("calls > 1")


@query("SELECT sum(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN toxic = 0 AND quality = 0 THEN 1 ELSE 0 END)::BIGINT AS tn, sum(CASE WHEN toxic = 0 AND quality = 1 THEN 1 ELSE 0 END)::BIGINT AS fn FROM {labels}")
def agg_label_pairs(load):
    n = lambda t, q: F.sum(((F.col("toxic") == t) & (F.col("quality") == q)).cast("int")).cast("decimal(38,0)")
    return load("labels").agg(n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 0).alias("tn"), n(0, 1).alias("fn")).select(*(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")))


_KEPT = "SELECT finding, pos, tag, file, line FROM (SELECT *, lag(concat(file, '|', line, '|', tag)) OVER (PARTITION BY finding ORDER BY pos) AS b FROM {steps}) x WHERE b IS NULL OR b <> concat(file, '|', line, '|', tag)"


@query(_KEPT)
def w01_adjacent_repeats(load):
    return trace.drop_adjacent_repeats(load("steps")).select("finding", "pos", "tag", "file", "line")


@query("SELECT finding, pos, tag FROM (SELECT *, sum(CASE WHEN tag = 'SOURCE: ' THEN 1 ELSE 0 END) OVER (PARTITION BY finding ORDER BY pos) AS n FROM {steps}) x WHERE tag <> 'SOURCE: ' OR n = 1")
def w02_first_source(load):
    return trace.first_source_only(load("steps")).select("finding", "pos", "tag")


_BOUND = "SELECT finding, pos, tag, file, line FROM (SELECT *, min(CASE WHEN tag = 'SINK: ' AND pos > s THEN pos END) OVER (PARTITION BY finding) AS e FROM (SELECT *, min(CASE WHEN tag = 'SOURCE: ' THEN pos END) OVER (PARTITION BY finding) AS s FROM {steps}) x) y WHERE s IS NULL OR (pos >= s AND (e IS NULL OR pos <= e))"


@query(_BOUND)
def w03_source_to_sink(load):
    return trace.bounded(load("steps")).select("finding", "pos", "tag", "file", "line")


@query("SELECT finding, count(*) >= 2 AND min_by(tag, pos) = 'SOURCE: ' AND max_by(tag, pos) = 'SINK: ' AND sum(CASE WHEN tag IN ('SOURCE: ', 'SINK: ') THEN 1 ELSE 0 END) = 2 AS valid FROM (" + _BOUND + ") b GROUP BY finding")
def w04_valid_boundary(load):
    return trace.valid_findings(trace.bounded(load("steps")))


_IN_FRAME = "SELECT t.finding, t.pos, t.tag, coalesce(max(k.idx), -1) AS frame FROM {traces} t LEFT JOIN {stacks} k ON k.finding = t.finding AND k.file = t.file AND t.line BETWEEN k.start_line AND k.end_line GROUP BY t.finding, t.pos, t.tag"


@query(
    "WITH RECURSIVE f AS ("
    + _IN_FRAME
    + "), nx AS (SELECT a.finding, a.pos, min_by(b.tag, b.pos) AS ntag, min_by(b.frame, b.pos) AS nframe FROM f a JOIN f b ON b.finding = a.finding AND b.pos > a.pos AND b.tag <> 'SOURCE: ' GROUP BY a.finding, a.pos), "
    "x AS (SELECT f.*, CASE WHEN ntag IN ('ARG PASS: ', 'SINK: ') THEN NULL ELSE nframe END AS back FROM f LEFT JOIN nx USING (finding, pos)), "
    "w AS (SELECT DISTINCT finding, 0 AS pos, -1 AS cur, -1 AS pend, true AS ok FROM f UNION ALL SELECT x.finding, x.pos, "
    "CASE WHEN x.tag = 'ARG PASS: ' THEN x.frame WHEN cur < 0 OR x.tag IN ('SOURCE: ', 'SINK: ', 'CALL: ') OR x.frame = cur THEN cur WHEN x.frame > cur AND (pend = cur OR pend = x.frame) THEN x.frame "
    "WHEN x.tag = 'Return Value: ' AND coalesce(x.back = cur, false) THEN cur WHEN x.frame BETWEEN 0 AND cur - 1 AND (x.tag = 'CALL RETURN:' OR pend < 0) THEN x.frame ELSE cur END, "
    "CASE WHEN x.tag = 'ARG PASS: ' THEN -1 WHEN cur < 0 OR x.tag IN ('SOURCE: ', 'SINK: ') THEN pend WHEN x.tag = 'CALL: ' THEN x.frame WHEN x.frame = cur OR x.frame > cur AND (pend = cur OR pend = x.frame) THEN -1 "
    "WHEN x.tag = 'Return Value: ' AND coalesce(x.back = cur, false) THEN pend WHEN x.tag = 'CALL RETURN:' AND x.frame BETWEEN 0 AND cur - 1 THEN -1 ELSE pend END, "
    "ok AND (cur < 0 OR x.tag IN ('ARG PASS: ', 'SOURCE: ', 'SINK: ', 'CALL: ') OR x.frame = cur OR x.frame > cur AND (pend = cur OR pend = x.frame) OR x.tag = 'Return Value: ' AND coalesce(x.back = cur, false) OR x.frame BETWEEN 0 AND cur - 1 AND (x.tag = 'CALL RETURN:' OR pend < 0)) "
    "FROM w JOIN x ON x.finding = w.finding AND x.pos = w.pos + 1) SELECT finding, bool_and(ok) AS valid FROM w GROUP BY finding"
)
def w05_segments_in_frame(load):
    return trace.segments_in_frame(trace.frames(load("traces"), load("stacks")))


_SUMMARY = "SELECT finding, count(*) AS n, concat(min_by(tag, pos), min_by(concat(file, ':', line), pos)) AS source, concat(max_by(tag, pos), max_by(concat(file, ':', line), pos)) AS sink FROM (" + _BOUND + ") b GROUP BY finding"


@query("SELECT source, sink, min(n) AS n, arg_min(finding, struct_pack(n := n, f := finding)) AS finding FROM (" + _SUMMARY + ") s GROUP BY source, sink")
def a06_shortest_trace(load):
    return trace.shortest_per_flow(trace.bounded(load("steps"))).select("source", "sink", "finding", "n")


_SHORT = _BOUND.replace("{steps}", "{traces}")
_MID = "SELECT s.*, coalesce(m.places, []) AS places FROM (" + _SUMMARY.replace("{steps}", "{traces}") + ") s LEFT JOIN (SELECT finding, list(DISTINCT concat(file, ':', line)) AS places FROM (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY pos) AS r, count(*) OVER (PARTITION BY finding) AS c FROM (" + _SHORT + ") b) z WHERE r > 1 AND r < c GROUP BY finding) m ON m.finding = s.finding"


@query("SELECT DISTINCT a.finding FROM (" + _MID + ") a JOIN (" + _MID + ") b ON a.source = b.source AND a.sink = b.sink AND a.n < b.n WHERE a.source LIKE 'SOURCE: %' AND a.sink LIKE 'SINK: %' AND (a.n = 2 OR len(list_filter(a.places, lambda x: NOT list_contains(b.places, x))) = 0)")
def w10_degenerate(load):
    return trace.degenerate(trace.bounded(load("traces")))


@query("SELECT file, min(line) AS first_line, max(line) AS last_line FROM (SELECT *, line - row_number() OVER (PARTITION BY file ORDER BY line) AS g FROM (SELECT DISTINCT file, line FROM {nodes}) d) x GROUP BY file, g")
def w12_islands(load):
    lines = load("nodes").select("file", "line").distinct()
    w = Window.partitionBy("file").orderBy("line")
    b = F.when(F.lag("line").over(w) + 1 >= F.col("line"), 0).otherwise(1)
    isl = lines.withColumn("b", b).withColumn("g", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return isl.groupBy("file", "g").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line")).drop("g")


@query("SELECT ep_id, id AS last_call, callee_qid FROM (SELECT *, row_number() OVER (PARTITION BY ep_id ORDER BY id DESC) AS r FROM {callgraph}) x WHERE r = 1")
def w13_latest_per_key(load):
    return incremental.latest_per_key(load("callgraph").select("ep_id", F.col("id").alias("last_call"), "callee_qid"), "ep_id", "last_call")


@query("SELECT qid FROM {nodes} GROUP BY qid HAVING count(DISTINCT file) <= 8")
def l04_fan_out_cap(load):
    return taint.implementers_within(load("nodes").select(F.col("qid").alias("interface"), F.col("file").alias("impl"))).select(F.col("interface").alias("qid")).distinct()


@query("SELECT file_path, substr(content, 1, 200) AS line FROM {source_files}")
def l05_line_truncation(load):
    return load("source_files").select("file_path", F.substring("content", 1, 200).alias("line"))


@query("SELECT file FROM {entrypoints} UNION SELECT call_site_file FROM {callgraph} UNION SELECT file FROM {builtin_sources}")
def s14_union_distinct(load):
    a, b, c = load("entrypoints").select("file"), load("callgraph").select(F.col("call_site_file").alias("file")), load("builtin_sources").select("file")
    return a.union(b).union(c).distinct()


@query("SELECT file, string_agg(DISTINCT framework, '+' ORDER BY framework) AS reasons FROM {entrypoints} GROUP BY file")
def s15_merge_reasons(load):
    return impact.merge_by_key(load("entrypoints"), "file", "framework")


@query("SELECT file FROM {entrypoints} INTERSECT SELECT imported_file FROM {module_deps}")
def s20_intersect(load):
    return load("entrypoints").select("file").intersect(load("module_deps").select(F.col("imported_file").alias("file")))


@query("SELECT file FROM {entrypoints} EXCEPT SELECT imported_file FROM {module_deps}")
def s20_except(load):
    return load("entrypoints").select("file").subtract(load("module_deps").select(F.col("imported_file").alias("file")))


@query("WITH RECURSIVE c AS (SELECT super, sub FROM {class_edges} UNION SELECT c.super, e.sub FROM c JOIN {class_edges} e ON e.super = c.sub) SELECT super, sub FROM c")
def g06_subclass_closure(load):
    return graph.subclasses(load("class_edges")).select("super", "sub")


@query("WITH RECURSIVE e AS (SELECT c_custkey AS src, (c_custkey * 7 + 3) % 97 AS dst FROM {customer}), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst) SELECT src, dst FROM c")
def g06_cyclic_closure(load):
    return graph.closure(load("customer").select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * 7 + 3) % 97).alias("dst"))).select("src", "dst")


@query("WITH RECURSIVE p AS (SELECT super AS top, sub FROM {class_edges} WHERE super LIKE 'R%' UNION ALL SELECT p.top, e.sub FROM p JOIN {class_edges} e ON e.super = p.sub) SELECT top AS super, sub, count(*) AS n_paths FROM p GROUP BY top, sub")
def g07_subtype_paths(load):
    start = load("class_edges").where("super like 'R%'").select("super").distinct()
    return graph.subtype_paths(load("class_edges"), start, 3)


@query("SELECT super, sub FROM {class_edges} WHERE super = 'N3'")
def g05_direct_subclasses(load):
    return graph.direct(load("class_edges"), "N3", up=False).select(F.lit("N3").alias("super"), F.col("name").alias("sub"))


@query("SELECT id, file FROM {entrypoints} e WHERE NOT EXISTS (SELECT 1 FROM {callgraph} g WHERE g.call_site_file = e.file AND g.callee_start_line = e.start_line AND g.callee_end_line = e.end_line + 11)")
def g11_roots(load):
    nodes = load("entrypoints").select("id", "file", "start_line", (F.col("end_line") + 11).alias("end_line"))
    calls = load("callgraph").select(F.col("caller_func").alias("caller"), F.col("call_site_file").alias("file"), F.col("callee_start_line").alias("start_line"), F.col("callee_end_line").alias("end_line"))
    return graph.roots(nodes, calls).select("id", "file")


@query("WITH RECURSIVE b AS (SELECT sub AS node, sub AS target FROM {class_edges} WHERE sub LIKE 'C%' OR sub LIKE 'S%' UNION SELECT e.super, b.target FROM b JOIN {class_edges} e ON e.sub = b.node) SELECT target, node AS root FROM b WHERE node NOT IN (SELECT sub FROM {class_edges})")
def g12_reverse_roots(load):
    e = load("class_edges").select(F.col("super").alias("src"), F.col("sub").alias("dst"))
    return graph.reverse_roots(e, load("class_edges").where("sub like 'C%' or sub like 'S%'").select(F.col("sub").alias("node")))


@query("SELECT 'disgusting' AS keyword, file_path FROM {source_files} WHERE contains(content, 'disgusting') UNION ALL SELECT '@', file_path FROM {source_files} WHERE contains(content, '@')")
def g15_keyword_files(load):
    return graph.keyword_files(load("source_files"), ["disgusting", "@"])


@query("SELECT caller_func AS src, callee_qid AS dst, concat('loc:', call_site_file, ':', call_site_line, ':', 0) AS site, max(id) AS seq FROM {callgraph} GROUP BY 1, 2, 3")
def g02_call_edges(load):
    calls = load("callgraph").select(F.col("id").alias("seq"), F.col("caller_func").alias("src"), F.col("callee_qid").alias("dst"), F.col("call_site_file").alias("file"), F.col("call_site_line").alias("line"), F.lit(0).alias("col"), F.lit(None).cast("string").alias("node_hash"))
    return graph.call_edges(calls).select("src", "dst", "site", "seq")


@query("WITH RECURSIVE t AS (SELECT ep_id, min(id) AS node FROM {nodes} GROUP BY ep_id UNION SELECT t.ep_id, e.to_node_id FROM t JOIN {edges} e ON e.ep_id = t.ep_id AND e.from_node_id = t.node AND e.edge_type <> 'return') SELECT ep_id, node FROM t")
def g19_labelled_flow(load):
    seeds = load("nodes").groupBy("ep_id").agg(F.min("id").alias("node")).withColumn("tag", F.lit("FIRST"))
    return taint.propagate(load("edges").where("edge_type <> 'return'"), seeds).select("ep_id", "node")


_TYPED = "SELECT from_node_id, CASE WHEN from_node_id % 13 = 0 THEN from_node_id ELSE to_node_id END AS to_node_id, CASE WHEN from_node_id % 5 < 2 THEN 'merge' ELSE edge_type END AS edge_type, ep_id FROM {edges}"


@query("SELECT DISTINCT from_node_id, to_node_id, edge_type, ep_id FROM (" + _TYPED + ") e WHERE from_node_id <> to_node_id AND (edge_type <> 'merge' OR from_node_id IN (SELECT id FROM {nodes} WHERE line < 250))")
def t_edge_dedup(load):
    edges = load("edges").withColumn("to_node_id", F.when(F.col("from_node_id") % 13 == 0, F.col("from_node_id")).otherwise(F.col("to_node_id"))).withColumn("edge_type", F.when(F.col("from_node_id") % 5 < 2, "merge").otherwise(F.col("edge_type")))
    return taint.recorded_edges(edges, load("nodes").where("line < 250").select(F.col("id").alias("node")))


_RULES = "(VALUES ('sig', 0, 'p33', '', 'D'), ('svc', 1, '', '.p7', 'A'), ('two', 2, '', '.p17', 'B'), ('full', 3, 'svc.s1.p1', '', 'E'), ('any', 4, '', 's1.p', 'C')) AS r(rule_id, rule_order, fsig, part, kind)"


@query("SELECT id AS call_id, rule_id, kind FROM (SELECT g.id, r.*, row_number() OVER (PARTITION BY g.id ORDER BY r.rule_order) AS n FROM {callgraph} g JOIN " + _RULES + " ON (r.part <> '' AND contains(g.callee_qid, r.part)) OR (r.fsig <> '' AND (g.callee_qid = r.fsig OR ends_with(g.callee_qid, concat('.', r.fsig))))) x WHERE n = 1")
def t19_rule_match(load):
    spark = load("callgraph").sparkSession
    rules = spark.createDataFrame([("sig", 0, "p33", None, None, None, "D"), ("svc", 1, None, r"\.p7", None, None, "A"), ("two", 2, None, r"\.p17", None, None, "B"), ("full", 3, "svc.s1.p1", None, None, None, "E"), ("any", 4, None, r"s1\.p", None, None, "C")], "rule_id string, rule_order int, fsig string, fregex string, callee_type string, arg_num int, kind string")
    calls = load("callgraph").select(F.col("id").alias("call_id"), F.col("callee_qid").alias("callee"), F.col("resolution_kind").alias("callee_type"), F.lit(1).alias("n_args"))
    return taint.match_calls(calls, rules).select("call_id", "rule_id", "kind")


@query("SELECT qid, qid LIKE 'svc.%.p7' AND qid NOT LIKE '%.%.%.%' AS one, qid LIKE 'svc.%' AS rest FROM (SELECT DISTINCT qid FROM {nodes}) n")
def r02_dotted_patterns(load):
    q = F.col("qid")
    return load("nodes").select("qid").distinct().select("qid", patterns.dotted(q, "svc.*.p7").alias("one"), patterns.dotted(q, "svc.**").alias("rest"))


_MARKED = "SELECT DISTINCT concat('/src/', qid, '.f_scope.<block_', line % 3, '>.<instance_', col, '_endtag>', CASE line % 3 WHEN 0 THEN '(a(b))' WHEN 1 THEN '<copied_x_endtag>' ELSE '<cloned1_endtag>' END, '.g') AS qid FROM {nodes} WHERE line < 60"


@query("SELECT qid, regexp_replace(regexp_replace(replace(replace(substr(qid, 2), '/', '.'), '(a(b))', ''), '\\.<block_[0-9]>', '', 'g'), '<(instance_|copied|cloned)[^.]*?_endtag>', '', 'g') AS unified FROM (" + _MARKED + ") m")
def r10_unified_qids(load):
    line, mark = F.col("line"), F.lit
    tail = F.when(line % 3 == 0, "(a(b))").when(line % 3 == 1, "<copied_x_endtag>").otherwise("<cloned1_endtag>")
    marked = load("nodes").where("line < 60").select(F.concat(mark("/src/"), "qid", mark(".f_scope.<block_"), line % 3, mark(">.<instance_"), "col", mark("_endtag>"), tail, mark(".g")).alias("qid")).distinct()
    return marked.select("qid", patterns.unified_qid(F.col("qid")).alias("unified"))


@query("SELECT lower(qid) AS a, replace(qid, '.', '/') AS b, length(qid) AS n, strpos(qid, '.p') AS at, sha256(qid) AS digest FROM (SELECT DISTINCT qid FROM {nodes}) n")
def f_scalars(load):
    return load("nodes").select("qid").distinct().select(F.lower("qid").alias("a"), F.replace("qid", F.lit("."), F.lit("/")).alias("b"), F.length("qid").cast("long").alias("n"), F.instr("qid", ".p").cast("long").alias("at"), F.sha2("qid", 256).alias("digest"))


@query("SELECT DISTINCT file, regexp_extract(file, '[^/]*$') AS base, regexp_replace(file, '/?[^/]*$', '') AS dir, substr(file, 5) AS rel FROM {entrypoints}")
def f_paths(load):
    f = F.col("file")
    return load("entrypoints").select("file").distinct().select("file", P.basename(f).alias("base"), P.dirname(f).alias("dir"), P.relative(f, "src").alias("rel"))



_KEYED = "SELECT DISTINCT concat_ws('|', file, func_name, ep_type, s, end_line, attribute) AS key, file, func_name, ep_type, attribute, s FROM (SELECT *, {line} AS s FROM {entrypoints} WHERE framework <> '{gone}') e"
_BASE = _KEYED.replace("{line}", "start_line").replace("{gone}", "1-URGENT")
_HEAD = _KEYED.replace("{line}", "CASE WHEN ep_type = 'P' THEN start_line + 2 ELSE start_line END").replace("{gone}", "5-LOW")
_LOOSE = "SELECT *, row_number() OVER (PARTITION BY file, func_name, ep_type, attribute ORDER BY s, key) AS nth FROM ({side}) k WHERE key NOT IN (SELECT key FROM ({other}) o)"


@query(
    "SELECT 'same' AS status, b.key AS base_key, h.key AS head_key FROM (" + _BASE + ") b JOIN (" + _HEAD + ") h ON b.key = h.key UNION ALL SELECT CASE WHEN b.key IS NULL THEN 'added' WHEN h.key IS NULL THEN 'deleted' ELSE 'moved' END, b.key, h.key FROM ("
    + _LOOSE.replace("{side}", _BASE).replace("{other}", _HEAD) + ") b FULL OUTER JOIN (" + _LOOSE.replace("{side}", _HEAD).replace("{other}", _BASE) + ") h ON b.nth = h.nth AND b.file = h.file AND b.func_name = h.func_name AND b.ep_type = h.ep_type AND b.attribute = h.attribute"
)
def x06_compare_entrypoints(load):
    """Base without the urgent entry points against a head without the low ones; lines of one type are moved."""
    e = load("entrypoints")
    base = e.where("framework <> '1-URGENT'")
    head = e.where("framework <> '5-LOW'").withColumn("start_line", F.when(F.col("ep_type") == "P", F.col("start_line") + 2).otherwise(F.col("start_line")))
    return incremental.compare_entrypoints(base, head)


_FIND = "SELECT l_orderkey * 8 + l_linenumber AS i, concat('rule', min(l_suppkey) % 9) AS rule_id, concat('ep', l_orderkey % 5000) AS k FROM {lineitem} GROUP BY l_orderkey, l_linenumber"
_CHG = "SELECT concat('ep', o_orderkey % 5000) AS k, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS gone FROM {orders} WHERE o_totalprice > 400000 GROUP BY 1"


@query("SELECT sum(CASE WHEN c.gone IS NULL THEN 1 ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN c.gone = 0 THEN 1 ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN c.gone = 1 THEN 1 ELSE 0 END)::BIGINT AS resolved, (SELECT count(*) FROM {events}) AS new FROM (" + _FIND + ") f LEFT JOIN (" + _CHG + ") c ON c.k = f.k")
def x10_merge_counts(load):
    base = load("items").select(F.concat(F.lit("rule"), F.col("sk") % 9).alias("rule_id"), F.concat(F.lit("ep"), F.col("ok") % 5000).alias("entrypoint_key"), (F.col("ok") * 8 + F.col("ln")).alias("result_index"))
    changes = load("orders").where("o_totalprice > 400000").select(F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("modified").alias("status"), F.concat(F.lit("ep"), F.col("o_orderkey") % 5000).alias("ep_key"))
    return incremental.merge_counts(base, load("events"), changes)


_RC = "(VALUES ('src/m1/h2.go', 10, 20, 10, 14), ('src/m1/h2.go', 60, 59, 55, 64), ('src/m1/h3.go', 5, 8, 5, 30)) AS c(file, old_start, old_end, new_start, new_end)"


@query("SELECT n.id AS finding, n.line, CAST(coalesce(min_by(CASE WHEN c.old_end >= c.old_start AND n.line BETWEEN c.old_start AND c.old_end THEN c.new_start + least(n.line - c.old_start, greatest(c.new_end - c.new_start, 0)) END, CASE WHEN c.old_end >= c.old_start AND n.line BETWEEN c.old_start AND c.old_end THEN c.old_start END), greatest(1, n.line + coalesce(sum(CASE WHEN n.line >= c.old_start AND NOT (c.old_end >= c.old_start AND n.line BETWEEN c.old_start AND c.old_end) THEN greatest(c.new_end - c.new_start + 1, 0) - greatest(c.old_end - c.old_start + 1, 0) END), 0))) AS INT) AS new_line FROM {nodes} n LEFT JOIN " + _RC + " ON c.file = n.file GROUP BY n.id, n.line")
def x12_line_remap(load):
    spark = load("nodes").sparkSession
    changes = spark.createDataFrame([("src/m1/h2.go", 10, 20, 10, 14), ("src/m1/h2.go", 60, 59, 55, 64), ("src/m1/h3.go", 5, 8, 5, 30)], "file string, old_start int, old_end int, new_start int, new_end int")
    return incremental.remap_lines(load("nodes").select(F.col("id").alias("finding"), "file", "line"), changes).select("finding", "line", "new_line")


@query("SELECT framework, n FROM (SELECT framework, count(*) AS n FROM {entrypoints} WHERE start_line > 100 GROUP BY framework) x ORDER BY n DESC LIMIT 3")
def q1_sql_passthrough(load):
    """Arbitrary read-only SQL through the guard, with a named parameter."""
    spark = load("entrypoints").sparkSession
    load("entrypoints").createOrReplaceTempView("tarnhelm_entrypoints")
    return sqlguard.query(spark, "SELECT framework, count(*) AS n FROM tarnhelm_entrypoints WHERE start_line > $line GROUP BY framework ORDER BY n DESC LIMIT 3", {"line": 100})


@query("SELECT ep_id, id, sum(confidence) OVER (PARTITION BY ep_id ORDER BY id)::BIGINT AS running FROM {callgraph}")
def l06_window(load):
    w = Window.partitionBy("ep_id").orderBy("id")
    return load("callgraph").select("ep_id", "id", F.sum("confidence").over(w).alias("running"))


@query("SELECT id FROM {entrypoints} ORDER BY id LIMIT 50 OFFSET 10")
def l06_limit_offset(load):
    return load("entrypoints").select("id").orderBy("id").offset(10).limit(50)


@query("SELECT framework, string_agg(DISTINCT ep_type, ',' ORDER BY ep_type) AS types, count(*) FILTER (WHERE start_line > 200) AS late FROM {entrypoints} GROUP BY framework HAVING count(*) > 10")
def a15_group_having(load):
    g = load("entrypoints").groupBy("framework").agg(F.array_join(F.array_sort(F.collect_set("ep_type")), ",").alias("types"), F.count(F.when(F.col("start_line") > 200, 1)).alias("late"), F.count("*").alias("n"))
    return g.where("n > 10").drop("n")


@query("SELECT file_path, len(string_split(content, chr(10))) AS lines FROM {source_files}")
def f_line_counts(load):
    return load("source_files").select("file_path", F.size(F.split("content", "\n")).cast("long").alias("lines"))


@query("SELECT concat(coalesce(caller_func, ''), '|', callee_qid, '|1|', resolution_kind, '|', CASE WHEN confidence >= 90 THEN '1' ELSE '0' END) AS key, count(*) AS n, min(id) AS first_call FROM {callgraph} GROUP BY 1")
def y06_call_summaries(load):
    calls = load("callgraph").select(F.col("id").alias("call"), F.col("caller_func").alias("caller"), F.col("callee_qid").alias("callee"), F.array("resolution_kind").alias("arg_types"), F.array(F.col("confidence") >= 90).alias("tainted"))
    return types.distinct_summaries(calls)


@query("SELECT ep_id AS call, 0 AS idx, CASE WHEN count(DISTINCT resolution_kind) = 1 THEN min(resolution_kind) ELSE '' END AS type FROM {callgraph} GROUP BY ep_id")
def y02_argument_types(load):
    return types.argument_types(load("callgraph").select(F.col("ep_id").alias("call"), F.lit(0).alias("idx"), F.col("resolution_kind").alias("type")))


@query("SELECT c_custkey AS call, concat('N', c_nationkey) AS owner, 'run' AS method, 1 AS pos, true AS resolved FROM {customer} UNION ALL SELECT c_custkey, concat('C', c2), 'run', 0, true FROM (SELECT a.c_custkey, b.c_custkey AS c2 FROM {customer} a JOIN {customer} b ON a.c_nationkey = b.c_nationkey AND b.c_acctbal > 9800) x")
def y04_overloads(load):
    """Every nation has run(x), run(int); its richest customers, its subtypes, run(int) only: a call with an int takes the matching one of each."""
    methods = load("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("owner"), F.lit("run").alias("method"), F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("x").alias("t")), F.struct(F.lit(1).alias("pos"), F.lit("int").alias("t")))).alias("m")).select("owner", "method", "m.pos", F.array("m.t").alias("param_types"), F.lit(False).alias("varargs"))
    own = load("customer").where("c_acctbal > 9800").select(F.concat(F.lit("C"), "c_custkey").alias("owner"), F.lit("run").alias("method"), F.lit(0).alias("pos"), F.array(F.lit("lang.int")).alias("param_types"), F.lit(False).alias("varargs"))
    calls = load("customer").select(F.col("c_custkey").alias("call"), F.concat(F.lit("N"), "c_nationkey").alias("owner"), F.lit("run").alias("method"), F.array(F.lit("int")).alias("arg_types"), F.lit(False).alias("via_super"))
    subs = load("class_edges").where("super like 'N%'").select("super", "sub")
    return types.resolve(calls, methods.unionByName(own), subs)


@query("SELECT user_id AS finding, string_agg(DISTINCT concat('f', event_id % 7, '.py:', event_id % 100), ',' ORDER BY concat('f', event_id % 7, '.py:', event_id % 100)) AS flows FROM {events} WHERE event_type = 'purchase' GROUP BY user_id")
def a07_merged_flows(load):
    r = load("events").where("event_type = 'purchase'").select(F.col("user_id").alias("sink"), F.lit("e").alias("entrypoint"), F.concat(F.lit("f"), F.col("event_id") % 7, F.lit(".py:"), F.col("event_id") % 100).alias("flow"))
    return taint.merge_flows(r).select(F.col("sink").alias("finding"), F.array_join("flows", ",").alias("flows"))


@query("SELECT framework, avg(end_line) AS mean_line, sum(start_line)::BIGINT AS total FROM {entrypoints} GROUP BY framework ORDER BY total DESC LIMIT 3")
def a09_top_totals(load):
    return load("entrypoints").groupBy("framework").agg(F.avg("end_line").alias("mean_line"), F.sum("start_line").alias("total")).orderBy(F.desc("total")).limit(3)


@query("SELECT edge_type, count(*) AS n FROM {edges} WHERE from_node_id IN (SELECT id FROM {nodes} WHERE line BETWEEN 100 AND 200) GROUP BY edge_type")
def agg_semi_join(load):
    hit = load("nodes").where("line between 100 and 200").select(F.col("id").alias("from_node_id"))
    return load("edges").join(hit, "from_node_id", "left_semi").groupBy("edge_type").agg(F.count("*").alias("n"))


@query("SELECT key, value FROM (SELECT concat('k', o_custkey) AS key, o_orderpriority AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM {orders}) x WHERE r = 1")
def src18_metadata_upsert(load):
    rows = load("orders").select(F.concat(F.lit("k"), "o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    return incremental.latest_per_key(rows, "key", "seq").select("key", "value")


@query("SELECT file, min(id) AS id FROM {entrypoints} WHERE attribute IS NOT NULL GROUP BY file, attribute UNION ALL SELECT file, id FROM {entrypoints} WHERE attribute IS NULL")
def p_insert_or_ignore(load):
    return incremental.insert_or_ignore(load("entrypoints").select("file", "attribute", "id"), ["file", "attribute"], "id").select("file", "id")


@query("SELECT e.id, c.change_id FROM {entrypoints} e JOIN {changes} c ON (e.start_line <= c.last_line AND e.end_line >= c.first_line) OR (e.start_line <= c.last_line - 200 AND e.end_line >= c.first_line - 200) WHERE e.file = concat('src/m', c.change_id, '/h', c.change_id, '.go')")
def x15_touched(load):
    c = load("changes").withColumn("file", F.concat(F.lit("src/m"), "change_id", F.lit("/h"), "change_id", F.lit(".go")))
    t = incremental.touches(F.col("start_line"), F.col("end_line"), F.col("first_line"), F.col("last_line"), F.col("first_line") - 200, F.col("last_line") - 200)
    return load("entrypoints").join(c, "file").where(t).select("id", "change_id")


@query("SELECT ep_id, list_sort(list_distinct(flatten(list([from_node_id, to_node_id]))))::VARCHAR AS nodes FROM {edges} GROUP BY ep_id")
def s16_value_union(load):
    g = load("edges").groupBy("ep_id").agg(F.array_sort(taint.union_values(F.collect_list("from_node_id"), F.collect_list("to_node_id"))).alias("v"))
    return g.select("ep_id", F.concat(F.lit("["), F.array_join("v", ", "), F.lit("]")).alias("nodes"))


@query("SELECT url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(url, '^[a-z]+://[^/]+', '') AS rest FROM {pages}")
def f_regex(load):
    return load("pages").select("url", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_replace("url", "^[a-z]+://[^/]+", "").alias("rest"))


@query("SELECT conv_id AS stack, count(*) AS frames, max_by(role, turn) AS last_role FROM {conversations} GROUP BY conv_id")
def agg_conversations(load):
    return load("conversations").groupBy(F.col("conv_id").alias("stack")).agg(F.count("*").alias("frames"), F.max_by("role", "turn").alias("last_role"))


_ONE = "(SELECT * FROM {changes} WHERE change_id = 6)"
_ONE_KINDS = {k: v.replace("{changes}", _ONE) for k, v in _KINDS.items()}


@query("WITH v AS (" + " UNION ALL ".join(f"SELECT '{k}' AS evidence, ep FROM ({v}) x_{k}" for k, v in _ONE_KINDS.items()) + ") SELECT DISTINCT ep FROM v WHERE (SELECT count(DISTINCT ep) FROM v WHERE evidence = 'entrypoint_body') <> 1 OR ep IN (SELECT ep FROM v WHERE evidence = 'entrypoint_body')")
def s13_single_change(load):
    return impact.affected(stored(load), load("changes").where("change_id = 6"), tuple(_KINDS)).select("ep")


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN confidence < 60 THEN 'low' WHEN confidence < 80 THEN 'middle' END AS reason FROM {callgraph}) x WHERE reason IS NOT NULL GROUP BY reason")
def a11_skipped_reasons(load):
    """Entry points skipped, by reason."""
    reason = F.when(F.col("confidence") < 60, "low").when(F.col("confidence") < 80, "middle")
    return incremental.skipped_by_reason(load("callgraph").select(reason.alias("reason")))


@query("SELECT source, tp / (tp + tn)::DOUBLE AS precision, tp / (tp + fp)::DOUBLE AS recall FROM (SELECT source, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp, count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS fp, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS tn FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id GROUP BY source) x WHERE tp + tn > 0 AND tp + fp > 0")
def a14_verdicts(load):
    """By the benchmark's own definitions, which are not the usual ones."""
    rows = load("labels").join(load("documents").select("doc_id", "source"), "doc_id")
    return incremental.verdict_ratios(rows.select("source", (F.col("toxic") == 1).alias("reported"), (F.col("quality") == 1).alias("expected")), "source").where("precision is not null and recall is not null")


@query("SELECT DISTINCT n.file, n.line, substr(d.text, 1, 40) AS head FROM {nodes} n JOIN {documents} d ON d.doc_id = n.id % 1000 WHERE n.line < 20")
def src16_source_of_lines(load):
    """Source text by location: joins nodes with their file's text."""
    n = load("nodes").where("line < 20").select("file", "line", (F.col("id") % 1000).alias("doc_id"))
    return n.join(load("documents"), "doc_id").select("file", "line", F.substring("text", 1, 40).alias("head")).distinct()


_GO = "SELECT id AS ep, file, start_line, end_line FROM {entrypoints} WHERE lower(file) LIKE '%.go'"
_PRECISE = "SELECT DISTINCT g.ep_id AS seed, g.call_site_file AS f, g.call_site_line AS l, g.callee_qid AS q, g.callee_start_line AS s, g.callee_end_line AS t, e.file AS ef, e.start_line AS es, e.end_line AS ee FROM {deep_calls} g JOIN {entrypoints} e ON e.id = g.ep_id WHERE g.confidence >= 70 AND g.resolution_kind <> 'dynamic'"


@query(
    "WITH c AS (" + _PRECISE + "), e AS (" + _GO + "), n AS (SELECT DISTINCT qid, file, line FROM {deep_nodes}), a AS (SELECT * FROM c WHERE ef = f AND l BETWEEN es AND ee), p AS (SELECT DISTINCT a.seed, n.file, a.s, a.t FROM a JOIN n ON n.qid = a.q AND n.line BETWEEN a.s AND a.t), "
    "b AS (SELECT DISTINCT c.* FROM c JOIN p ON p.seed = c.seed AND p.file = c.f AND c.l BETWEEN p.s AND p.t), k AS (SELECT DISTINCT b.seed, b.q, b.s, b.t, n.file AS f FROM b JOIN n ON n.qid = b.q AND n.line BETWEEN b.s AND b.t), "
    "m AS (SELECT k.*, e.ep, e.file, CASE WHEN e.start_line <= k.t AND e.end_line >= k.s THEN 0 WHEN e.start_line - k.t BETWEEN 0 AND 10 THEN 1 ELSE 2 END AS lv, CASE WHEN e.start_line <= k.t AND e.end_line >= k.s THEN 0 ELSE least(abs(k.s - e.start_line), abs(k.s - e.end_line), abs(k.t - e.start_line), abs(k.t - e.end_line)) END AS d FROM k JOIN e ON e.file = k.f), "
    "r AS (SELECT *, rank() OVER (PARTITION BY seed, q, s, t, f ORDER BY lv, d) AS r FROM m) "
    "SELECT DISTINCT seed, ep, file FROM (SELECT a.seed, e.ep, e.file FROM a JOIN e ON e.file = a.f AND e.start_line <= a.t AND e.end_line >= a.s UNION ALL SELECT b.seed, e.ep, e.file FROM b JOIN e ON e.file = b.f AND e.start_line <= b.t AND e.end_line >= b.s UNION ALL SELECT seed, ep, file FROM r WHERE r = 1) z WHERE ep <> seed"
)
def g17_precise_downstream(load):
    """From every entry point; ids end in their file's name, so that each fits its file."""
    load.made["entrypoints"] = load("entrypoints").select("id", "file", "start_line", "end_line")
    stored(load, ("entrypoints", "deep_nodes"))
    return impact.precise_downstream(FactCatalog(load("deep_calls").sparkSession, {"entrypoints": load("entrypoints"), "nodes": load("deep_nodes"), "callgraph": load("deep_calls")}), load("entrypoints").select(F.col("id").alias("ep")))


@query()
def g18_affected_downstream(load):
    """Affected entry points with those that impact goes on to."""
    made = stored(load, ("items", "edges", "deep_calls"))
    return impact.affected_with_downstream(FactCatalog(made.spark, made.tables | {"callgraph": load("deep_calls"), "nodes": load("deep_nodes")}), load("changes"), ("entrypoint_body", "call_site", "builtin_sources", "edges_one_hop"))


@query("SELECT ep, true AS expands FROM (SELECT ep, min(CASE WHEN evidence IN ('entrypoint_body','call_site','callee_qid','builtin_sources') THEN 0 WHEN evidence = 'edges_one_hop' THEN 1 ELSE 2 END) AS l FROM (" + _EVIDENCE + ") v GROUP BY ep) x WHERE l < 2")
def s11_downstream_seeds(load):
    return impact.downstream_seeds(impact.evidence(stored(load), load("changes"), tuple(_KINDS)))


@query("SELECT a.file AS a, b.file AS b FROM (SELECT DISTINCT file FROM {entrypoints}) a JOIN (SELECT DISTINCT ltrim(path, '/') AS file FROM {changes}) b ON ends_with(a.file, b.file) OR ends_with(b.file, a.file)")
def j08_either_suffix(load):
    a, b = load("entrypoints").select(F.col("file").alias("a")).distinct(), load("changes").select(P.trimmed(F.col("path")).alias("b")).distinct()
    return a.join(b, P.either_suffix(F.col("a"), F.col("b")))


@query("SELECT DISTINCT c.change_id, q.qid FROM {changes} c JOIN (SELECT DISTINCT qid FROM {nodes}) q ON contains(lower(q.qid), concat('s', c.change_id, '.p', c.first_line % 10))")
def j09_substring(load):
    c = load("changes").select("change_id", F.concat(F.lit("s"), "change_id", F.lit(".p"), F.col("first_line") % 10).alias("part"))
    return load("nodes").select("qid").distinct().join(c, F.contains(F.lower("qid"), F.col("part"))).select("change_id", "qid")


@query("SELECT id, CASE WHEN o IS NULL OR o = '' THEN f ELSE o END AS file FROM (SELECT id, file AS f, CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN NULL ELSE 'kept' END AS o FROM {entrypoints}) x")
def p12_update_where_empty(load):
    old = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.lit(None).cast("string")).otherwise("kept")
    return load("entrypoints").select("id", old.alias("o"), "file").select("id", F.when(~F.coalesce(P.present(F.col("o")), F.lit(False)), F.col("file")).otherwise(F.col("o")).alias("file"))


_STACK = "SELECT DISTINCT finding, CAST(line % 3 AS INT) AS idx, file, CAST(30 * (line % 3) AS INT) AS start_line, CAST(30 * (line % 3) + 45 AS INT) AS end_line FROM {steps} WHERE tag = 'CALL: '"
_FRAMED = "SELECT s.finding, s.pos, s.tag, max(k.idx) AS frame FROM {steps} s LEFT JOIN (" + _STACK + ") k ON k.finding = s.finding AND k.file = s.file AND s.line BETWEEN k.start_line AND k.end_line GROUP BY s.finding, s.pos, s.tag, s.file, s.line"


def _stack(load):
    line = F.col("line")
    return load("steps").where("tag = 'CALL: '").select("finding", (line % 3).cast("int").alias("idx"), "file", (30 * (line % 3)).cast("int").alias("start_line"), (30 * (line % 3) + 45).cast("int").alias("end_line")).distinct()


@query("SELECT finding, pos, tag, coalesce(frame, -1) AS frame FROM (" + _FRAMED + ") f")
def j13_innermost_frame(load):
    return trace.frames(load("steps"), _stack(load)).select("finding", "pos", "tag", F.coalesce("frame", F.lit(-1)).alias("frame"))


@query("SELECT finding, pos FROM (SELECT *, coalesce(lead(gone) OVER (PARTITION BY finding ORDER BY pos), false) AS nxt FROM (SELECT *, tag = 'ARG PASS: ' AND frame IS NOT NULL AND row_number() OVER (PARTITION BY finding, frame, tag ORDER BY pos) > 1 AS gone FROM (" + _FRAMED + ") f) x) y WHERE NOT gone AND NOT (tag = 'CALL: ' AND nxt)")
def w07_first_pass_per_frame(load):
    return trace.first_pass_per_frame(trace.frames(load("steps"), _stack(load))).select("finding", "pos")


_CALLBACKS = "SELECT * FROM (SELECT t.*, callback AND tag = 'CALL: ' AND coalesce(lead(callback AND tag = 'ARG PASS: ') OVER w, false) AND owner NOT IN (SELECT k.func FROM {stacks} k WHERE k.finding = t.finding) AS a, callback AND tag = 'ARG PASS: ' AND coalesce(lag(callback AND tag = 'CALL: ') OVER w, false) AND owner NOT IN (SELECT k.func FROM {stacks} k WHERE k.finding = t.finding) AS b FROM {traces} t WINDOW w AS (PARTITION BY finding ORDER BY pos)) x WHERE NOT a AND NOT b"


@query("SELECT finding, pos FROM (" + _CALLBACKS + ") c")
def w06_foreign_callbacks(load):
    return trace.without_foreign_callbacks(load("traces"), load("stacks")).select("finding", "pos")


@query(
    "WITH RECURSIVE f AS (" + _IN_FRAME + "), k AS (SELECT c.finding, c.pos, c.tag, f.frame FROM (" + _CALLBACKS + ") c JOIN f USING (finding, pos) WHERE c.tag IN ('SOURCE: ', 'SINK: ') OR f.frame >= 0 AND (c.func IS NULL OR c.func IN (SELECT s.func FROM {stacks} s WHERE s.finding = c.finding))), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY pos) AS n FROM k WHERE tag = 'ARG PASS: '), depth AS (SELECT finding, count(DISTINCT idx) AS d FROM {stacks} GROUP BY finding), "
    "w AS (SELECT finding, d, 0::BIGINT AS n, 1 AS nxt, 0 AS pos, false AS took FROM depth UNION ALL SELECT w.finding, w.d, p.n, CASE WHEN nxt < d AND p.frame IN (nxt, nxt - 1) THEN nxt + 1 ELSE nxt END, p.pos, nxt < d AND p.frame IN (nxt, nxt - 1) FROM w JOIN p ON p.finding = w.finding AND p.n = w.n + 1), "
    "m AS (SELECT k.*, k.tag = 'ARG PASS: ' AND NOT coalesce(w.took, false) AS gone FROM k LEFT JOIN w ON w.finding = k.finding AND w.pos = k.pos AND w.n > 0), z AS (SELECT *, coalesce(lead(gone) OVER (PARTITION BY finding ORDER BY pos), false) AS nxt FROM m) "
    "SELECT finding, pos, frame FROM z WHERE NOT gone AND NOT (tag = 'CALL: ' AND nxt)"
)
def w06_callstack_order(load):
    return trace.in_callstack_order(load("traces"), load("stacks")).select("finding", "pos", F.coalesce("frame", F.lit(-1)).alias("frame"))


@query()
def w09_bridges(load):
    stored(load, ("traces", "stacks"))
    return trace.bridged(written(trace.in_callstack_order(trace.bounded(load("traces")), load("stacks")), "ordered"), load("stacks")).select("finding", "pos", "tag", "file", "line")


@query()
def t22_callstack_findings(load):
    """Verdicts of the whole chain of checks and corrections, findings kept and rejected by their reason."""
    stored(load, ("traces", "stacks"))
    return trace.callstack_findings(load("traces"), load("stacks"))[1]


@query("SELECT f.finding, e >= 1 AND coalesce(n, 1) >= e + 1 AS valid FROM (SELECT finding, count(DISTINCT CASE WHEN tag = 'ARG PASS: ' AND frame >= 1 THEN frame END) + sum(CASE WHEN tag = 'SINK: ' THEN 1 ELSE 0 END) AS e FROM (" + _IN_FRAME + ") f GROUP BY finding) f LEFT JOIN (SELECT finding, count(DISTINCT idx) + 1 AS n FROM {stacks} k GROUP BY finding) k ON k.finding = f.finding")
def w08_edge_invariant(load):
    return trace.edge_invariant(trace.frames(load("traces"), load("stacks")), load("stacks"))


def _frame(load, rows: list[tuple], schema: str) -> DataFrame:
    return load("calls").sparkSession.createDataFrame(rows, schema)


_RULE_ROWS = [("sig", 0, "p33", None, None, None, "D"), ("svc", 1, None, r"\.p7", None, None, "A"), ("two", 2, "p17", None, None, None, "B")]
_RULE = "rule_id string, rule_order int, fsig string, fregex string, callee_type string, arg_num int, kind string"
_HIT = "SELECT call_id, ep_id, ret_node, CASE WHEN ends_with(callee, '.p33') THEN 'sig' WHEN contains(callee, '.p7') THEN 'svc' ELSE 'two' END AS rule_id, CASE WHEN ends_with(callee, '.p33') THEN 'D' WHEN contains(callee, '.p7') THEN 'A' ELSE 'B' END AS tag FROM {calls} WHERE ends_with(callee, '.p33') OR contains(callee, '.p7') OR ends_with(callee, '.p17')"
_SELECTED = "SELECT h.*, a.idx, a.node FROM (" + _HIT + ") h JOIN {call_args} a ON a.call_id = h.call_id WHERE (h.rule_id = 'sig' AND a.idx = 0) OR (h.rule_id = 'svc' AND a.idx >= 0) OR (h.rule_id = 'two' AND (a.name = 'data' OR a.idx = -1))"
_SELECTOR_ROWS = [("sig", "position", 0, None), ("svc", "all", None, None), ("two", "keyword", None, "data"), ("two", "receiver", -1, None)]
_SELECTOR = "rule_id string, sel_type string, sel_index int, sel_name string"


@query("SELECT DISTINCT tag, ep_id, ret_node AS node FROM (" + _HIT + ") h")
def t02_return_sources(load):
    return taint.return_sources(load("calls"), _frame(load, _RULE_ROWS, _RULE))


@query("SELECT DISTINCT tag, ep_id, node FROM (" + _SELECTED + ") s")
def t03_argument_sources(load):
    stored(load, ("items", "calls"))
    return taint.argument_sources(load("calls"), load("call_args"), _frame(load, _RULE_ROWS, _RULE), _frame(load, _SELECTOR_ROWS, _SELECTOR))


@query(
    "SELECT DISTINCT * FROM (SELECT a.node AS from_node_id, c.ret_node AS to_node_id, c.ep_id, 'lib_model' AS edge_type FROM {calls} c JOIN {call_args} a ON a.call_id = c.call_id AND a.idx = 0 WHERE ends_with(c.callee, '.p33') "
    "UNION ALL SELECT a.node, b.node, c.ep_id, 'lib_model' FROM {calls} c JOIN {call_args} a ON a.call_id = c.call_id AND a.idx = -1 JOIN {call_args} b ON b.call_id = c.call_id AND b.idx = 1 WHERE ends_with(c.callee, '.p17') "
    "UNION ALL SELECT a.node, c.ret_node, c.ep_id, 'lib_arg_to_ret' FROM {calls} c JOIN {call_args} a ON a.call_id = c.call_id WHERE NOT ends_with(c.callee, '.p33') AND NOT ends_with(c.callee, '.p17')) e"
)
def t10_library_edges(load):
    stored(load, ("items", "calls"))
    models = _frame(load, [("p33", "ARG", 0, "RET", None), ("p17", "THIS", None, "ARG", 1)], "fsig string, from_kind string, from_index int, to_kind string, to_index int")
    return taint.library_edges(load("calls"), load("call_args"), models)


_SANITIZED = "SELECT DISTINCT * FROM (SELECT 'ret' AS sanitizer_id, ep_id, ret_node AS node FROM {calls} WHERE ends_with(callee, '.p33') UNION ALL SELECT 'arg', c.ep_id, a.node FROM {calls} c JOIN {call_args} a ON a.call_id = c.call_id WHERE ends_with(c.callee, '.p7') UNION ALL SELECT 'all', ep_id, NULL FROM {calls} WHERE ends_with(callee, '.p50')) s"


def _sanitizers(load):
    return _frame(load, [("ret", "p33", "RET"), ("arg", "p7", "ARG0"), ("all", "p50", "CALL")], "sanitizer_id string, fsig string, to string")


@query(_SANITIZED)
def t13_sanitized_nodes(load):
    stored(load, ("items", "calls"))
    return taint.sanitized_nodes(load("calls"), load("call_args"), _sanitizers(load))


@query(
    "SELECT f.rule_id, f.tag, f.ep_id, f.call_id, f.node, coalesce(string_agg(DISTINCT z.sanitizer_id, ',' ORDER BY z.sanitizer_id), '') AS sanitizers FROM (SELECT DISTINCT rule_id, 'T' AS tag, ep_id, call_id, node FROM (" + _SELECTED + ") s WHERE node % 20 IN (2, 3, 11)) f "
    "LEFT JOIN (" + _SANITIZED + ") z ON z.ep_id = f.ep_id AND (z.node IS NULL OR z.node = f.node) GROUP BY f.rule_id, f.tag, f.ep_id, f.call_id, f.node"
)
def t16_findings(load):
    """Arguments of sinks that are tainted, with the sanitizers that act on them or on their entry point."""
    stored(load, ("items", "calls"))
    tainted = load("call_args").join(load("calls").select("call_id", "ep_id"), "call_id").where("node % 20 in (2, 3, 11)").select(F.lit("T").alias("tag"), "ep_id", "node")
    found = taint.findings(tainted, load("calls"), load("call_args"), _frame(load, _RULE_ROWS, _RULE), _frame(load, _SELECTOR_ROWS, _SELECTOR), taint.sanitized_nodes(load("calls"), load("call_args"), _sanitizers(load)))
    return found.withColumn("sanitizers", F.array_join("sanitizers", ","))


@query("SELECT DISTINCT p_partkey AS call_id FROM {part} WHERE p_type = 'COPPER' OR ends_with(concat('x.', p_type), '.COPPER') OR p_brand = 'Brand#11'")
def r05_args_by_type(load):
    args = load("part").select(F.col("p_partkey").alias("call_id"), F.lit("r").alias("rule_id"), F.explode(F.array(F.concat(F.lit("x."), "p_type"), F.col("p_brand"))).alias("arg_type"))
    return taint.select_args_by_type(args, load("calls").sparkSession.createDataFrame([("r", "COPPER"), ("r", "Brand#11")], "rule_id string, wanted string")).select("call_id").distinct()


@query("SELECT DISTINCT qid, contains(qid, 'svc.') AND contains(qid, '.p7') AS two, contains(qid, 'svc.') AND contains(qid, '.s1(') AND contains(qid, '.p7') AS three FROM (SELECT qid FROM {nodes} UNION ALL SELECT replace(qid, '.p', '(x).p') FROM {nodes}) n")
def r06_package_values(load):
    q = F.col("qid")
    ids = load("nodes").select("qid").union(load("nodes").select(F.replace("qid", F.lit(".p"), F.lit("(x).p"))))
    return ids.distinct().select("qid", taint.package_value_matches(q, F.lit("svc.p7")).alias("two"), taint.package_value_matches(q, F.lit("svc.s1.p7")).alias("three"))


@query("SELECT DISTINCT call_id AS call, 'plain' AS sink_id FROM {calls} WHERE callee = 'svc.s1.p7' OR ends_with(callee, '.p33') UNION SELECT call_id, 'typed' FROM {calls} WHERE ends_with(callee, '.p7') AND (callee LIKE '%.s2.p7' OR callee LIKE '%.s3.p7')")
def r08_invocation_sinks(load):
    parts = F.split("callee", r"\.")
    calls = load("calls").select(F.col("call_id").alias("call"), F.col("callee").alias("literal"), F.element_at(parts, 3).alias("fsig"), F.concat(F.lit("pkg."), F.element_at(parts, 2)).alias("callee_type"))
    sinks = _frame(load, [("plain", "p33", None), ("plain", "svc.s1.p7", None), ("typed", "p7", "s2")], "sink_id string, fsig string, callee_type string")
    return taint.invocation_sinks(calls, sinks, _frame(load, [("pkg.s3", "pkg.s2")], "type string, related string"))


@query("SELECT DISTINCT c.change_id, g.ep_id AS ep, concat('s', c.change_id * 10, '.p') AS class_name FROM {changes} c JOIN {callgraph} g ON contains(g.callee_qid, concat('s', c.change_id * 10, '.p'))")
def x04_class_bridge(load):
    """A class a change, named by the beginning of some callees."""
    made = catalog(load)
    symbols = load("changes").select(F.concat(F.lit("s"), F.col("change_id") * 10, F.lit(".p")).alias("sid"), F.lit("class").alias("vtype"), F.col("path").alias("file"), F.col("first_line").alias("start_line"), F.col("last_line").alias("end_line"))
    return impact.class_bridge(FactCatalog(made.spark, made.tables | {"symbols": symbols}), load("changes")).select("change_id", "ep", "class_name")


@query(
    "WITH d AS (SELECT c_custkey AS change_id, concat('src/m', c_custkey % 40, '/h', c_custkey % 97, '.go') AS path, c_custkey % 400 + 1 AS first_line, c_custkey % 400 + 30 AS last_line FROM {customer}), g AS (SELECT DISTINCT d.change_id, e.id AS ep FROM d JOIN {entrypoints} e ON e.file = d.path AND e.start_line <= d.last_line AND e.end_line >= d.first_line), "
    "i AS (SELECT DISTINCT o_custkey AS change_id, o_orderkey AS ep FROM {orders} WHERE o_orderstatus = 'P'), m AS (SELECT i.* FROM i ANTI JOIN g ON g.change_id = i.change_id AND g.ep = i.ep) "
    "SELECT g.change_id, 'deleted' AS status, g.ep, false AS rerun FROM g UNION ALL SELECT m.change_id, 'modified', m.ep, true FROM m UNION ALL SELECT d.change_id, 'no_ep_impact', NULL, false FROM d WHERE change_id NOT IN (SELECT change_id FROM g) AND change_id NOT IN (SELECT change_id FROM m)"
)
def x05_deletions(load):
    k = F.col("c_custkey")
    deleted = load("customer").select(k.alias("change_id"), F.concat(F.lit("src/m"), k % 40, F.lit("/h"), k % 97, F.lit(".go")).alias("path"), (k % 400 + 1).alias("first_line"), (k % 400 + 30).alias("last_line"))
    old = load("entrypoints").select(F.col("id").alias("ep"), "file", "start_line", "end_line")
    impacted = load("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("change_id"), F.col("o_orderkey").alias("ep"), F.lit("call_site").alias("reason"))
    return incremental.deletion_changes(deleted, old, impacted).select("change_id", "status", "ep", "rerun")


@query("SELECT url, CASE WHEN starts_with(lower(url), 'http://m.') THEN concat('mobile/', substr(url, 11)) ELSE url END AS moved FROM (SELECT replace(url, 'http://m.', 'http://m./') AS url FROM {pages}) p")
def x14_roots(load):
    u = F.replace("url", F.lit("http://m."), F.lit("http://m./"))
    return load("pages").select(u.alias("url")).select("url", incremental.remapped_root(F.col("url"), "http://m.", "mobile").alias("moved"))


@query(
    "WITH c AS (SELECT super AS node, sub AS child, sub AS name FROM {class_edges}) SELECT 'one' AS tag, b.child AS node FROM c a JOIN c b ON b.node = a.child WHERE a.node = 'R1' AND a.name = 'N2' UNION SELECT 'any', b.child FROM c a JOIN c b ON b.node = a.child WHERE a.node = 'R0' AND b.name LIKE 'C%7' AND b.name = 'C7' UNION SELECT 'all', x FROM (SELECT a.child AS x FROM c a WHERE a.node = 'R2' AND a.name <> '' UNION SELECT b.child FROM c a JOIN c b ON b.node = a.child WHERE a.node = 'R2' UNION SELECT 'R2') z"
)
def t06_path_sources(load):
    """Paths along the class tree: a nation of a region and any of its customers, a customer of any nation, a region and all below."""
    e = load("class_edges").select(F.col("super").alias("node"), F.col("sub").alias("name"), F.col("sub").alias("child"))
    return taint.path_sources(e, _frame(load, [("a", "R1"), ("b", "R0"), ("c", "R2")], "rule_id string, node string"), _frame(load, [("a", "one", "N2.*"), ("b", "any", "*.C7"), ("c", "all", "**")], "rule_id string, tag string, path string"))


@query("SELECT DISTINCT p_partkey AS id, 'GO_INPUT' AS kind FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '*gin.Context' WHEN 1 THEN '*url.URL' WHEN 2 THEN '*http.Request' ELSE 'other' END AS t, CASE p_partkey % 3 WHEN 0 THEN 'Query' WHEN 1 THEN 'FormValue' ELSE 'URL' END AS n FROM {part}) x WHERE (t = '*gin.Context' AND n = 'Query') OR (t = '*url.URL' AND n = 'Query') OR (t = '*http.Request' AND n = 'FormValue')")
def e10_default_sources(load):
    """Calls of Go methods that are sources by default."""
    k, z = F.col("p_partkey"), F.col("p_size") % 4
    uses = load("part").select(k.alias("id"), F.lit("go").alias("language"), F.when(z == 0, "*gin.Context").when(z == 1, "*url.URL").when(z == 2, "*http.Request").otherwise("other").alias("callee_type"), F.lit("return").alias("how"), F.when(k % 3 == 0, "Query").when(k % 3 == 1, "FormValue").otherwise("URL").alias("name"))
    return collectors.sourced(uses, collectors.default_sources(load("part").sparkSession)).select("id", "kind")


@query("SELECT DISTINCT concat('src/', c_nationkey, '.php') AS file, concat('act', c_custkey) AS func_name FROM {customer} WHERE c_custkey % 3 = 0 AND c_custkey % 5 > 0 AND c_custkey % 4 < 3")
def e16_php_controllers(load):
    """A third of the classes are controllers by name; private methods and those without a parameter are none."""
    k = F.col("c_custkey")
    f = load("customer").select(F.concat(F.lit("src/"), "c_nationkey", F.lit(".php")).alias("file"), F.concat(F.lit("K"), k, F.when(k % 3 == 0, "Controller").otherwise("Helper")).alias("class_name"), F.array(F.lit("Base")).alias("bases"), F.concat(F.lit("act"), k).alias("func_name"), F.array(F.when(k % 4 == 3, "private").otherwise("public")).alias("modifiers"), (k % 5).cast("int").alias("n_params"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    return collectors.php_controllers(f).select("file", "func_name")


@query("SELECT DISTINCT concat('src/', c_nationkey, '.py') AS file, concat('fn', c_custkey) AS func_name FROM {customer} WHERE c_custkey % 4 < 2 AND c_nationkey % 2 = 0")
def e01_fastapi(load):
    """Functions decorated by a verb of a router that their file makes; every second file makes one."""
    k = F.col("c_custkey")
    mark = F.struct(F.when(k % 4 == 0, "app.get").when(k % 4 == 1, "app.post").when(k % 4 == 2, "app.trace").otherwise("other.get").alias("name"), F.lit(True).alias("call"), F.lit(None).cast("string").alias("first"))
    f = load("customer").select(F.concat(F.lit("src/"), "c_nationkey", F.lit(".py")).alias("file"), F.lit(None).cast("string").alias("class_name"), F.concat(F.lit("fn"), k).alias("func_name"), F.array(mark).alias("decorators"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    made = load("nation").select(F.concat(F.lit("src/"), "n_nationkey", F.lit(".py")).alias("file"), F.lit("app").alias("var"), F.when(F.col("n_nationkey") % 2 == 0, "fastapi.FastAPI").otherwise("flask.Flask").alias("callee"))
    return collectors.fastapi(f, made).select("file", "func_name")


_FUNCS = "SELECT id AS node, file, start_line, end_line FROM {entrypoints} UNION ALL SELECT id + 100000000, file, start_line + 2, end_line - 2 FROM {entrypoints} WHERE id % 3 = 0"
_PLACES = "SELECT id AS loc, file, line AS first_line, line + 1 AS last_line FROM {nodes} WHERE line > 0"


def _functions(load):
    e = load("entrypoints").select(F.col("id").alias("node"), "file", "start_line", "end_line")
    return e.unionByName(load("entrypoints").where("id % 3 = 0").select((F.col("id") + 100000000).alias("node"), "file", (F.col("start_line") + 2).alias("start_line"), (F.col("end_line") - 2).alias("end_line")))


def _places(load):
    return load("nodes").where("line > 0").select(F.col("id").alias("loc"), "file", F.col("line").alias("first_line"), (F.col("line") + 1).alias("last_line"))


_AT = "SELECT loc, max_by(node, struct_pack(a := start_line, b := -end_line, c := node)) AS node FROM (" + _PLACES + ") p JOIN (" + _FUNCS + ") f ON f.file = p.file AND p.first_line >= f.start_line AND p.last_line <= f.end_line GROUP BY loc"


@query(_AT)
def g13_nodes_at(load):
    return graph.nodes_at(_places(load), _functions(load))


@query(
    "WITH hit AS (" + _AT + "), p AS (" + _PLACES + ") SELECT loc, CASE WHEN node >= 100000000 THEN node - 100000000 ELSE node END AS node, NULL AS file, 'FuncEntryPointByLoc' AS attribute FROM hit UNION ALL SELECT loc, NULL, file, 'FileEntryPointByLoc' FROM p WHERE loc NOT IN (SELECT loc FROM hit) AND file IN (SELECT file FROM {entrypoints})"
)
def g14_entrypoints_at(load):
    """Inner functions are called by the outer ones."""
    edges = load("entrypoints").where("id % 3 = 0").select(F.col("id").alias("src"), (F.col("id") + 100000000).alias("dst"))
    return graph.entrypoints_at(_places(load), _functions(load), edges, load("entrypoints").select("file"))


@query("SELECT caller_func AS src, callee_qid AS dst FROM {callgraph} WHERE caller_func NOT LIKE '%entry_point%' AND id % 9 > 0")
def g03_dump(load):
    """Every ninth edge comes from the pseudo node."""
    e = load("callgraph").select(F.when(F.col("id") % 9 == 0, "entry_point").otherwise(F.col("caller_func")).alias("src"), F.col("callee_qid").alias("dst"))
    return graph.dumped(e)


@query("SELECT DISTINCT CASE WHEN line % 4 = 0 THEN 'undefined' WHEN line % 4 = 1 THEN '[hasOwnProperty]' ELSE concat('m/', qid) END AS id FROM {nodes}")
def g01_node_ids(load):
    marked = F.when(F.col("line") % 4 == 1, "hasOwnProperty").when(F.col("line") % 4 > 1, F.concat(F.lit("/src/m/<global>."), "qid", F.lit("<copied_1_endtag>")))
    return load("nodes").select(graph.node_id(marked, "/src").alias("id")).distinct()


@query("SELECT DISTINCT 'T' AS tag, super AS node FROM {class_edges} WHERE sub LIKE 'C%7' UNION SELECT 'T', e.super FROM {class_edges} e JOIN {class_edges} c ON c.super = e.sub WHERE c.sub LIKE 'C%7' UNION SELECT 'T', sub FROM {class_edges} WHERE sub LIKE 'C%7'")
def g22_holding(load):
    e = load("class_edges").select(F.col("super").alias("node"), F.col("sub").alias("child"))
    return graph.holding(e, load("class_edges").where("sub like 'C%7'").select(F.lit("T").alias("tag"), F.col("sub").alias("node")))


@query("SELECT n.super AS root, c.sub AS value FROM {class_edges} n JOIN {class_edges} c ON c.super = n.sub WHERE n.super LIKE 'R%'")
def g21_flattened(load):
    e = load("class_edges").select(F.col("super").alias("union"), F.col("sub").alias("value"))
    kinds = load("class_edges").select(F.col("sub").alias("value"), F.when(F.startswith("sub", F.lit("N")), "union").otherwise("symbol").alias("kind")).distinct()
    return graph.flattened(e, load("class_edges").where("super like 'R%'").select(F.col("super").alias("root")).distinct(), kinds, ("symbol",))


@query("SELECT o_custkey AS k, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS first FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM {orders}) x WHERE r <= 5 GROUP BY o_custkey")
def l03_unrolled(load):
    rows = load("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("v"))
    return rows.select("k", F.array_join(taint.unrolled(F.col("v"), 5), ",").alias("first"))


@query("SELECT u AS \"union\", min(id) AS value FROM (SELECT ep_id AS u, id, CASE WHEN id % 2 = 0 THEN concat('loc|', line) ELSE concat('is|object|', qid) END AS k FROM {nodes} WHERE id <> ep_id) x GROUP BY u, k")
def s17_appended(load):
    n = load("nodes")
    even = F.col("id") % 2 == 0
    rows = n.select(F.col("ep_id").alias("union"), F.col("id").alias("pos"), F.col("id").alias("value"), F.when(even, "symbol").otherwise("object").alias("kind"), F.col("qid").alias("content"), F.when(even, F.col("line").cast("string")).alias("loc"))
    return taint.appended(rows).select("union", "value")


@query(
    "WITH f AS (SELECT event_id AS seq, CASE event_id % 2 WHEN 0 THEN 'taint' ELSE 'chain' END AS strategy, concat(user_id, '|', event_type) AS key, event_id % 3 = 0 AS held FROM {events}) SELECT strategy, key, seq FROM f WHERE held UNION ALL SELECT strategy, key, min(seq) FROM f WHERE NOT held AND strategy = 'taint' AND (strategy, key) NOT IN (SELECT (strategy, key) FROM f WHERE held) GROUP BY strategy, key UNION ALL SELECT strategy, key, seq FROM f WHERE NOT held AND strategy = 'chain'"
)
def s19_merged_buffers(load):
    f = load("events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "taint").otherwise("chain").alias("strategy"), F.concat("user_id", F.lit("|"), "event_type").alias("key"))
    return taint.merged_buffers(f.where("seq % 3 = 0"), f.where("seq % 3 != 0"), ("taint",))


@query("SELECT o_orderkey AS rule, CASE WHEN o_orderstatus = 'F' THEN 'F' WHEN o_orderstatus IS NULL THEN 'F' ELSE concat(o_orderstatus, ',F') END AS kinds FROM {orders}")
def t25_source_kinds(load):
    rules = load("orders").select(F.col("o_orderkey").alias("rule"), F.array("o_orderstatus").alias("kinds"))
    return taint.with_source_kinds(rules, "F").select("rule", F.array_join("kinds", ",").alias("kinds"))


@query("SELECT e.file, c.role, c.line FROM (SELECT DISTINCT file FROM {entrypoints}) e JOIN (SELECT 'source' AS role, ltrim(replace(path, 'src/', ''), '/') AS p, first_line AS line FROM {changes} UNION ALL SELECT 'sink', path, last_line FROM {changes}) c ON ends_with(e.file, c.p)")
def p19_flow_locations(load):
    c = load("changes")
    rows = c.select(F.lit("source").alias("role"), F.concat(P.trimmed(F.replace("path", F.lit("src/"), F.lit(""))), F.lit(":"), "first_line").alias("place")).union(c.select(F.lit("sink"), F.concat("path", F.lit(":"), "last_line")))
    return taint.flow_locations(rows, load("entrypoints").select("file"))


@query("SELECT file_path FROM (SELECT concat(source, '/', doc_id, '.txt') AS file_path, doc_id, text FROM {documents}) d WHERE doc_id % 4 = 0 OR doc_id % 7 = 0")
def src04_changed_files(load):
    """A cache that has three of four files, one in seven of them with another content."""
    files = load("documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("file_path"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")
    old = files.where("doc_id % 4 != 0").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    return changed_files(files.drop("doc_id"), digests(old)).select("file_path")


def _more(load, *names: str) -> FactCatalog:
    made = catalog(load)
    return FactCatalog(made.spark, made.tables | {n: load(n) for n in names})


_FACT = "SELECT DISTINCT c.change_id, f.consumer_ep_id AS ep FROM {fact} f JOIN {wide_changes} c ON "


@query(_FACT.replace("{fact}", "{go_interface_bindings}") + _SUFFIX.replace("{f}", "f.impl_method_file") + " AND f.impl_method_start_line <= c.last_line AND f.impl_method_end_line >= c.first_line WHERE f.dispatch_kind = 'go_interface_dispatch' AND f.dispatch_confidence >= 70")
def s06_interface_dispatch(load):
    return impact.go_interface_dispatch(_more(load, "go_interface_bindings"), load("wide_changes"))


@query("SELECT DISTINCT n.change_id, f.consumer_ep_id AS ep FROM {handler_response_flow_facts} f JOIN (" + _NODES.replace("{changes}", "{wide_changes}") + ") n ON n.id IN (f.producer_call_node_id, f.producer_return_node_id, f.payload_node_id) WHERE f.confidence >= 70 AND f.ordering_kind <> 'unordered'")
def s06_handler_response(load):
    return impact.handler_response_flow(_more(load, "handler_response_flow_facts"), load("wide_changes"))


@query(_FACT.replace("{fact}", "{mutating_receiver_alias}") + _SUFFIX.replace("{f}", "f.call_site_file") + " AND f.call_site_line BETWEEN c.first_line AND c.last_line WHERE f.confidence >= 70")
def s06_receiver_alias(load):
    return impact.mutating_receiver_alias(_more(load, "mutating_receiver_alias"), load("wide_changes"))


@query(_FACT.replace("{fact}", "{decl_use_impact_edges}") + _SUFFIX.replace("{f}", "f.changed_file") + " AND f.changed_start_line <= c.last_line AND f.changed_end_line >= c.first_line WHERE f.confidence >= 70")
def s06_declaration_uses(load):
    return impact.decl_use_impact_edges(_more(load, "decl_use_impact_edges"), load("wide_changes"))


@query("SELECT DISTINCT concat(f.file, ':', e.file) AS pair, contains(replace(replace(f.qual, '-', '_'), '/', '.'), replace(e.file, '.go', '')) AS same FROM (SELECT DISTINCT file, replace(replace(file, '/', '.'), '.go', '') AS qual FROM {nodes} WHERE line < 6) f JOIN (SELECT DISTINCT file FROM {nodes} WHERE line < 6) e ON right(e.file, 6) = right(f.file, 6) WHERE contains(f.qual, replace(replace(e.file, '/', '.'), '.go', '')) OR contains(f.qual, replace(regexp_replace(e.file, '/[^/]*$', ''), '/', '.'))")
def r12_qualifier_files(load):
    """Files whose module or package path is in a qualifier."""
    f = load("nodes").where("line < 6").select("file").distinct()
    q = f.select(F.col("file").alias("q_file"), F.regexp_replace(F.replace("file", F.lit("/"), F.lit(".")), r"\.go$", "").alias("qual"), F.right("file", F.lit(6)).alias("t"))
    j = f.withColumn("t", F.right("file", F.lit(6))).join(q, "t").where(impact.qualifier_matches_file(F.col("qual"), F.col("file")))
    return j.select(F.concat("q_file", F.lit(":"), "file").alias("pair"), F.contains("qual", F.replace("file", F.lit(".go"), F.lit(""))).alias("same")).distinct()


_SUMMARY_TEXT = "SELECT DISTINCT concat('pkg.', qid, '\\n[', split_part(file, '/', 3), ' : ', line, '_', line + 9, ']') AS text, concat('pkg.', qid) AS qual, split_part(file, '/', 3) AS file, line AS start_line, line + 9 AS end_line FROM {nodes} WHERE line < 100"


@query("SELECT qual, file, start_line, CAST(end_line AS INT) AS end_line FROM (" + _SUMMARY_TEXT + ") t")
def r11_summary_functions(load):
    n = load("nodes").where("line < 100")
    text = F.concat(F.lit("pkg."), "qid", F.lit("\\n["), F.element_at(F.split("file", "/"), 3), F.lit(" : "), "line", F.lit("_"), F.col("line") + 9, F.lit("]"))
    return n.select(text.alias("text")).distinct().select(*(v.alias(k) for k, v in patterns.summary_function(F.col("text")).items()))


@query("SELECT file, kind, min(line) AS first_line, max(line) AS last_line FROM (SELECT *, line - row_number() OVER (PARTITION BY file, kind ORDER BY line) AS g FROM (SELECT DISTINCT file, line, CASE WHEN line % 50 < 25 THEN 'added' ELSE 'deleted' END AS kind FROM {nodes}) d) x GROUP BY file, kind, g")
def x03_coalesced_ranges(load):
    """Neighbouring lines of one kind; the order is that of the lines."""
    lines = load("nodes").select("file", "line", F.when(F.col("line") % 50 < 25, "added").otherwise("deleted").alias("kind")).distinct()
    return incremental.coalesce_ranges(lines.withColumn("n", F.col("line"))).select("file", "kind", "first_line", "last_line")


@query("SELECT id, concat(file, '|', coalesce(func_name, ''), '|', ep_type, '|||', coalesce(attribute, '')) AS key FROM {entrypoints} WHERE id % 2 = 0 UNION ALL SELECT id, concat(file, '|', func_name) FROM {entrypoints} WHERE id % 2 = 1")
def x11_canonical_keys(load):
    whole = incremental.entrypoint_key(*incremental.KEY)
    key = F.when(F.col("id") % 2 == 0, whole).otherwise(F.concat("file", F.lit("|"), "func_name"))
    return load("entrypoints").select("id", incremental.canonical_key(key).alias("key"))


@query("SELECT id, start_line FROM {entrypoints} WHERE concat_ws('|', file, func_name, ep_type, start_line, end_line, attribute) IN (SELECT concat_ws('|', file, func_name, ep_type, start_line, end_line, attribute) FROM {entrypoints} WHERE framework = '5-LOW')")
def x08_allowed(load):
    keys = load("entrypoints").where("framework = '5-LOW'").select(incremental.entrypoint_key(*incremental.KEY).alias("key"))
    return incremental.allowed(load("entrypoints"), keys).select("id", "start_line")
