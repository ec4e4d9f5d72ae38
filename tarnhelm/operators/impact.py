"""Change impact: changed line ranges to entry points, with the evidence for each.

``changes`` has change_id, path, first_line, last_line. Files are matched once per distinct path, by the path's end first, and rows then
join on the path by equality.
Each evidence operator returns change_id, ep (the entry point's id).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..scratch import TASK_ROWS, written
from ..sources.catalog import FactCatalog

STRUCTURAL = ("entrypoint_body", "call_site", "callee_qid", "builtin_sources", "go_interface_dispatch")
GENERAL, MODULE = 70, 90


#: Last characters by which a path and a change meet before they are compared.
TAIL = 4


def matched_paths(files: DataFrame, changes: DataFrame) -> DataFrame:
    """_file and the columns of each change whose path is a suffix of it. files: _file, distinct.

    Paths meet by their last characters; only changes whose path is shorter, or has a wildcard of LIKE, are compared with every file.
    """
    tail = lambda c: F.lower(F.right(P.trimmed(F.col(c)), F.lit(TAIL)))
    odd = (F.length(P.trimmed(F.col("path"))) < TAIL) | F.col("path").rlike(r"[%_\\]")
    like = P.suffix(F.col("_file"), F.col("path"))
    keyed = files.withColumn("_tail", tail("_file")).join(changes.where(~odd).withColumn("_tail", tail("path")), "_tail").where(like)
    return keyed.select("_file", *changes.columns).unionByName(files.join(changes.where(odd), like).select("_file", *changes.columns))


def touched(rows: DataFrame, changes: DataFrame, file: str = "file") -> DataFrame:
    """rows x the changes whose path is a suffix of their file."""
    files = rows.select(F.col(file).alias("_file")).where(F.col("_file").isNotNull()).distinct()
    matched = matched_paths(files, changes)
    return rows.join(matched, rows[file] == matched["_file"]).drop("_file")


def at_line(rows: DataFrame, changes: DataFrame, file: str, line: str) -> DataFrame:
    return touched(rows, changes, file).where(F.col(line).between(F.col("first_line"), F.col("last_line")))


def in_range(rows: DataFrame, changes: DataFrame, file: str, start: str, end: str) -> DataFrame:
    return touched(rows, changes, file).where(P.overlaps(F.col(start), F.col(end), F.col("first_line"), F.col("last_line")))


def _out(rows: DataFrame, ep: str) -> DataFrame:
    return rows.where(F.col(ep).isNotNull()).select("change_id", F.col(ep).alias("ep")).distinct()


def entrypoint_body(facts: FactCatalog, changes: DataFrame) -> DataFrame:
    return _out(in_range(facts["entrypoints"].select("id", "file", "start_line", "end_line"), changes, "file", "start_line", "end_line"), "id")


def call_site(facts: FactCatalog, changes: DataFrame) -> DataFrame:
    return _out(at_line(facts["callgraph"].select("ep_id", "call_site_file", "call_site_line"), changes, "call_site_file", "call_site_line"), "ep_id")


def changed_nodes(facts: FactCatalog, changes: DataFrame) -> DataFrame:
    return at_line(facts["nodes"].select("id", "ep_id", "qid", "file", "line"), changes, "file", "line")


def node_counts(facts: FactCatalog, changes: DataFrame) -> DataFrame:
    counts = changed_nodes(facts, changes).groupBy("change_id").agg(F.count("*").alias("n"))
    return changes.join(counts, "change_id", "left").select("change_id", F.coalesce("n", F.lit(0)).cast("long").alias("nodes"))


def enclosing_ranges(facts: FactCatalog, changes: DataFrame) -> DataFrame:
    """The changes and the ranges of functions around them, from call-graph callees and interface bindings: change_id, path, first_line, last_line."""
    own = changes.select("change_id", P.trimmed(F.col("path")).alias("path"), "first_line", "last_line")
    parts = [own]
    if facts.has("callgraph", "callee_qid", "callee_start_line", "callee_end_line"):
        qids = touched(facts["nodes"].select("qid", "file").where("qid is not null").distinct(), changes, "file").select("change_id", "path", "first_line", "last_line", "qid").distinct()
        calls = facts["callgraph"].where(P.present(F.col("callee_qid"))).select("callee_qid", "call_site_file", "callee_start_line", "callee_end_line").distinct()
        hit = calls.join(qids, calls["callee_qid"] == qids["qid"]).where(P.overlaps(F.col("callee_start_line"), F.col("callee_end_line"), F.col("first_line"), F.col("last_line")))
        hit = hit.where(~P.suffix(F.coalesce("call_site_file", F.lit("")), F.col("path")))
        parts.append(hit.select("change_id", P.trimmed(F.col("path")).alias("path"), F.col("callee_start_line").alias("first_line"), F.col("callee_end_line").alias("last_line")))
    for table in ("go_interface_bindings", "callgraph"):
        if facts.has(table, "impl_method_file", "impl_method_start_line", "impl_method_end_line"):
            hit = in_range(facts[table].select("impl_method_file", "impl_method_start_line", "impl_method_end_line"), changes, "impl_method_file", "impl_method_start_line", "impl_method_end_line")
            parts.append(hit.select("change_id", P.trimmed(F.col("impl_method_file")).alias("path"), F.col("impl_method_start_line").alias("first_line"), F.col("impl_method_end_line").alias("last_line")))
    every = reduce(DataFrame.unionByName, parts)
    first, last = F.least("first_line", "last_line"), F.greatest("first_line", "last_line")
    kept = every.where((F.col("first_line") > 0) & (F.col("last_line") > 0)).select("change_id", "path", first.alias("first_line"), last.alias("last_line"))
    return kept.unionByName(own).distinct()


def callee_qid(facts: FactCatalog, changes: DataFrame) -> DataFrame:
    """Callers of names that have a node in a changed or enclosing range, narrowed by symbols where the facts have them.

    A range for which some call carries a symbol keeps only the entry points whose call's symbol lies in it; one without keeps all.
    """
    ranges = enclosing_ranges(facts, changes).withColumn("range_id", F.xxhash64("change_id", "path", "first_line", "last_line"))
    calls = facts["callgraph"].where("ep_id is not null").select("ep_id", "callee_qid", "callee_symbol_id").distinct()
    qids = at_line(facts["nodes"].where("qid is not null").select("qid", "file", "line").distinct(), ranges, "file", "line").select("range_id", "change_id", "qid").distinct()
    named = calls.join(qids, calls["callee_qid"] == qids["qid"]).select("range_id", "change_id", "ep_id", "callee_symbol_id").distinct()
    if not (facts.has("callgraph", "callee_symbol_id") and facts.has("symbols")):
        return _out(named, "ep_id")
    symbols = in_range(facts["symbols"].select("symbol_id", "file", "start_line", "end_line"), ranges, "file", "start_line", "end_line").select("range_id", "symbol_id").distinct()
    precise = calls.join(symbols, calls["callee_symbol_id"] == symbols["symbol_id"]).select("range_id", F.col("ep_id").alias("precise_ep")).distinct()
    some = named.groupBy("range_id").agg(F.max(P.present(F.col("callee_symbol_id"))).alias("any_symbol"))
    found = precise.groupBy("range_id").agg(F.count("*").alias("n_precise"))
    switch = named.join(some, "range_id").join(found, "range_id", "left").join(precise, (named["range_id"] == precise["range_id"]) & (named["ep_id"] == precise["precise_ep"]), "left")
    n = F.coalesce("n_precise", F.lit(0))
    return _out(switch.where(((n > 0) & F.col("precise_ep").isNotNull()) | ((n == 0) & ~F.coalesce("any_symbol", F.lit(False)))).select("change_id", "ep_id"), "ep_id")


def builtin_sources(facts: FactCatalog, changes: DataFrame) -> DataFrame:
    """The table's ep_id is the entry point's text id."""
    hit = at_line(facts["builtin_sources"].select("ep_id", "file", "line"), changes, "file", "line").select("change_id", "ep_id").distinct()
    return _out(hit.join(facts["entrypoints"].select("id", "ep_id"), "ep_id"), "id")


def edges_one_hop(facts: FactCatalog, changes: DataFrame) -> DataFrame:
    """Entry points with an edge from or to a changed node: two equi-joins, not one on either key."""
    nodes = changed_nodes(facts, changes).select("change_id", "id").distinct()
    edges = facts["edges"].select("ep_id", "from_node_id", "to_node_id")
    sides = [edges.join(nodes, edges[k] == nodes["id"]).select("change_id", "ep_id") for k in ("from_node_id", "to_node_id")]
    return _out(sides[0].union(sides[1]), "ep_id")


def module_deps(facts: FactCatalog, changes: DataFrame, least: int = MODULE) -> DataFrame:
    rows = facts["module_deps"].where((F.col("confidence") >= least) & P.present(F.col("imported_file"))).select("consumer_ep_id", "imported_file")
    hit = touched(rows, changes, "imported_file").select("change_id", "consumer_ep_id").distinct()
    return _out(hit.join(facts["entrypoints"].select(F.col("id").alias("consumer_ep_id")), "consumer_ep_id"), "consumer_ep_id")


def go_interface_dispatch(facts: FactCatalog, changes: DataFrame, least: int = GENERAL) -> DataFrame:
    """Bindings of that kind whose implementation is changed; one with a call is kept if the call's return has no node or goes on."""
    rows = facts["go_interface_bindings"].where((F.col("dispatch_kind") == "go_interface_dispatch") & (F.col("dispatch_confidence") >= least))
    hit = in_range(rows, changes, "impl_method_file", "impl_method_start_line", "impl_method_end_line")
    if facts.has("go_interface_bindings", "callgraph_id") and facts.has("callgraph", "return_node_id"):
        goes_on = facts["edges"].select(F.col("from_node_id").alias("return_node_id")).distinct().withColumn("goes_on", F.lit(True))
        calls = facts["callgraph"].select(F.col("id").alias("callgraph_id"), "return_node_id").join(goes_on, "return_node_id", "left")
        fine = calls.where("return_node_id is null or goes_on").select("callgraph_id", F.lit(True).alias("fine"))
        hit = hit.join(fine, "callgraph_id", "left").where("callgraph_id is null or fine")
    return _out(hit, "consumer_ep_id")


ANCHORS = ("producer_call_node_id", "producer_return_node_id", "producer_err_node_id", "producer_result_node_id", "receiver_call_node_id", "receiver_node_id", "payload_call_node_id", "payload_node_id")


def handler_response_flow(facts: FactCatalog, changes: DataFrame, least: int = GENERAL) -> DataFrame:
    """A changed node is one of a fact's eight anchors: the anchors are exploded, then joined by equality."""
    rows = facts["handler_response_flow_facts"].where((F.col("confidence") >= least) & (F.col("ordering_kind") == "producer_before_receiver_before_payload"))
    each = rows.select("consumer_ep_id", F.explode(F.array_distinct(F.array(*ANCHORS))).alias("id")).where("id is not null")
    return _out(changed_nodes(facts, changes).select("change_id", "id").join(each, "id"), "consumer_ep_id")


def mutating_receiver_alias(facts: FactCatalog, changes: DataFrame, least: int = GENERAL) -> DataFrame:
    rows = facts["mutating_receiver_alias"].where(F.col("confidence") >= least)
    return _out(at_line(rows.select("consumer_ep_id", "call_site_file", "call_site_line"), changes, "call_site_file", "call_site_line"), "consumer_ep_id")


def decl_use_impact_edges(facts: FactCatalog, changes: DataFrame, least: int = GENERAL) -> DataFrame:
    rows = facts["decl_use_impact_edges"].where(F.col("confidence") >= least)
    return _out(in_range(rows.select("consumer_ep_id", "changed_file", "changed_start_line", "changed_end_line"), changes, "changed_file", "changed_start_line", "changed_end_line"), "consumer_ep_id")


def class_bridge(facts: FactCatalog, changes: DataFrame) -> DataFrame:
    """change_id, ep, class_name: entry points with a call whose callee, caller or dotted path holds the name of a changed class; weak names link nothing. Distinct names are searched, then rows join by equality."""
    classes = in_range(facts["symbols"].where((F.col("vtype") == "class") & P.present(F.col("sid"))).select("sid", "file", "start_line", "end_line"), changes, "file", "start_line", "end_line")
    classes = classes.select("change_id", F.col("sid").alias("class_name")).where(~P.weak_class_name(F.col("class_name"))).distinct()
    columns = [c for c in ("callee_qid", "caller_qid", "callee_dotted_path") if facts.has("callgraph", c)]
    if not columns:
        return changes.sparkSession.createDataFrame([], "change_id int, ep long, class_name string")
    calls = facts["callgraph"].where("ep_id is not null").select(F.col("ep_id").alias("ep"), F.explode(F.array_distinct(F.array(*columns))).alias("name")).where(P.present(F.col("name"))).distinct()
    held = calls.select("name").distinct().join(classes.select("class_name").distinct(), F.contains(F.col("name"), F.col("class_name")))
    return calls.join(held, "name").join(classes, "class_name").select("change_id", "ep", "class_name").distinct()


EVIDENCE = {
    f.__name__: f
    for f in (entrypoint_body, call_site, callee_qid, builtin_sources, module_deps, go_interface_dispatch, handler_response_flow, mutating_receiver_alias, decl_use_impact_edges, edges_one_hop)
}


def evidence(facts: FactCatalog, changes: DataFrame, kinds=tuple(EVIDENCE)) -> DataFrame:
    """evidence, change_id, ep: all kinds together."""
    return reduce(DataFrame.unionByName, [EVIDENCE[k](facts, changes).select(F.lit(k).alias("evidence"), "change_id", "ep") for k in kinds])


DIRECT = ("entrypoint_body", "call_site", "callee_qid", "builtin_sources", "module_deps", "go_interface_dispatch", "handler_response_flow", "edges_one_hop")


def tightened(found: DataFrame, downstream: DataFrame | None = None) -> DataFrame:
    """The evidence of a single change, narrowed where an entry point's body is hit: to that one if it is alone, else to direct evidence. Those that came downstream (ep) stay."""
    bodies = found.where("evidence = 'entrypoint_body'").select("ep").distinct()
    n = bodies.limit(2).count()
    if not n:
        return found
    keep = bodies if n == 1 else found.where(F.col("evidence").isin(*DIRECT)).select("ep")
    if downstream is not None:
        keep = keep.unionByName(downstream.select("ep"))
    return found.join(keep.distinct(), "ep", "left_semi")


def affected(facts: FactCatalog, changes: DataFrame, kinds=tuple(EVIDENCE)) -> DataFrame:
    """ep, ep_id, file, n_evidence, reasons of every affected entry point. A diff of one change is tightened."""
    found = evidence(facts, changes, kinds)
    if changes.limit(2).count() == 1:
        found = tightened(found)
    named = found.join(changes, "change_id").withColumn("reason", F.concat("evidence", F.lit(": "), P.trimmed(F.col("path")), F.lit(":"), "first_line", F.lit("-"), "last_line"))
    grouped = named.groupBy("ep").agg(F.countDistinct("evidence").alias("n_evidence"), F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))
    entry = facts["entrypoints"].select(F.col("id").alias("ep"), "ep_id", "file")
    return grouped.join(entry, "ep").select("ep", "ep_id", "file", "n_evidence", "reasons")


def downstream_seeds(found: DataFrame) -> DataFrame:
    """ep, expands: the entry points from which impact goes on. Provenance alone is none; a structural seed that also has handler-response evidence is one that expands to nothing."""
    handler = found.where("evidence = 'handler_response_flow'").select("ep").distinct().withColumn("handler", F.lit(True))
    s = seeds(found).where("seed != 'provenance_only'").join(handler, "ep", "left")
    return s.select("ep", (~((F.col("seed") == "structural") & F.coalesce("handler", F.lit(False)))).alias("expands"))


def allowed_downstream(found: DataFrame, downstream: DataFrame) -> DataFrame:
    """Downstream rows (ep), only among edges-only entry points where no seed is structural."""
    s = seeds(found)
    structural = s.where("seed = 'structural'").limit(1).count()
    return downstream if structural else downstream.join(s.where("seed = 'edges_only'").select("ep"), "ep", "left_semi")


def _module_paths(path):
    """The dotted paths of a file, without its extension, and of its folder; dashes are underscores."""
    dotted = F.replace(F.replace(P.trimmed(path), F.lit("/"), F.lit(".")), F.lit("-"), F.lit("_"))
    module = F.regexp_replace(dotted, r"\.?[^.]*$", "")
    return module, F.regexp_replace(module, r"\.?[^.]*$", "")


def qualifier_matches_file(qual, path):
    q = F.replace(F.replace(qual, F.lit("-"), F.lit("_")), F.lit("/"), F.lit("."))
    module, package = _module_paths(path)
    return ((module != "") & F.contains(q, module)) | ((package != "") & F.contains(q, package))


def summary_downstream(facts: FactCatalog, seed_eps: DataFrame, hops: int = 2) -> DataFrame:
    """seed, ep, file: entry points of functions that the seeds' functions call, by summary rows of the call graph (no ep_id), in at most two hops.

    Functions meet by name and file name; from the second hop on also by qualifier. seed_eps: ep.
    """
    from ..functions.patterns import summary_function

    entry = facts["entrypoints"]
    if not facts.has("callgraph", "caller_func", "callee_fsig", "ep_id"):
        return seed_eps.sparkSession.createDataFrame([], "seed long, ep long, file string")
    rows = facts["callgraph"].where("ep_id is null").select("caller_func", "callee_fsig").distinct()
    parts = {f"{side}_{k}": v for side, c in (("caller", "caller_func"), ("callee", "callee_fsig")) for k, v in summary_function(F.col(c)).items()}
    rows = rows.select(*(v.alias(k) for k, v in parts.items())).where("caller_qual is not null and callee_qual is not null")
    key = lambda side: F.concat(F.substring_index(f"{side}_qual", ".", -1), F.lit("|"), F.col(f"{side}_file"))
    rows = rows.select("*", key("caller").alias("caller_key"), key("callee").alias("callee_key"))
    start = seed_eps.select("ep").join(entry.select(F.col("id").alias("ep"), "file", "func_name"), "ep").where(P.present(F.col("func_name")))
    frontier = start.select(F.col("ep").alias("seed"), F.concat("func_name", F.lit("|"), P.basename(F.col("file"))).alias("key"))
    seen, called = frontier, None
    for _ in range(hops):
        step = frontier.join(rows, F.col("key") == F.col("caller_key")).select("seed", "callee_qual", "callee_file", "callee_start_line", "callee_end_line", "callee_key").distinct()
        called = step if called is None else called.unionByName(step)
        frontier = step.select("seed", F.col("callee_key").alias("key")).distinct().join(seen, ["seed", "key"], "left_anti")
        seen = seen.unionByName(frontier)
    go = entry.where(P.is_go(F.col("file"))).select(F.col("id").alias("ep"), "file", "func_name", "start_line", "end_line", P.basename(F.col("file")).alias("_base"))
    c = called.distinct().withColumn("_base", P.basename(F.col("callee_file")))
    hit = c.join(go, "_base").where(P.suffix(F.col("file"), F.col("callee_file")) & qualifier_matches_file(F.col("callee_qual"), F.col("file")))
    good = P.overlaps(F.col("start_line"), F.col("end_line"), F.col("callee_start_line"), F.col("callee_end_line")) | (F.col("func_name") == F.substring_index("callee_qual", ".", -1))
    ranked = hit.withColumn("level", F.when(F.coalesce(good, F.lit(False)), 0).otherwise(1)).withColumn("best", F.min("level").over(Window.partitionBy("seed", "callee_qual", "callee_file", "callee_start_line")))
    return ranked.where("level = best and ep != seed").select("seed", "ep", "file").distinct()


def file_names(path):
    """The file's folders, its last folder and name, and its name, dotted as in ids; empty where there is none."""
    parts = F.filter(F.split(F.replace(F.regexp_replace(P.trimmed(path), r"\.[^.]*$", ""), F.lit("-"), F.lit("_")), "/"), lambda x: F.lit(True))
    folders = F.array_join(F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != ""), ".")
    stem, folder = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    both = F.when(P.present(folder) & (stem != ""), F.concat(folder, F.lit("."), stem)).otherwise("")
    return folders, both, stem


def qid_holds(qid, names):
    """The id holds one of a file's names."""
    q = F.replace(F.replace(qid, F.lit("-"), F.lit("_")), F.lit("/"), F.lit("."))
    return reduce(lambda x, y: x | y, [(c != "") & F.contains(q, c) for c in names])


def qid_matches_file(qid, path):
    """The id holds the file's folders, its last folder and name, or its name."""
    return qid_holds(qid, file_names(path))


#: Kinds of calls that are resolved precisely.
PRECISE = ("direct_fdef", "type_member")


def _same_path(a: DataFrame, b: DataFrame) -> DataFrame:
    """a x b, rows of distinct _a and _b, of which one ends with the other; both are names of files with an extension."""
    tail = lambda c: F.right(c, F.lit(TAIL))
    return a.withColumn("_tail", tail("_a")).join(b.withColumn("_tail", tail("_b")), "_tail").where(P.either_suffix(F.col("_a"), F.col("_b"))).drop("_tail")


def _targets(calls: DataFrame, entry: DataFrame, file: str, gap: int | None = None) -> DataFrame:
    """seed, file, start_line, end_line: ranges of entry points (distinct _b, file, start_line, end_line, and what else there is to keep) in the callee's range in the file at hand. With ``gap``, and a qid that fits the entry point's file, the nearest where none is in it: within ``gap`` lines after it first.

    Distinct ranges of calls meet distinct ranges of entry points; seeds and entry points, of which many share a range, are no part of it. Only ranges that
    hit nothing are ranked, and calls only where their file is the end of several.
    """
    span, kept = ["callee_start_line", "callee_end_line"], [x for x in entry.columns if x != "_b"]
    place, call = [*span, "file"], ["callee_qid", *span, "_a"]
    c = calls.select("seed", *(call[:1] if gap is not None else []), *span, P.trimmed(F.col(file)).alias("_a"))
    files = _same_path(c.select("_a").distinct(), entry.select("_b").distinct()).join(entry.select("_b", "file").distinct(), "_b")
    names = [n.alias(f"_name{i}") for i, n in enumerate(file_names(F.col("file")))]
    files = written(files.select("_a", "file", (F.count("*").over(Window.partitionBy("_a")) > 1).alias("_many"), *names), "files")
    ranges, c = entry.select(*kept), c.join(files, "_a")
    spans = c.select(*place).distinct()
    over = spans.join(ranges, "file").where(P.overlaps(F.col("start_line"), F.col("end_line"), F.col("callee_start_line"), F.col("callee_end_line")))
    if gap is None:
        return c.join(over, place).select("seed", *kept)
    away = F.least(*(F.abs(F.col(x) - F.col(y)) for x in span for y in ("start_line", "end_line")))
    after = (F.col("start_line") - F.col("callee_end_line")).between(0, gap)
    rank = F.when(after, F.lit(1 << 40)).otherwise(F.lit(2 << 40)) + away
    least = lambda keys: F.min("_rank").over(Window.partitionBy(*keys))
    rest = spans.join(over.select(*place).distinct(), place, "left_anti").join(ranges, "file").withColumn("_rank", rank).withColumn("_least", least(place)).where("_rank = _least").drop("_least")
    near = over.withColumn("_rank", F.lit(0).cast("long")).unionByName(rest)
    c = c.where(qid_holds(F.col("callee_qid"), [F.col(f"_name{i}") for i in range(3)])).select("seed", *call, "file", "_many")
    one, many = c.where("not _many"), c.where("_many")
    best = many.select(*call, "file").distinct().join(near, place).withColumn("_least", least(call)).where("_rank = _least")
    return one.join(near, place).select("seed", *kept).unionByName(many.join(best, [*call, "file"]).select("seed", *kept))


#: Pairs that one task makes, and at most those of one cell, which a task takes whole. A cell's entry points are held at once.
TASK_PAIRS, CELL_PAIRS = 100_000_000, 25_000_000


def _numbered(ranges: DataFrame) -> DataFrame:
    return written(ranges.withColumn("_range", F.monotonically_increasing_id()), "ranges")


def _in_ranges(found: DataFrame, entry: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """seed, ep, file of the entry points that have the ranges found (seed, file, start_line, end_line). Seeds meet entry points by the number of a range: found has it (_range) where ``ranges`` is given, which are numbered and those of all entry points.

    The seeds of a range times its entry points are dealt in cells, these to tasks of a number of pairs, so that neither the input's size nor a range that many
    share decides on a task's work. An entry point with a single row is met once by a seed; only others are made distinct.
    """
    key = ["file", "start_line", "end_line"]
    if ranges is None:
        ranges = _numbered(entry.select(*key).distinct())
        found = found.join(ranges, key)
    met = written(found.select("seed", "_range").distinct(), "met")
    rows = entry.join(ranges.select(*key, "_range"), key).select("_range", "ep", "file")
    sizes = met.groupBy("_range").agg(F.count("*").alias("_n")).join(rows.groupBy("_range").agg(F.count("*").alias("_m")), "_range")
    cells = sizes.select("_range", F.col("_n") * F.col("_m"), F.ceil(F.col("_m") / TASK_ROWS)).toDF("_range", "_pairs", "_parts")  # of entry points
    cells = written(cells.withColumn("_blocks", F.ceil(F.col("_pairs") / F.col("_parts") / CELL_PAIRS)), "cells")  # of seeds
    pairs = cells.agg(F.sum("_pairs")).first()[0] or 0
    several = written(entry.groupBy("ep").count().where("count > 1").select("ep"), "several")
    deal = lambda c, n: F.pmod(F.xxhash64(c), n)
    cell, each = ["_range", "_block", "_part"], lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    tasks, parallel = math.ceil(pairs / TASK_PAIRS), met.sparkSession.sparkContext.defaultParallelism
    dealt = lambda df: df.repartition(tasks, *cell) if tasks > parallel else df
    left = met.join(cells, "_range").select("seed", "_range", deal("seed", F.col("_blocks")).alias("_block"), each("_parts").alias("_part"))

    def hit(own: DataFrame) -> DataFrame:
        right = own.join(cells, "_range").select("ep", "file", "_range", each("_blocks").alias("_block"), deal("ep", F.col("_parts")).alias("_part"))
        return dealt(left).join(dealt(right), cell).where("ep != seed").select("seed", "ep", "file")

    if not several.limit(1).count():
        return hit(rows)
    return hit(rows.join(several, "ep", "left_anti")).unionByName(hit(rows.join(several, "ep", "left_semi")).distinct())


def precise_downstream(facts: FactCatalog, seed_eps: DataFrame, gap: int = 10) -> DataFrame:
    """seed, ep, file: Go entry points that the seeds' precisely resolved calls lead to, in two levels. seed_eps: ep.

    First level: calls on the seed's own lines; entry points in the callee's range in the calling file. A callee's files are those of its id's
    nodes within its range; they make it a parent. Second level: the entry point's calls on a parent's lines; entry points
    in the callee's range in the calling file, and in or nearest to it in the callee's files.

    Calls meet the nodes once, for both levels, and are written with their callees' files.
    """
    rows = facts["entrypoints"]
    calls = facts["callgraph"].where(P.present(F.col("callee_qid")) & (F.col("confidence") >= GENERAL) & F.col("resolution_kind").isin(*PRECISE) & P.present(F.col("call_site_file")) & F.col("callee_start_line").isNotNull() & F.col("callee_end_line").isNotNull())
    calls = calls.select(F.col("ep_id").alias("seed"), P.trimmed(F.col("call_site_file")).alias("_site"), F.coalesce("call_site_line", F.lit(0)).alias("_at"), "callee_qid", "callee_start_line", "callee_end_line")
    own = seed_eps.select(F.col("ep").alias("seed")).distinct().join(rows.select(F.col("id").alias("seed"), P.trimmed(F.coalesce("file", F.lit(""))).alias("_own"), F.coalesce("start_line", F.lit(0)).alias("_from"), F.coalesce("end_line", F.lit(0)).alias("_to")), "seed")
    first = (F.col("_own") == "") | (P.either_suffix(F.col("_own"), F.col("_site")) & F.col("_at").between(F.col("_from"), F.col("_to")))
    calls = calls.join(own, "seed").withColumn("_first", first).withColumn("_key", F.xxhash64("callee_qid")).drop("_own", "_from", "_to")
    nodes = facts["nodes"].where(P.present(F.col("file")) & P.is_go(F.col("file"))).select(F.col("qid").alias("_qid"), F.xxhash64("qid").alias("_hash"), P.trimmed(F.col("file")).alias("callee_file"), F.col("line").alias("_line"))
    located = calls.join(nodes, (F.col("_key") == F.col("_hash")) & (F.col("callee_qid") == F.col("_qid")) & F.col("_line").between(F.col("callee_start_line"), F.col("callee_end_line")), "left")
    calls = written(located.drop("_qid", "_hash", "_line").distinct().drop("_key"), "calls")
    parents = calls.where("_first and callee_file is not null").select("seed", F.col("callee_file").alias("_parent"), F.col("callee_start_line").alias("_from"), F.col("callee_end_line").alias("_to"))
    parents = parents.repartition("seed").distinct()  # both they and the join are by seed
    second = calls.drop("_first").join(parents, "seed").where(P.either_suffix(F.col("_parent"), F.col("_site")) & F.col("_at").between(F.col("_from"), F.col("_to")))
    second = written(second.select("seed", "_site", "callee_qid", "callee_start_line", "callee_end_line", "callee_file").distinct(), "second")
    entry = rows.where(P.present(F.col("file")) & P.is_go(F.col("file"))).select(F.col("id").alias("ep"), "file", F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"), P.trimmed(F.col("file")).alias("_b"))
    ranges = _numbered(entry.select("_b", "file", "start_line", "end_line").distinct())
    own_file = ["seed", "_site", "callee_start_line", "callee_end_line"]
    parts = [_targets(calls.where("_first").select(*own_file).unionByName(second.select(*own_file)), ranges, "_site"), _targets(second.where("callee_file is not null"), ranges, "callee_file", gap)]
    return _in_ranges(reduce(DataFrame.unionByName, parts), entry.drop("_b"), ranges)


def downstream(facts: FactCatalog, seed_eps: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """seed, ep, file: where impact goes on from the seeds that are named functions in Go files. seed_eps: ep.

    What precise calls lead to, but for the ``changed`` seeds (ep) not within files of the seed's name, and what summaries lead to. Facts without precise
    calls fall back, for seeds with neither: a single seed to its neighbour by the fact store's directory expression if that is the only one, where
    there are summaries; else to the entry points with calls in the files of the callees' ids.
    """
    rows = facts["entrypoints"]
    named = seed_eps.select("ep").distinct().join(rows.select(F.col("id").alias("ep"), F.col("ep_id").alias("_label"), F.col("file").alias("_file"), F.col("func_name").alias("_func")), "ep")
    named = named.where(P.is_go(F.col("_file")) & (F.coalesce("_func", F.lit("")) != "undefined") & ~F.endswith(F.coalesce("_label", F.lit("")), F.lit(":undefined")))
    summaries = summary_downstream(facts, named.select("ep")).select("seed", "ep", "file")
    if facts.has("callgraph", "callee_start_line", "callee_end_line", "resolution_kind", "confidence"):
        precise = precise_downstream(facts, named.select("ep"))
        if changed is not None:
            own = named.join(changed.select("ep").distinct(), "ep", "left_semi").select(F.col("ep").alias("seed"), P.trimmed(F.col("_file")).alias("_own"))
            precise = precise.join(own, "seed", "left").where(F.col("_own").isNull() | ~F.endswith(P.trimmed(F.col("file")), F.col("_own"))).drop("_own")
        return precise.unionByName(summaries).distinct()
    rest = named.join(summaries.select(F.col("seed").alias("ep")).distinct(), "ep", "left_anti")
    go = rows.where(P.is_go(F.col("file"))).select(F.col("id").alias("to"), "file")
    if facts.has("callgraph", "caller_func", "callee_fsig", "ep_id") and seed_eps.select("ep").distinct().limit(2).count() == 1:
        near = rest.join(go, (F.col("ep") != F.col("to")) & P.same_directory_quirk(P.trimmed(F.col("file")), P.trimmed(F.col("_file"))))
        only = near.groupBy(F.col("ep").alias("seed")).agg(F.count("*").alias("n"), F.first("to").alias("ep"), F.first("file").alias("file")).where("n = 1")
        return summaries.unionByName(only.drop("n")).distinct()
    calls = facts["callgraph"].where(P.present(F.col("callee_qid")) & F.col("ep_id").isNotNull())
    files = rest.join(calls.select(F.col("ep_id").alias("ep"), F.col("callee_qid").alias("qid")).distinct(), "ep").join(facts["nodes"].where(P.present(F.col("file")) & P.is_go(F.col("file"))).select("qid", P.trimmed(F.col("file")).alias("_a")).distinct(), "qid").select(F.col("ep").alias("seed"), "_a").distinct()
    with_calls = go.join(calls.select(F.col("ep_id").alias("to")).distinct(), "to", "left_semi").withColumn("_b", P.trimmed(F.col("file")))
    pairs = _same_path(files.select("_a").distinct(), with_calls.select("_b").distinct())
    found = files.join(pairs, "_a").join(with_calls, "_b").where("seed != to").select("seed", F.col("to").alias("ep"), "file")
    return summaries.unionByName(found).distinct()


def affected_with_downstream(facts: FactCatalog, changes: DataFrame, kinds=tuple(EVIDENCE)) -> DataFrame:
    """ep, ep_id, file, reasons: ``affected`` and, beside it, where impact goes on from its seeds."""
    found = written(evidence(facts, changes, kinds), "evidence")
    starts = downstream_seeds(found)
    body = found.where("evidence = 'entrypoint_body'").select("ep")
    more = allowed_downstream(found, downstream(facts, starts.where("expands").select("ep"), body))
    single = changes.limit(2).count() == 1
    kept = tightened(found, more) if single else found
    named = kept.join(changes, "change_id").select("ep", F.concat("evidence", F.lit(": "), P.trimmed(F.col("path")), F.lit(":"), "first_line", F.lit("-"), "last_line").alias("reason"))
    labels = facts["entrypoints"].select(F.col("id").alias("seed"), F.coalesce("ep_id", F.lit("")).alias("_label"))
    via = more.join(labels, "seed").select("ep", F.concat(F.lit("downstream_ep_file: "), "_label", F.lit(" -> "), "file").alias("reason"))
    grouped = named.unionByName(via).groupBy("ep").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))
    return grouped.join(facts["entrypoints"].select(F.col("id").alias("ep"), "ep_id", "file"), "ep").select("ep", "ep_id", "file", "reasons")


def evidence_counts(found: DataFrame) -> DataFrame:
    """How many entry points each kind of evidence has."""
    return found.groupBy("evidence").agg(F.countDistinct("ep").alias("n_eps"))


def seeds(found: DataFrame) -> DataFrame:
    """ep, seed: structural, edges_only, or provenance_only, by the strongest evidence an entry point has."""
    level = F.when(F.col("evidence").isin(*STRUCTURAL), 0).when(F.col("evidence") == "edges_one_hop", 1).otherwise(2)
    names = F.array(F.lit("structural"), F.lit("edges_only"), F.lit("provenance_only"))
    return found.groupBy("ep").agg(F.min(level).alias("level")).select("ep", F.element_at(names, F.col("level") + 1).alias("seed"))


def nearest_rows(seed_rows: DataFrame, candidates: DataFrame, reach: int = 10) -> DataFrame:
    """As-of join on lines of a file. seed_rows: seed, file, first, last; candidates: row, file, start, end.

    Rows that overlap the seed; where none does, those that start within ``reach`` lines after it, nearest first; where there are none
    either, those at the least distance. All ties stay.
    """
    j = seed_rows.join(candidates, "file")
    over = P.overlaps(F.col("start"), F.col("end"), F.col("first"), F.col("last"))
    after = F.col("start").between(F.col("last"), F.col("last") + reach)
    level = F.when(over, 0).when(after, 1).otherwise(2)
    distance = F.when(over, 0).when(after, F.col("start") - F.col("last")).otherwise(F.least(F.abs(F.col("start") - F.col("last")), F.abs(F.col("first") - F.col("end"))))
    best = Window.partitionBy("seed").orderBy("level", "distance")
    return j.withColumn("level", level).withColumn("distance", distance).withColumn("r", F.rank().over(best)).where("r = 1").select("seed", "row", "distance")


def merge_by_key(rows: DataFrame, key: str, reason: str) -> DataFrame:
    """One row a key, distinct reasons joined by ``+`` in order."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(reason)), "+").alias("reasons"))
