"""Golden cases of change impact on a small fact store."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarnhelm.operators import impact
from tarnhelm.sources.catalog import FactCatalog

FILES = {"A": "a.ts", "B": "b.ts", "C": "c.ts", "D": "d.ts", "E": "e.ts", "F": "f.go", "G": "g.go", "H": "h.go", "I": "i.ts", "J": "j.go", "K": "k.go", "L": "l.go", "M": "m.ts", "N": "new.ts", "O": "neighbor.ts", "P": "package_consumer.go", "Q": "package_neighbor.go", "R": "interface_consumer.go"}
NODES = [
    (10, 3, "helper.foo", "src/lib/helper.ts", 50), (11, 5, "unrelated.sameLine", "src/lib/unrelated.ts", 50), (12, 4, "flow.value", "src/lib/flow.ts", 70), (13, 4, "flow.sink", "src/lib/flow.ts", 71), (14, 5, "flow.unrelated", "src/lib/unrelated-flow.ts", 70),
    (15, 6, "seed.value", "src/lib/seed.go", 90), (16, 6, "service.g", "src/routes/g.go", 18), (17, 6, "seed.to_h", "src/routes/h.go", 18), (24, 4, "helper.edgeNoise", "src/lib/helper.ts", 50), (29, 18, "p.call", "src/routes/handler_response.go", 40), (30, 18, "p.return", "src/service/producer.go", 12),
]
CALLS = [(1, 2, "service.fetch", "src/routes/b.ts", 22, None, None), (2, 3, "helper.foo", "src/routes/c.ts", 18, 45, 60), (3, 5, "unrelated.sameLine", "src/routes/e.ts", 18, None, None), (10, 13, "helper.foo", "src/routes/m.ts", 18, 45, 60)]


@pytest.fixture(scope="module")
def facts(spark):
    lines = {"N": (20, 80), "O": (20, 80), "P": (10, 40), "Q": (10, 40), "R": (10, 40)}
    eps = [(i + 1, f"EP_{k}", f"src/routes/{f}", *lines.get(k, (10, 30))) for i, (k, f) in enumerate(FILES.items())]
    t = {
        "entrypoints": spark.createDataFrame(eps, "id long, ep_id string, file string, start_line int, end_line int"),
        "nodes": spark.createDataFrame(NODES, "id long, ep_id long, qid string, file string, line int"),
        "callgraph": spark.createDataFrame(CALLS, "id long, ep_id long, callee_qid string, call_site_file string, call_site_line int, callee_start_line int, callee_end_line int"),
        "builtin_sources": spark.createDataFrame([(1, "EP_A", "src/routes/a.ts", 14)], "id long, ep_id string, file string, line int"),
        "edges": spark.createDataFrame([(1, 4, 12, 13), (2, 5, 14, 11), (3, 6, 15, 16), (4, 6, 15, 17), (8, 4, 24, 13)], "id long, ep_id long, from_node_id long, to_node_id long"),
        "module_deps": spark.createDataFrame([(1, 16, "src/config/config.go", "go_import_package", 100), (2, 17, "src/config/config.go", "go_import_package", 60)], "id long, consumer_ep_id long, imported_file string, dep_kind string, confidence int"),
        "go_interface_bindings": spark.createDataFrame([(1, 18, "src/service/worker.go", 30, 40, "go_interface_dispatch", 90), (2, 17, "src/service/worker.go", 30, 40, "full_callgraph_fallback", 90)], "id long, consumer_ep_id long, impl_method_file string, impl_method_start_line int, impl_method_end_line int, dispatch_kind string, dispatch_confidence int"),
        "handler_response_flow_facts": spark.createDataFrame([(1, 18, 29, 30, "producer_before_receiver_before_payload", 90), (2, 6, 15, None, "producer_before_receiver_before_payload", 90)], "id long, consumer_ep_id long, producer_call_node_id long, producer_return_node_id long, ordering_kind string, confidence int"),
    }
    return FactCatalog(spark, t)


def found(spark, facts, *changes):
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(changes)], "change_id int, path string, first_line int, last_line int")
    return {r.ep_id: r.reasons for r in impact.affected(facts, c).collect()}


@pytest.mark.parametrize(
    ("change", "eps", "reason"),
    [
        (("src/routes/a.ts", 15, 15), "A", "entrypoint_body: "),
        (("/src/routes/b.ts", 22, 22), "B", "call_site: "),
        (("src/lib/helper.ts", 50, 50), "CDM", "callee_qid: "),
        (("src/lib/helper.ts", 52, 52), "CM", "callee_qid: "),
        (("src/routes/a.ts", 14, 14), "A", "builtin_sources: "),
        (("src/lib/flow.ts", 70, 70), "D", "edges_one_hop: "),
        (("src/lib/seed.go", 90, 90), "F", "handler_response_flow: "),
        (("src/config/config.go", 30, 81), "P", "module_deps: "),
        (("src/service/worker.go", 33, 33), "R", "go_interface_dispatch: "),
        (("src/routes/handler_response.go", 40, 40), "R", "handler_response_flow: "),
        (("src/none.ts", 1, 9), "", ""),
    ],
)
def test_single_changes(spark, facts, change, eps, reason):
    got = found(spark, facts, change)
    assert sorted(got) == [f"EP_{k}" for k in eps]
    assert not eps or any(reason in r for r in got.values())


def test_absent_tables_degrade(spark, facts):
    fewer = FactCatalog(spark, {k: v for k, v in facts.tables.items() if k != "module_deps"})
    assert found(spark, fewer, ("src/config/config.go", 30, 81)) == {}


@pytest.mark.parametrize(("with_table", "ids", "eps"), [(True, ("SYM-WANT", "SYM-DUP"), ["EP_GT"]), (False, ("SYM-WANT", "SYM-DUP"), ["EP_FP", "EP_GT"]), (True, (None, None), ["EP_FP", "EP_GT"])])
def test_symbol_precision(spark, with_table, ids, eps):
    t = {
        "entrypoints": spark.createDataFrame([(1, "EP_GT", "src/routes/want.go", 10, 30), (2, "EP_FP", "src/routes/dup.go", 10, 30)], "id long, ep_id string, file string, start_line int, end_line int"),
        "nodes": spark.createDataFrame([(10, 1, "pkg.DoSomething", "src/lib/want.go", 50), (11, 2, "pkg.DoSomething", "src/lib/dup.go", 60)], "id long, ep_id long, qid string, file string, line int"),
        "callgraph": spark.createDataFrame([(1, 1, "pkg.DoSomething", "src/routes/want.go", 18, 50, 55, ids[0]), (2, 2, "pkg.DoSomething", "src/routes/dup.go", 18, 60, 65, ids[1])], "id long, ep_id long, callee_qid string, call_site_file string, call_site_line int, callee_start_line int, callee_end_line int, callee_symbol_id string"),
    }
    if with_table:
        t["symbols"] = spark.createDataFrame([("SYM-WANT", "pkg.DoSomething", "src/lib/want.go", 50, 55), ("SYM-DUP", "pkg.DoSomething", "src/lib/dup.go", 60, 65)], "symbol_id string, qid string, file string, start_line int, end_line int")
    c = spark.createDataFrame([(1, "src/lib/want.go", 50, 50)], "change_id int, path string, first_line int, last_line int")
    kinds = ("callee_qid",)
    assert sorted(r.ep_id for r in impact.affected(FactCatalog(spark, t), c, kinds).collect()) == eps


GRAPH = "id long, ep_id long, callee_qid string, call_site_file string, call_site_line int, callee_start_line int, callee_end_line int, resolution_kind string, confidence int"


def test_precise_downstream(spark):
    """Seed 1 calls lib.a on its own lines; lib.a's lines hold the second call, to lib.b, whose file has an entry point nearby."""
    entries = [(1, "S", "src/seed.go", "fn", 10, 30), (2, "T", "src/seed.go", "fn", 52, 58), (3, "U", "lib/b.go", "fn", 68, 80), (4, "V", "lib/b.go", "fn", 200, 220), (5, "W", "lib/a.go", "fn", 1, 3), (6, "X", "lib/a.ts", "fn", 40, 60), (7, "Y", "src/named.go", "undefined", 1, 9)]
    calls = [(1, 1, "lib.a.Run", "src/seed.go", 12, 50, 55, "direct_fdef", 90), (2, 1, "lib.b.Run", "/lib/a.go", 52, 60, 64, "type_member", 70), (3, 1, "lib.c.Run", "lib/a.go", 52, 60, 64, "type_member", 69), (4, 1, "lib.b.Run", "lib/a.go", 99, 60, 64, "direct_fdef", 90)]
    nodes = [(1, 1, "lib.a.Run", "lib/a.go", 51), (2, 1, "lib.b.Run", "lib/b.go", 61), (3, 1, "lib.b.Run", "lib/b.go", 99)]
    t = {"entrypoints": spark.createDataFrame(entries, "id long, ep_id string, file string, func_name string, start_line int, end_line int"), "callgraph": spark.createDataFrame(calls, GRAPH), "nodes": spark.createDataFrame(nodes, "id long, ep_id long, qid string, file string, line int")}
    got = lambda f: {(r.seed, r.ep) for r in f.collect()}
    seeds = spark.createDataFrame([(1,), (7,)], "ep long")
    facts = FactCatalog(spark, t)
    assert got(impact.precise_downstream(facts, seeds)) == {(1, 2), (1, 3)}  # T is in lib.a's range in the calling file; U starts within 10 lines after lib.b's
    assert got(impact.downstream(facts, seeds)) == {(1, 2), (1, 3)}
    assert got(impact.downstream(facts, seeds, changed=seeds)) == {(1, 3)}  # not within the seed's own file
    change = spark.createDataFrame([(1, "src/seed.go", 11, 12)], "change_id int, path string, first_line int, last_line int")
    whole = {r.ep_id: r.reasons for r in impact.affected_with_downstream(facts, change, ("entrypoint_body", "call_site")).collect()}
    assert whole == {"S": "call_site: src/seed.go:11-12; entrypoint_body: src/seed.go:11-12", "U": "downstream_ep_file: S -> lib/b.go"}


def test_paths_meet_by_their_end_or_by_wildcards(spark):
    files = spark.createDataFrame([(f,) for f in ("src/data.ts", "/src/A.TS", "x.go", "a_b.go", "axb.go", ".go")], "_file string")
    changes = spark.createDataFrame([(1, "a.ts", 1, 2), (2, "/a_b.go", 1, 2), (3, "go", 1, 2), (4, "data.ts", 1, 2)], "change_id int, path string, first_line int, last_line int")
    got = sorted((r.change_id, r._file) for r in impact.matched_paths(files, changes).collect())
    assert got == [(1, "/src/A.TS"), (1, "src/data.ts"), (2, "a_b.go"), (2, "axb.go"), (3, ".go"), (3, "a_b.go"), (3, "axb.go"), (3, "x.go"), (4, "src/data.ts")]


def test_qid_matches_file(spark):
    df = spark.createDataFrame([("svc.lib.a.Run", "lib/a.go", True), ("x.y", "src/lib/y.go", True), ("svc.my_lib.Run", "src/my-lib/z.go", False), ("src.my_lib.Run", "src/my-lib/z.go", True), ("q", "p.go", False), ("q", "q", True)], "q string, f string, e boolean")
    assert all(r.e == r.m for r in df.select("e", impact.qid_matches_file(F.col("q"), F.col("f")).alias("m")).collect())


def test_class_bridge(spark):
    t = {
        "symbols": spark.createDataFrame([("Widget", "class", "lib/w.py", 10, 30), ("get", "class", "lib/w.py", 10, 30), ("Other", "fclos", "lib/w.py", 10, 30)], "sid string, vtype string, file string, start_line int, end_line int"),
        "callgraph": spark.createDataFrame([(1, "lib.Widget.run", None), (2, "x", "lib.Widget.init"), (3, "get.Other", None), (None, "Widget", None)], "ep_id long, callee_qid string, caller_qid string"),
    }
    change = spark.createDataFrame([(7, "w.py", 12, 12)], "change_id int, path string, first_line int, last_line int")
    assert {tuple(r) for r in impact.class_bridge(FactCatalog(spark, t), change).collect()} == {(7, 1, "Widget"), (7, 2, "Widget")}
