"""Patterns, guard, traces, incremental operators, taint and the Python front end on small inputs."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tarnhelm.functions import patterns, sqlguard
from tarnhelm.operators import collectors, graph, incremental, taint, trace
from tarnhelm.sources import findings, frontend, rules
from tarnhelm.streaming import snapshots


# Expectations from the rule's statement: pattern, names that match, names that don't.
DOTTED = [
    ("a", "a", "a.a b"), ("a.*.c", "a.b.c a.c.c", "a.c a.b.b.c b.b.c a.b.d"), ("a.**", "a a.b a.b.c", "b b.a"), ("**", "a a.b.c", ""), ("**.**", "a a.b", ""),
    ("**.c", "c a.c a.b.c", "a.b c.c c.d"), ("**.*", "* a.*", "a a.b *.*"), ("a.**.b.*", "a.b.c a.x.b.c a.x.y.b.b", "a.b a.x.b.c.d a.b.c.b.x b.b.c"), ("*.**.a", "x.a a.a x.y.a", "a x.y x.a.a"), ("b.**.c.**", "b.c b.x.c b.x.c.y.z", "b.x c.b.c b"),
]


def test_dotted_patterns(spark):
    df = spark.createDataFrame([(q,) for q in sorted({q for _, a, b in DOTTED for q in f"{a} {b}".split()})], "qid string")
    got = df.select("qid", *(patterns.dotted(F.col("qid"), p).alias(str(i)) for i, (p, _, _) in enumerate(DOTTED))).collect()
    for i, (pattern, yes, no) in enumerate(DOTTED):
        found = {r.qid for r in got if r[i + 1]}
        assert set(yes.split()) <= found and not set(no.split()) & found, pattern


# Signatures that chains match, and don't.
CHAINS = [
    ("id:a", "a", True), ("id:a", "b", False), ("id:b", "a.b", False), ("id:a member:b", "a.b", True), ("id:a member:b", "x.b", False), ("id:a member:b member:c", "b.c", False), ("id:a call:b member:c", "b.c", True), ("id:a call:b member:c", "a.b.c", True), ("id:a member:c", "b.c", False),
    ("call:a member:c", "b.c", False), ("call:a member:c", "a.c", True), ("id:a call:b call:c member:d", "a.b.c.d", True), ("id:a call:b call:c member:d", "b.c.d", True), ("id:a call:b call:c member:d", "x.c.d", False), ("id:q", "**", True), ("id:q member:c", "**.c", True), ("id:a member:bar", "a.b*", True),
    ("id:a call:bar member:c", "b*.c", True), ("call:x member:c", "c", False), ("new:Foo", "Foo", True), ("new:Foo", "*", True), ("id:java member:io new:File", "java.io.File", True), ("id:java member:io new:File", "**.File", True), ("new:File", "java.io.File", False), ("new:A call:B", "A.B", True),
]


def test_chains(spark):
    rows = [(i, [tuple(x.split(":")) for x in c.split()], s.split(".")) for i, (c, s, _) in enumerate(CHAINS)]
    df = spark.createDataFrame(rows, "i int, chain array<struct<kind:string,name:string>>, segments array<string>")
    got = {r.i: r.m for r in df.select("i", patterns.chain_matches(F.col("chain"), F.col("segments")).alias("m")).collect()}
    assert [(c, s) for i, (c, s, e) in enumerate(CHAINS) if got[i] != e] == []


def test_index_rules(spark):
    df = spark.createDataFrame([(4,), (0,)], "n int")
    for rule, expected in (("*", [0, 1, 2, 3]), ("1", [1]), ("0,2", [0, 2]), ("1:3", [1, 2]), ("1:9", [1, 2, 3]), ("0,2:4", [0, 2, 3]), ("7", []), ("x", [])):
        got = df.select(patterns.selected(F.col("n"), rule).alias("s")).collect()
        assert got[0].s == expected and got[1].s == [], rule


@pytest.mark.parametrize("sql", ["DELETE FROM nodes", "SELECT 1; SELECT 2", "WITH c AS (SELECT 1 AS value) VALUES (1)", "SELECT replace(a, 'b', 'c') FROM t", "", "-- only\n"])
def test_guard_rejects(sql):
    with pytest.raises(sqlguard.NotReadOnly):
        sqlguard.validate(sql)


def test_guard_runs(spark):
    spark.range(5).createOrReplaceTempView("guarded")
    assert sqlguard.query(spark, "SELECT id FROM guarded WHERE id > ? -- delete; $x\n;", [2]).count() == 2
    assert sqlguard.query(spark, "WITH a AS (SELECT id FROM guarded) SELECT id, '$v;' AS s FROM a WHERE id = $v", {"v": 3}).first().s == "$v;"
    assert sqlguard.metadata({"run_state": "running", "commit_seq": "4"}) == {"commitSeq": 0, "committedAt": "", "state": "running"}
    with pytest.raises(TypeError):
        sqlguard.query(spark, "SELECT 1", "x")


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,5 +1,6 @@
 keep
-old one
-old two
+new one
+new two
+new three
 keep
 keep
@@ -20,3 +21,2 @@
 keep
-gone
 keep
diff --git a/y.py b/y.py
--- a/y.py
+++ /dev/null
@@ -1,1 +0,0 @@
-all
"""


def test_diff(spark):
    lines = spark.createDataFrame(list(enumerate(DIFF.splitlines())), "n int, text string")
    got = incremental.pair_modified(incremental.coalesce_ranges(incremental.parse_diff(lines))).orderBy("seq").collect()
    assert [tuple(r)[:6] for r in got] == [("x.py", "modified", 2, 4, 2, 3), ("x.py", "deleted", 21, 21, None, None), ("y.py", "deleted", 1, 1, None, None)]


def test_merge_and_remap(spark):
    f = lambda rows: spark.createDataFrame(rows, "rule_id string, entrypoint_key string, result_index int")
    base, head = f([("keep", "k1", 0), ("change-old", "k2", 1), ("gone", "k3", 2)]), f([("change-new", "k2", 0), ("added", "k4", 1)])
    changes = spark.createDataFrame([("modified", "k2"), ("deleted", "k3"), ("added", "k4")], "status string, ep_key string")
    assert [(r.rule_id, r.result_index) for r in incremental.merge_findings(base, head, changes).orderBy("result_index").collect()] == [("keep", 0), ("change-new", 1), ("added", 2)]
    assert tuple(incremental.merge_counts(base, head, changes).first()) == (1, 1, 1, 2)
    odd = changes.union(spark.createDataFrame([("huh", "k9")], "status string, ep_key string"))
    assert sorted(r.rule_id for r in incremental.merge_findings(base, head, odd).collect()) == ["added", "change-new"]
    where = spark.createDataFrame([(i, "a.py", n) for i, n in enumerate((1, 10, 15, 25))], "finding int, file string, line int")
    moved = spark.createDataFrame([("a.py", 10, 20, 10, 12), ("a.py", 5, 4, 5, 6)], "file string, old_start int, old_end int, new_start int, new_end int")
    assert [r.new_line for r in incremental.remap_lines(where, moved).orderBy("finding").collect()] == [1, 10, 12, 19]
    eps = lambda rows: spark.createDataFrame(rows, "file string, func_name string, ep_type string, start_line int, end_line int, attribute string")
    got = incremental.compare_entrypoints(eps([("a", "f", "t", 1, 2, None), ("a", "g", "t", 5, 6, None), ("a", "h", "t", 7, 8, None)]), eps([("a", "f", "t", 1, 2, None), ("a", "g", "t", 9, 10, None), ("b", "n", "t", 1, 2, None)]))
    assert sorted((r.status) for r in got.collect()) == ["added", "deleted", "moved", "same"]
    rows = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("a", "x", 3), ("a", "x", 4)], "k string, ep string, seq int")
    assert sorted(r.seq for r in incremental.insert_or_ignore(rows, ["k", "ep"], "seq").collect()) == [1, 2, 3]


def steps(spark, *traces):
    rows = [(i, p, t, f, n) for i, tr in enumerate(traces) for p, (t, f, n) in enumerate(tr)]
    return spark.createDataFrame(rows, "finding int, pos int, tag string, file string, line int")


def test_traces(spark):
    S, K, C, A, V = "SOURCE: ", "SINK: ", "CALL: ", "ARG PASS: ", "Var Pass: "
    s = steps(spark, [(V, "a", 0), (S, "a", 1), (V, "a", 2), (V, "a", 2), (K, "a", 9), (V, "a", 3)], [(S, "a", 1), (K, "a", 9)], [(S, "b", 1), (A, "b", 2), (K, "b", 3)], [(S, "b", 1), (C, "b", 2), (A, "b", 3), (K, "b", 4)])
    b = trace.bounded(s)
    assert [r.pos for r in b.where("finding = 0").orderBy("pos").collect()] == [1, 2, 3, 4]
    assert trace.drop_adjacent_repeats(b).where("finding = 0").count() == 3
    assert {r.finding: r.valid for r in trace.valid_findings(b).collect()} == {0: True, 1: True, 2: True, 3: True}
    assert [r.finding for r in trace.degenerate(b).collect()] == [1]
    stack = spark.createDataFrame([(3, 0, "b", 1, 10, "b", 2), (3, 1, "b", 3, 4, "b", 2), (3, 2, "z", 1, 2, "b", 4), (3, 3, "y", 1, 2, None, None)], STACK)
    framed = trace.frames(b.where("finding = 3"), stack)
    assert [r.frame for r in framed.orderBy("pos").collect()] == [0, 0, 1, 1]
    assert trace.edge_invariant(framed, stack).first().valid
    assert [(r.tag, r.file, r.line) for r in trace.bridged(framed, stack).orderBy("pos").collect()] == [(S, "b", 1), (C, "b", 2), (A, "b", 3), (C, "b", 4), (A, "z", 1), (A, "y", 1), (K, "b", 4)]
    assert trace.first_pass_per_frame(framed).count() == 4


STACK = "finding int, idx int, file string, start_line int, end_line int, call_file string, call_line int"


def test_segments_and_callstack_order(spark):
    S, K, C, A, V, R, B = "SOURCE: ", "SINK: ", "CALL: ", "ARG PASS: ", "Var Pass: ", "CALL RETURN:", "Return Value: "
    # Frames by line: 0 is 1-99, 1 is 20-60, 2 is 30-40.
    cases = [
        ([(S, 1), (C, 2), (A, 21), (V, 22), (K, 23)], True), ([(S, 1), (C, 2), (A, 21), (V, 70), (K, 70)], True), ([(S, 1), (C, 2), (A, 21), (V, 31), (K, 31)], False), ([(S, 1), (A, 21), (C, 22), (V, 31), (K, 31)], True),
        ([(S, 1), (A, 2), (C, 35), (V, 35), (K, 35)], True), ([(S, 1), (A, 21), (C, 22), (V, 70), (K, 70)], False), ([(S, 1), (A, 21), (C, 22), (R, 70), (K, 70)], True), ([(S, 1), (A, 21), (C, 22), (B, 70), (V, 25), (K, 25)], True),
        ([(S, 1), (A, 21), (C, 22), (B, 70), (A, 25), (K, 25)], False), ([(S, 1), (V, 31), (K, 31)], True), ([(S, 1), (A, 21), (V, 200), (K, 31)], False),
    ]
    table = [(i, p, t, "b", n, None, t == C or t == A, "f9" if i == 0 else "f1") for i, (tr, _) in enumerate(cases) for p, (t, n) in enumerate(tr)]
    steps = spark.createDataFrame(table, "finding int, pos int, tag string, file string, line int, func string, callback boolean, owner string")
    stack = spark.createDataFrame([(i, j, "b", a, z, f"f{j}", None, None) for i in range(len(cases)) for j, (a, z) in enumerate([(1, 99), (20, 60), (30, 40)])], STACK.replace("call_file", "func string, call_file"))
    assert {r.finding: r.valid for r in trace.segments_in_frame(trace.frames(steps, stack)).collect()} == {i: ok for i, (_, ok) in enumerate(cases)}
    ordered = trace.in_callstack_order(steps, stack)
    kept = lambda df, i: [r.pos for r in df.where(f"finding = {i}").orderBy("pos").collect()]
    assert kept(ordered, 0) == [0, 3, 4] and kept(ordered, 1) == [0, 1, 2, 3, 4] and kept(ordered, 10) == [0, 1, 3]  # a foreign callback; all in order; a step in no frame
    assert kept(ordered, 8) == [0, 1, 2, 3, 4, 5]  # the second pass is in the frame before the expected one
    assert kept(trace.in_callstack_order(steps, stack, callee_only=True), 8) == [0, 1, 2, 3, 5]
    final, verdicts = trace.callstack_findings(steps, stack)  # the bridge into frame 2 mends the third case
    reasons = {r.finding: r.reason for r in verdicts.collect()}
    assert reasons[1] is None and reasons[2] is None and reasons[5] == "segment" and final.select("finding").distinct().count() == sum(x is None for x in reasons.values())


def test_unified_qids(spark):
    cases = {
        "/tp/2.func": "tp.2.func", "a.a_scope.<block_1_2>.b": "a.b", "a.a_scope.b": "a.a_scope.b", "x(y(z)w)v": "xv", "x)y(z": "xy", "c<instance_1_endtag>.d<copied_2_endtag>e<cloned_3_endtag>": "c.de", "<global>.packageManager.m.<global>.n": "m.<global>.n",
        "syslib_from.os.path": "os.path", "Egg.Context.q.Egg.Context": "ctx.q.Egg.Context", "NaN_scope.__tmp1.z": "z", "p<object>q": "p<object>q", "<instance_a.b_endtag>": "<instance_a.b_endtag>",
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string").select("q", patterns.unified_qid(F.col("q")).alias("u"))
    assert {r.q: r.u for r in df.collect()} == cases


def test_taint_and_rules(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"checkerIds": ["c1"], "sources": {"FuncCallReturnValueTaintSource": [{"fsig": "req.get", "kind": "IN"}]}, "sinks": {"FuncCallTaintSink": [{"id": "k", "fsig": "exec", "args": [0]}]}, "sanitizers": [{"id": "z", "fsig": "clean", "to": "RET"}]}]')
    table, selectors = rules.load(spark, f"file://{tmp_path}/r.json")
    calls = spark.createDataFrame([(1, 7, "web.req.get", None, 1, 10), (2, 7, "str.join", None, 1, 11), (3, 7, "os.exec", None, 1, 12), (4, 8, "os.exec", None, 1, 22), (5, 7, "x.clean", None, 1, 11)], "call_id long, ep_id long, callee string, callee_type string, n_args int, ret_node long")
    args = spark.createDataFrame([(2, 0, None, 10), (3, 0, None, 11), (4, 0, None, 21), (5, 0, None, 10)], "call_id long, idx int, name string, node long")
    seeds = taint.return_sources(calls, table.where("section = 'sources'"))
    edges = taint.library_edges(calls, args, spark.createDataFrame([], "fsig string, from_kind string, from_index int, to_kind string, to_index int"))
    tainted = taint.propagate(edges, seeds)
    clean = taint.sanitized_nodes(calls, args, table.where("section = 'sanitizers'").select(F.col("rule_id").alias("sanitizer_id"), "fsig", "to"))
    got = taint.findings(tainted, calls, args, table.where("section = 'sinks'"), selectors, clean).collect()
    assert [(r.rule_id, r.tag, r.ep_id, r.call_id, r.sanitizers) for r in got] == [("k", "IN", 7, 3, ["z"])]
    assert rules.of_checkers(table, ["c2"]).count() == 0 and rules.of_checkers(table, ["c1"]).count() == 3


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "b")], "src string, dst string")
    assert {(r.src, r.dst) for r in graph.closure(e).collect()} == {(x, y) for x in "abcd" for y in "abc"}
    assert [(r.target, r.root) for r in graph.reverse_roots(e, spark.createDataFrame([("c",)], "node string")).collect()] == [("c", "d")]
    methods = spark.createDataFrame([("B", "run", 0, ["int"]), ("B", "run", 1, ["str"]), ("C", "run", 0, ["x"]), ("C", "run", 1, ["y"])], "owner string, method string, pos int, param_types array<string>")
    calls = spark.createDataFrame([(1, "A", "run", ["int"])], "call int, type string, method string, arg_types array<string>")
    up = spark.createDataFrame([("A", "B"), ("A", "C")], "super string, sub string")
    assert sorted((r.owner, r.pos) for r in graph.dispatch(calls, up, methods).collect()) == [("B", 0), ("C", 1)]
    assert graph.dot(e).count() == 4


APP = '''
from flask import Flask
from fastapi import APIRouter
router = APIRouter()
app = Flask(__name__)

@router.get("/x")
def read(q): return helper(q)

@app.route("/y")
def page(): return 1

@app.before_request
def check(): pass

@mock.patch("os.x")
def test(): pass

class Base(MethodView): pass
class Mine(Base):
    def get(self): return os.system("x")

def helper(v): return v
'''


def test_front_end(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/app.py").write_text(APP)
    (tmp_path / "src/bad.py").write_text("def (")
    (tmp_path / "src/node_modules/no.py").write_text("x = 1")
    (tmp_path / "src/readme.md").write_text("x")
    files = frontend.scan(spark, f"file://{tmp_path}/src")
    assert files.count() == 2
    nodes, functions, calls = frontend.parse_python(files), frontend.functions(files), frontend.calls(files)
    assert {r.module for r in frontend.imports(nodes).collect()} == {"flask", "fastapi"}
    assert nodes.where("type = 'FunctionDef'").count() == 6 and frontend.closest(nodes, 3).count() == 1
    assigns = spark.createDataFrame([(files.where("file_path like '%app.py'").first().file_path, "router", "fastapi.APIRouter")], "file string, var string, callee string")
    names = lambda df: sorted(r.func_name for r in df.collect())
    assert names(collectors.fastapi(functions, assigns)) == ["read"]
    assert names(collectors.flask_routes(functions)) == ["page", "read"]
    assert names(collectors.flask_hooks(functions)) == ["check"]
    assert names(collectors.flask_views(functions)) == ["get"]
    assert "helper" not in names(collectors.uncalled(functions, calls)) and calls.where("callee = 'os.system'").first().caller == "Mine.get"


def test_findings_and_streams(spark, tmp_path):
    import json

    f = spark.createDataFrame([(1, "r", "error", "m")], "finding int, rule_id string, level string, message string")
    s = spark.createDataFrame([(1, 1, "SINK: ", "b.py", 9, "exec(x)"), (1, 0, "SOURCE: ", "a.py", 2, "x = get()")], "finding int, pos int, tag string, file string, line int, code string")
    result = findings.sarif_results(f, s).first().result
    body = json.loads(result)
    assert [x["location"]["message"]["text"] for x in body["codeFlows"][0]["threadFlows"][0]["locations"]] == ["SOURCE: ", "SINK: "]
    doc = spark.createDataFrame([(json.dumps({"runs": [{"results": [body]}]}),)], "doc string")
    assert tuple(findings.sarif_index(doc).first()) == (0, "r", "b.py", 9)
    frames = spark.createDataFrame([(1, 0, "main", "a", 1), (1, 1, "exec", "a", 2)], "finding int, idx int, function string, file string, line int")
    assert [x["type"] for x in json.loads(findings.call_chains(frames).first().chain)] == [0, 1]
    for i, rows in enumerate(([("k", 1, "old"), ("l", 2, "x")], [("k", 3, "new")])):
        spark.createDataFrame(rows, "key string, seq int, value string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, seq int, value string").parquet(f"{tmp_path}/in")
        snapshots.commits(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert {r.key: r.value for r in snapshots.snapshot(spark, f"{tmp_path}/out", "key").collect()} == {"k": "new", "l": "x"}


def test_rules_by_type_package_invocation_and_callback(spark):
    args = spark.createDataFrame([("r", 1, 0, "java.lang.String"), ("r", 1, 1, "XString"), ("r", 1, 2, None), ("q", 1, 0, "String")], "rule_id string, call_id int, idx int, arg_type string")
    assert sorted((r.rule_id, r.idx) for r in taint.select_args_by_type(args, spark.createDataFrame([("r", "String"), ("q", "String"), ("q", "String")], "rule_id string, wanted string")).collect()) == [("q", 0), ("r", 0)]
    ids = spark.createDataFrame([("app.db.open(x).exec", "app.open.exec", True), ("app.open.exec", "app.open.exec", False), ("a.exec", "a.exec", True), (None, "a", False), ("aexec", "a.exec", False)], "qid string, fsig string, e boolean")
    assert all(bool(r.m) == r.e for r in ids.select("e", taint.package_value_matches(F.col("qid"), F.col("fsig")).alias("m")).collect())
    calls = spark.createDataFrame([(1, "x.run", "run", None), (2, "y.go", "run", "lib.Base"), (3, "z", "run", "lib.Sub"), (4, "a.Type.run", "other", None), (5, "run", "no", None)], "call int, literal string, fsig string, callee_type string")
    sinks = spark.createDataFrame([("plain", "run", None), ("typed", "run", "Base"), ("written", "run", "Type"), ("none", "", None)], "sink_id string, fsig string, callee_type string")
    related = spark.createDataFrame([("lib.Sub", "lib.Base")], "type string, related string")
    assert {(r.call, r.sink_id) for r in taint.invocation_sinks(calls, sinks, related).collect()} == {(1, "plain"), (2, "plain"), (3, "plain"), (5, "plain"), (2, "typed"), (3, "typed"), (4, "written")}
    calls = spark.createDataFrame([(1, "python", "add_task", ["fastapi.BackgroundTasks"]), (2, "python", "add_task", ["other"]), (3, "python", "add_task", ["fastapi.BackgroundTasks"])], "call int, language string, method string, receivers array<string>")
    given = spark.createDataFrame([(1, 0, "position", None, 10), (1, 1, "position", None, 11), (1, 2, "keyword", "k", 12), (2, 0, "position", None, 20), (3, 0, "keyword", "func", 30)], "call int, idx int, kind string, name string, node long")
    models = spark.createDataFrame([("bg", 0, "python", "add_task", ["fastapi.BackgroundTasks"], 2, 0, None, "tail"), ("kw", 1, "python", "add_task", ["fastapi.BackgroundTasks"], None, None, "func", "none")], "model_id string, model_order int, language string, method string, identities array<string>, min_args int, callback_index int, callback_keyword string, mapping string")
    assert {(r.call, r.model_id, r.callback, tuple(tuple(a) for a in r.args)) for r in taint.callback_calls(calls, given, models).collect()} == {(1, "bg", 10, ((0, 11), (1, 12))), (3, "kw", 30, ())}


def test_path_sources(spark):
    members = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (1, "c", 4), (4, "b", 5), (3, "d", 6)], "node long, name string, child long")
    scopes = spark.createDataFrame([("x", 1), ("y", 1), ("z", 1), ("w", 2)], "rule_id string, node long")
    paths = spark.createDataFrame([("x", "X", "a.b"), ("y", "Y", "*.b"), ("z", "Z", "a.**"), ("w", "W", "nothing.b")], "rule_id string, tag string, path string")
    assert {(r.tag, r.node) for r in taint.path_sources(members, scopes, paths).collect()} == {("X", 3), ("Y", 3), ("Y", 5), ("Z", 2), ("Z", 3), ("Z", 6)}


def test_incremental_plans(spark):
    deleted = spark.createDataFrame([(1, "/a.py", 10, 12), (2, "b.py", 1, 2), (3, "c.py", 5, 5)], "change_id int, path string, first_line int, last_line int")
    old = spark.createDataFrame([(1, "a.py", 8, 11), (2, "a.py", 20, 30)], "ep long, file string, start_line int, end_line int")
    found = spark.createDataFrame([("call_site", 1, 1), ("call_site", 2, 2), ("entrypoint_body", 2, 2)], "evidence string, change_id int, ep long")
    bridge = spark.createDataFrame([(2, 2, "Widget")], "change_id int, ep long, class_name string")
    impacted = incremental.impacted_entrypoints(found, bridge)
    got = {tuple(r) for r in incremental.deletion_changes(deleted, old, impacted).collect()}
    assert got == {(1, "deleted", 1, False, "deleted_base_coordinate: a.py:10-12"), (2, "modified", 2, True, "call_site+entrypoint_body+python_class_callgraph_bridge:Widget: b.py:1-2"), (3, "no_ep_impact", None, False, "db_no_ep_fact: c.py:5-5")}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    head, none = frame([("h1",), ("h2",)], "key string"), frame([], "reason string")
    allow = frame([("h1", "body")], "key string, reason string")
    some = frame([("modified",)], "status string")
    rows, full = incremental.final_mode("auto", some, allow, frame([("parse",)], "reason string"), head)
    assert full and {r.key for r in rows.collect()} == {"h1", "h2"}
    assert not incremental.final_mode("ep-only", some, allow, none, head)[1]
    assert not incremental.final_mode("ep-only", frame([("no_ep_impact",)], "status string"), allow.limit(0), none, head)[1]
    for changes, chosen, fallbacks in ((frame([("added",)], "status string"), allow, none), (some, allow.limit(0), none), (some, allow, frame([("x",)], "reason string"))):
        with pytest.raises(incremental.UnsafePlan):
            incremental.final_mode("ep-only", changes, chosen, fallbacks, head)
    uris = {"file:///Base/Src/x.py": "file:///new/x.py", "/base/src": "/new", "base\\src\\y.py": "new/y.py", "base/srcs/z.py": "base/srcs/z.py", "file://base/src/q": "file://new/q"}
    df = spark.createDataFrame([(u,) for u in uris], "u string").select("u", incremental.remapped_root(F.col("u"), "file:///Base/Src/", "/new").alias("v"))
    assert {r.u: r.v for r in df.collect()} == uris
    reasons = incremental.skipped_by_reason(frame([("a",), ("a",), (None,)], "reason string")).collect()
    assert [(r.reason, r.n) for r in reasons] == [("a", 2)]


def test_closure_has_least_depths(spark):
    edges = [(i, (i * 7 + 3) % 23) for i in range(23)] + [(i, i + 1) for i in range(40, 70)] + [(40, 45), (None, 1), (50, 50)]
    df = spark.createDataFrame(edges, "src long, dst long")
    after: dict = {}
    for a, b in edges:
        if a is not None:
            after.setdefault(a, set()).add(b)
    expected = {}
    for a in after:
        level, near = 1, set(after[a])
        while near:
            for b in near:
                expected[a, b] = level
            level += 1
            near = {c for b in near for c in after.get(b, ())} - {b for x, b in expected if x == a}
    got = {(r.src, r.dst): r.depth for r in graph.closure(df).collect()}
    assert got == expected
    assert {(r.src, r.dst): r.depth for r in graph.closure(df, depth=3).collect()} == {k: d for k, d in expected.items() if d <= 3}
    seeds = spark.createDataFrame([(40,), (0,)], "src long")
    assert {(r.src, r.dst): r.depth for r in graph.closure(df, seeds).collect()} == {k: d for k, d in expected.items() if k[0] in (0, 40)}


def test_collectors_of_other_languages(spark):
    sources = collectors.default_sources(spark)
    uses = spark.createDataFrame([(1, "go", "*gin.Context", "return", "Query"), (2, "go", "*url.URL", "return", "Query"), (3, "go", "Other", "return", "Query"), (4, "php", "Anything", "return", "getPost"), (5, "php", None, "field", "_GET"), (6, "javascript", "", "field", "ctx.query"), (7, "php", "X", "return", "readline")], "id int, language string, callee_type string, how string, name string")
    assert sorted(r.id for r in collectors.sourced(uses, sources).collect()) == [1, 2, 4, 5, 6]
    functions = spark.createDataFrame(
        [("a.php", "UserController", ["Base"], "show", ["public"], 2), ("a.php", "UserController", ["Base"], "__get", [], 1), ("a.php", "UserController", ["Base"], "none", [], 0), ("a.php", "UserController", ["Base"], "own", ["Private"], 1), ("b.php", "Mid", ["x\\\\BaseController"], "list", None, 1), ("c.php", "Low", ["Mid"], "edit", None, 1), ("d.php", "Controller", [], "run", None, 1), ("e.php", "UserBucket", [], "get", None, 0)],
        "file string, class_name string, bases array<string>, func_name string, modifiers array<string>, n_params int",
    ).withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(2))
    assert {r.func_name for r in collectors.php_controllers(functions).collect()} == {"show", "list", "edit"}
    assert {r.func_name for r in collectors.php_buckets(functions).collect()} == {"get"}
    routes = spark.createDataFrame([("/r/app/router.js", "get", "controller.api.user.show"), ("/r/app/public/router.js", "get", "controller.x.y"), ("/r/app/router.js", "use", "controller.api.user.edit")], "file string, verb string, action string")
    methods = spark.createDataFrame([("/r/app/controller/api/User.js", "User", "show"), ("/r/app/controller/api/User.js", "User", "edit"), ("/r/app/controller/user.js", "User", "show")], "file string, class_name string, func_name string").withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(2))
    assert [(r.file, r.func_name) for r in collectors.egg_routes(routes, methods).collect()] == [("/app/controller/api/User.js", "show")]
    calls = spark.createDataFrame([("m.go", "pkg.gin.Default()", "GET", ["path", "h.Show"]), ("m.go", "other", "GET", ["h.Edit"])], "file string, receiver string, method string, args array<string>")
    handlers = spark.createDataFrame([("h.go", None, "Show"), ("h.go", None, "Edit")], "file string, class_name string, func_name string").withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(2))
    assert [r.func_name for r in collectors.gin_routes(calls, handlers).collect()] == ["Show"]
    assert [r.func_name for r in collectors.lifespans(handlers, spark.createDataFrame([("h.go", "x.Edit"), ("h.go", None)], "file string, lifespan string")).collect()] == ["Edit"]


def test_closure_of_sources_without_callers(spark):
    """Sources that nothing leads to, with one target or more, one of them on a cycle; none of their pairs takes part in the rounds."""
    from tarnhelm.operators import graph

    ring = [(i, (i + 1) % 5) for i in range(5)]
    outer = [(100 + i, i % 5) for i in range(40)] + [(100, 3), (200, 100)]
    joined = []
    kept, graph.kept = graph.kept, lambda df: joined.append(kept(df)) or joined[-1]
    try:
        got = sorted((r.src, r.dst, r.depth) for r in graph.closure(spark.createDataFrame([*ring, *outer], "src int, dst int")).collect())
    finally:
        graph.kept = kept
    steps: dict[int, set[int]] = {}
    for a, b in [*ring, *outer]:
        steps.setdefault(a, set()).add(b)
    expected = []
    for a in steps:
        seen, front, n = {}, steps[a], 1
        while front:
            seen |= dict.fromkeys(front, n)
            front, n = {y for x in front for y in steps.get(x, ())} - set(seen), n + 1
        expected += [(a, x, d) for x, d in seen.items()]
    assert got == sorted(expected)
    assert max(df.count() for df in joined[1:]) <= 15  # the ring's, and those of 100, which 200 leads to


def test_overloads_by_kind_of_call(spark, monkeypatch):
    """Subtypes without the method make no rows; a call of several rows has one row an owner; no types at all take the first overload."""
    from tarnhelm.operators import types
    from tarnhelm.scratch import written

    calls = spark.createDataFrame([(1, "A", "run", ["int"], False), (2, "A", "run", ["int"], True), (3, "A", "run", None, False), (4, "A", "run", ["int"], False), (4, "B", "run", ["int"], False), (4, "B", "run", ["x", "y"], False), (5, "Z", "run", ["int"], False), (6, None, "run", ["int"], False)], "call int, owner string, method string, arg_types array<string>, via_super boolean")
    methods = spark.createDataFrame([("A", "run", 0, ["x"], False), ("A", "run", 1, ["int"], False), ("B", "run", 0, ["x", "y"], False), ("B", "run", 1, ["lang.int"], False), ("C0", "go", 0, ["int"], False)], "owner string, method string, pos int, param_types array<string>, varargs boolean")
    subs = spark.createDataFrame([("A", "B"), ("A", "A"), *(("A", f"C{i}") for i in range(50))], "super string, sub string")
    got = sorted((r.call, r.owner or "", r.pos, r.resolved) for r in types.resolve(calls, methods, subs).collect())
    assert got == [(1, "A", 1, True), (1, "B", 1, True), (2, "A", 1, True), (3, "A", 0, True), (3, "B", 0, True), (4, "A", 1, True), (4, "B", 0, True), (5, "Z", None, False), (6, "", None, False)]
    made = []
    monkeypatch.setattr(types, "written", lambda df, name: made.append(written(df, name)) or made[-1])
    many = spark.range(200).selectExpr("cast(id as int) as call", "'A' as owner", "'run' as method", "array('int') as arg_types", "false as via_super")
    assert types.resolve(many, methods, subs).where("resolved").count() == 400
    assert made[0].count() == 2


def test_downstream_targets_by_ranges(spark):
    """Calls and entry points that share their ranges meet as ranges, once however many they are; the nearest where none is hit, ties all."""
    from tarnhelm.operators import impact

    calls = spark.range(100).selectExpr("id as seed", "'m.h' as callee_qid", "'/m/h.go' as f", "10 as callee_start_line", "20 as callee_end_line")
    entry = spark.createDataFrame([(1000 + i, "m/h.go", 15, 18, "m/h.go") for i in range(50)] + [(1, "m/h.go", 40, 50, "m/h.go"), (2, "m/h.go", 15, 18, "m/h.go"), (3, "m/h.go", 12, 13, "m/h.go"), (3, "m/h.go", 15, 18, "m/h.go")], "ep long, file string, start_line int, end_line int, _b string")
    ranges = entry.select("_b", "file", "start_line", "end_line").distinct()
    for gap in (None, 10):
        found = impact._targets(calls, ranges, "f", gap)
        assert found.count() == 200
        got = [(r.seed, r.ep) for r in impact._in_ranges(found, entry.drop("_b")).collect()]
        eps = [2, 3, *range(1000, 1050)]
        assert sorted(got) == [(s, e) for s in range(100) for e in eps if s != e]
    far = calls.selectExpr("seed", "callee_qid", "f", "callee_start_line + 12 as callee_start_line", "callee_end_line + 12 as callee_end_line").where("seed = 7")
    assert sorted((r.start_line, r.end_line) for r in impact._targets(far, ranges, "f", 10).collect()) == [(40, 50)]
    tie = far.selectExpr("seed", "callee_qid", "f", "cast(28 as int) as callee_start_line", "cast(30 as int) as callee_end_line")
    assert sorted((r.start_line, r.end_line) for r in impact._targets(tie, ranges, "f", 9).collect()) == [(15, 18), (40, 50)]


def test_downstream_meets_nodes_once(spark, tmp_path, monkeypatch):
    """Nodes are read for one table, the calls with their callees' files; a callee's second file, a call without any and calls on both levels stay."""
    from tarnhelm.operators import impact
    from tarnhelm.scratch import written
    from tarnhelm.sources.catalog import FactCatalog

    read = {}
    monkeypatch.setattr(impact, "written", lambda df, name: read.setdefault(name, []).extend(df.inputFiles()) or written(df, name))
    entries = [(1, "src/a.go", 1, 30), (2, "src/a.go", 40, 45), (3, "lib/b.go", 10, 12), (4, "lib/c.go", 16, 19), (5, "lib/a.go", 90, 99), (6, "/lib/b.go", 80, 80)]
    calls = [(1, "lib.a.F", "src/a.go", 5, 38, 41), (1, "lib.a.F", "src/a.go", 6, 38, 41), (1, "lib.b.G", "lib/a.go", 40, 8, 14), (1, "none.H", "lib/a.go", 41, 92, 93), (1, "lib.c.K", "lib/a.go", 41, 1, 9)]
    nodes = [("lib.a.F", "lib/a.go", 38), ("lib.a.F", "/lib/a.go", 41), ("lib.b.G", "lib/b.go", 8), ("lib.b.G", "lib/x.go", 9), ("lib.c.K", "lib/c.go", 3), ("lib.c.K", "lib/c.go", 4), ("lib.c.K", "lib/c.go", 77)]
    tables = {
        "entrypoints": spark.createDataFrame(entries, "id long, file string, start_line int, end_line int"),
        "callgraph": spark.createDataFrame([(*c, "direct_fdef", 90) for c in calls], "ep_id long, callee_qid string, call_site_file string, call_site_line int, callee_start_line int, callee_end_line int, resolution_kind string, confidence int"),
    }
    spark.createDataFrame(nodes, "qid string, file string, line int").write.parquet(f"{tmp_path}/nodes")
    found = impact.precise_downstream(FactCatalog(spark, tables | {"nodes": spark.read.parquet(f"{tmp_path}/nodes")}), spark.createDataFrame([(1,)], "ep long"))
    assert sorted((r.seed, r.ep, r.file) for r in found.collect()) == [(1, 2, "src/a.go"), (1, 3, "lib/b.go"), (1, 4, "lib/c.go"), (1, 5, "lib/a.go")]
    assert [k for k, files in read.items() if any(f"{tmp_path}/nodes" in f for f in files)] == ["calls"]
    assert not any(f"{tmp_path}/nodes" in f for f in found.inputFiles())


def test_downstream_pairs_in_cells(spark, monkeypatch):
    """A range that many share is several cells, none over its limits, and every pair is in one of them."""
    from tarnhelm.operators import impact
    from tarnhelm.scratch import written

    made = {}
    for name, value in (("written", lambda df, name: made.setdefault(name, written(df, name))), ("TASK_ROWS", 30), ("CELL_PAIRS", 600), ("TASK_PAIRS", 1000)):
        monkeypatch.setattr(impact, name, value)
    entry = spark.createDataFrame([(i, "a.go", 1, 9) for i in range(70)] + [(500, "b.go", 1, 9), (501, "b.go", 1, 9), (501, "c.go", 1, 9)], "ep long, file string, start_line int, end_line int")
    found = spark.range(60).selectExpr("id as seed", "'a.go' as file", "1 as start_line", "9 as end_line").unionByName(spark.createDataFrame([(7, "b.go", 1, 9), (7, "c.go", 1, 9), (7, "c.go", 1, 9)], "seed long, file string, start_line int, end_line int"))
    got = impact._in_ranges(found, entry)
    assert sorted((r.seed, r.ep, r.file) for r in got.collect()) == sorted([(s, e, "a.go") for s in range(60) for e in range(70) if s != e] + [(7, 500, "b.go"), (7, 501, "b.go"), (7, 501, "c.go")])
    assert sorted((r._pairs, r._parts, r._blocks) for r in made["cells"].collect()) == [(1, 1, 1), (2, 1, 1), (4200, 3, 3)]


def test_degenerate_by_sets(spark, monkeypatch):
    """Equal traces are compared once: of 300, two sets; a repeated place makes a longer trace of the same set."""
    from tarnhelm.operators import trace
    from tarnhelm.scratch import written

    made = {}
    monkeypatch.setattr(trace, "written", lambda df, name: made.setdefault(name, written(df, name)))
    walk = lambda f, lines: [(f, i, t, "a", n) for i, (t, n) in enumerate(zip(["SOURCE: ", *["CALL: "] * (len(lines) - 2), "SINK: "], lines))]
    rows = [x for f in range(100) for x in walk(f, [1, 9])] + [x for f in range(100, 200) for x in walk(f, [1, 5, 9])] + [x for f in range(200, 300) for x in walk(f, [1, 6, 5, 9])]
    rows += walk(300, [1, 7, 9]) + walk(301, [1, 7, 7, 9]) + walk(302, [1, 8, 9]) + walk(303, [2, 5, 9])
    got = sorted(r.finding for r in trace.degenerate(spark.createDataFrame(rows, "finding long, pos int, tag string, file string, line int")).collect())
    assert got == [*range(200), 300]
    assert made["sets"].count() == 6


def test_nodes_at_by_ranges(spark, monkeypatch):
    """A loc of several places takes the innermost of all; of equal ranges the last node."""
    from tarnhelm.operators import graph
    from tarnhelm.scratch import written

    made = {}
    monkeypatch.setattr(graph, "written", lambda df, name: made.setdefault(name, written(df, name)))
    nodes = spark.createDataFrame([(1, "a", 1, 90), (2, "a", 10, 50), (3, "a", 10, 50), (9, "a", 10, 60), (4, "b", 5, 6)], "node long, file string, start_line int, end_line int")
    places = spark.createDataFrame([(i, "a", 20, 21) for i in range(100)] + [(200, "a", 2, 3), (200, "a", 12, 13), (201, "b", 5, 6), (202, "b", 5, 7), (203, "a", 55, 61), (204, None, 1, 2)], "loc int, file string, first_line int, last_line int")
    assert {r.loc: r.node for r in graph.nodes_at(places, nodes).collect()} == {**{i: 3 for i in range(100)}, 200: 3, 201: 4, 203: 1}
    assert made["placed"].where("_in != _out").count() == 1


@pytest.mark.parametrize("name", ["s13_single_change", "g18_affected_downstream", "t03_argument_sources", "t10_library_edges", "t13_sanitized_nodes", "t16_findings", "w09_bridges", "t22_callstack_findings", "a04_evidence_counts"])
def test_facts_are_derived_once(spark, name):
    """What the query returns reads written facts, not the tables that they are aggregated or joined from."""
    from tarnhelm.plans import queries

    files = " ".join(queries.queries()[name](spark, "/root/testdata/sf0.001").inputFiles())
    assert not [t for t in ("lineitem", "part.parquet", "events") if f"sf0.001/{t}" in files]


def test_deletions_by_sets_of_ranges(spark, monkeypatch):
    """50 changes and 60 entry points of one place are 3,000 rows, but one pair of sets; the rows are neither sorted nor compared."""
    from tarnhelm.scratch import written

    made = {}
    monkeypatch.setattr(incremental, "written", lambda df, name: made.setdefault((name, len(made)), written(df, name)))
    deleted = [(i, "/a", 10, 20) for i in range(50)] + [(100, "a", 1, 5), (100, "b", 1, 5), (100, "a", 10, 20), (100, "a", 10, 20), (101, None, 1, 9), (102, "c", 1, 9), (None, "a", 10, 20), (103, "a", 90, None)]
    old = [(i, "a", 15, 30) for i in range(60)] + [(200, "a", 3, 12), (200, "b", 5, 6), (201, "d", 1, 2), (None, "b", 1, 1), (202, "a", None, 30), (200, "a", 3, 12)]
    impacted = [(100, 200, "r"), (100, 201, "r"), (100, 201, "r"), (102, 0, "r"), (104, 0, "r"), (0, None, "r"), (None, 201, "r")]
    schemas = ("change_id int, path string, first_line int, last_line int", "ep long, file string, start_line int, end_line int", "change_id int, ep long, reason string")
    got = incremental.deletion_changes(*(spark.createDataFrame(*x) for x in zip((deleted, old, impacted), schemas, strict=True)))
    place = lambda d: None if d[1] is None or d[3] is None else f"{d[1].strip('/')}:{d[2]}-{d[3]}"
    gone = {(d[0], e[0]) for d in deleted for e in old if None not in (d[0], *d[1:], *e[1:]) and d[1].strip("/") == e[1] and e[2] <= d[3] and e[3] >= d[2]}
    text = lambda mark, d: place(d) and mark + place(d)
    want = [(c, "deleted", e, False, text("deleted_base_coordinate: ", d)) for c, e in gone for d in deleted if d[0] == c]
    rest = [(c, e, r, d) for c, e, r in impacted for d in deleted if c is not None and d[0] == c and (e is None or (c, e) not in gone)]
    want += [(c, "modified", e, True, text(f"{r}: ", d)) for c, e, r, d in rest]
    some = {c for c, _ in gone} | {x[0] for x in rest}
    want += [(d[0], "no_ep_impact", None, False, text("db_no_ep_fact: ", d)) for d in deleted if d[0] not in some]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert len(gone) > 3000 and max(df.count() for df in made.values()) < 100
    assert "Aggregate" not in got.where("status = 'deleted'")._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_spread_by_rows(spark, monkeypatch):
    """A task's share of the lines is a number of rows, whatever their bytes; so it is for the pairs that incoming calls are counted from."""
    from tarnhelm import scratch
    from tarnhelm.plans import facts, queries

    monkeypatch.setattr(scratch, "TASK_ROWS", 500)
    at = "/root/testdata/sf0.001"
    parts = -(-spark.read.parquet(f"{at}/lineitem.parquet").count() // 500)
    items = facts.frame(spark, at, "items")
    assert parts > 10 and items.rdd.getNumPartitions() == parts
    plan = queries.queries()["a12_incoming"](spark, at)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(rf"RepartitionByExpression \[callee_qid#\d+, caller_func#\d+\], {parts}", plan)
