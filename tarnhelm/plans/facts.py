"""Fact tables derived from the star-schema tables, by definitions that Spark SQL and DuckDB both read.

The derived tables stand in for an analysis run's output: orders are entry points, line items are nodes and edges,
parts give call-graph attributes, events are trace steps, documents are source files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..scratch import spread

#: The definitions, in the order in which they build on each other. ``{x}`` is a table or an earlier definition.
DEFINITIONS: dict[str, str] = {
    "entrypoints": """SELECT o_orderkey AS id, concat('ep-', o_orderkey) AS ep_id,
        concat('src/m', o_custkey % 40, '/h', o_orderkey % 97, CASE WHEN o_orderkey % 2 = 0 THEN '.go' ELSE '.ts' END) AS file,
        concat('fn', o_orderkey % 31) AS func_name, CAST((o_orderkey % 50) * 10 + 1 AS INT) AS start_line, CAST((o_orderkey % 50) * 10 + 10 AS INT) AS end_line,
        o_orderstatus AS ep_type, o_orderpriority AS framework, concat('a', o_custkey % 5) AS attribute FROM {orders}""",
    "items": """SELECT l_orderkey AS ok, l_linenumber AS ln, min(l_partkey) AS pk, min(l_suppkey) AS sk FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "nodes": """SELECT ok * 8 + ln AS id, ok AS ep_id, concat('src/m', sk % 40, '/h', pk % 97, '.go') AS file, CAST(pk % 500 AS INT) AS line, CAST(ln AS INT) AS col,
        concat('svc.s', sk, '.p', pk % 100) AS qid FROM {items}""",
    "edges": """SELECT * FROM (SELECT id AS from_node_id, lead(id) OVER (PARTITION BY ep_id ORDER BY id) AS to_node_id,
        CASE id % 3 WHEN 0 THEN 'assign' WHEN 1 THEN 'arg_to_param' ELSE 'return' END AS edge_type, ep_id FROM {nodes}) e WHERE to_node_id IS NOT NULL""",
    "callgraph": """SELECT i.ok * 8 + i.ln AS id, i.ok AS ep_id, concat('fn', i.ok % 31) AS caller_func, concat('svc.s', i.sk, '.p', i.pk % 100) AS callee_qid,
        concat('src/m', i.sk % 40, '/h', i.pk % 97, '.go') AS call_site_file, CAST(i.pk % 500 AS INT) AS call_site_line, CAST((p.p_size * 7) % 500 AS INT) AS callee_start_line,
        CAST((p.p_size * 7) % 500 + 20 AS INT) AS callee_end_line, CAST(50 + p.p_size AS INT) AS confidence, p.p_type AS resolution_kind FROM {items} i JOIN {part} p ON p.p_partkey = i.pk""",
    "builtin_sources": """SELECT ok * 8 + ln AS id, concat('ep-', ok) AS ep_id, concat('src/m', sk % 40, '/h', pk % 97, '.go') AS file, CAST(pk % 500 AS INT) AS line FROM {items}""",
    "module_deps": """SELECT c_custkey AS id, c_custkey AS consumer_ep_id, concat('src/m', c_custkey % 40, '/h', c_nationkey, '.go') AS imported_file, CAST(50 + c_custkey % 51 AS INT) AS confidence,
        CASE c_custkey % 2 WHEN 0 THEN 'go_import_package' ELSE 'ts_import' END AS dep_kind FROM {customer}""",
    "class_edges": """SELECT concat('C', c_custkey) AS sub, concat('N', c_nationkey) AS super FROM {customer} UNION ALL SELECT concat('S', s_suppkey), concat('N', s_nationkey) FROM {supplier}
        UNION ALL SELECT concat('N', n_nationkey), concat('R', n_regionkey) FROM {nation}""",
    "steps": """SELECT user_id AS finding, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS pos,
        CASE event_type WHEN 'signup' THEN 'SOURCE: ' WHEN 'click' THEN 'CALL: ' WHEN 'view' THEN 'ARG PASS: ' WHEN 'purchase' THEN 'SINK: ' ELSE 'Var Pass: ' END AS tag,
        concat('f', event_id % 7, '.py') AS file, CAST(event_id % 100 AS INT) AS line FROM {events}""",
    "traces": """SELECT user_id * 100000 + r - r % 5 AS finding, CAST(r % 5 + 1 AS INT) AS pos,
        CASE WHEN r % 5 = 0 AND event_id % 10 < 9 THEN 'SOURCE: ' WHEN event_type = 'purchase' OR r % 5 = 4 AND event_id % 10 < 8 THEN 'SINK: ' WHEN event_type = 'click' THEN 'CALL: ' WHEN event_type = 'view' THEN 'ARG PASS: '
        WHEN event_id % 3 = 0 THEN 'CALL RETURN:' WHEN event_id % 3 = 1 THEN 'Return Value: ' ELSE 'Var Pass: ' END AS tag,
        concat('f', user_id % 3, '.py') AS file, CAST(event_id % 4 * 25 AS INT) AS line, CASE WHEN event_id % 9 = 0 THEN concat('fn', event_id % 4) END AS func, event_id % 3 > 0 AS callback, concat('fn', user_id % 4) AS owner
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM {events}) e""",
    "stacks": """SELECT DISTINCT t.finding, i.idx, t.file, CAST(25 * i.idx AS INT) AS start_line, CAST(CASE i.idx WHEN 0 THEN 99 WHEN 1 THEN 75 ELSE 60 END AS INT) AS end_line, concat('fn', i.idx) AS func,
        CASE WHEN i.idx > 0 THEN t.file END AS call_file, CAST(25 * i.idx - 20 AS INT) AS call_line FROM {traces} t CROSS JOIN (SELECT CAST(n_nationkey AS INT) AS idx FROM {nation} WHERE n_nationkey < 3) i WHERE i.idx < 2 OR t.finding % 2 = 0""",
    "deep_nodes": """SELECT id, ep_id, concat(qid, '.', replace(split_part(file, '/', 3), '.go', '')) AS qid, file, line FROM {nodes}""",
    "deep_calls": """SELECT id, ep_id, qid AS callee_qid, CASE WHEN id % 4 < 2 THEN ef ELSE coalesce(pf, file) END AS call_site_file, CAST(CASE WHEN id % 4 < 2 THEN es + id % 10 ELSE coalesce(pl, line) + 1 END AS INT) AS call_site_line,
        CAST(greatest(line - 10, 0) AS INT) AS callee_start_line, CAST(line + 10 AS INT) AS callee_end_line, CAST(50 + id % 51 AS INT) AS confidence, CASE id % 7 WHEN 0 THEN 'dynamic' WHEN 1 THEN 'type_member' ELSE 'direct_fdef' END AS resolution_kind
        FROM (SELECT n.id, n.ep_id, n.qid, n.file, n.line, e.file AS ef, e.start_line AS es, lag(n.file) OVER (PARTITION BY n.ep_id ORDER BY n.id) AS pf, lag(n.line) OVER (PARTITION BY n.ep_id ORDER BY n.id) AS pl FROM {deep_nodes} n JOIN {entrypoints} e ON e.id = n.ep_id) x""",
    "calls": """SELECT id AS call_id, ep_id, callee_qid AS callee, resolution_kind AS callee_type, CAST(2 AS INT) AS n_args, id * 10 AS ret_node FROM {callgraph}""",
    "call_args": """SELECT call_id, CAST(-1 AS INT) AS idx, CAST(NULL AS STRING) AS name, call_id * 10 + 1 AS node FROM {calls} UNION ALL SELECT call_id, CAST(0 AS INT), NULL, call_id * 10 + 2 FROM {calls}
        UNION ALL SELECT call_id, CAST(1 AS INT), CASE WHEN call_id % 2 = 0 THEN 'data' END, call_id * 10 + 3 FROM {calls} WHERE call_id % 5 > 0""",
    "go_interface_bindings": """SELECT c_custkey AS id, c_custkey * 3 AS consumer_ep_id, concat('src/m', c_custkey % 40, '/h', c_custkey % 97, '.go') AS impl_method_file, CAST(c_custkey % 300 + 1 AS INT) AS impl_method_start_line, CAST(c_custkey % 300 + 40 AS INT) AS impl_method_end_line,
        CASE c_custkey % 5 WHEN 0 THEN 'full_callgraph_fallback' ELSE 'go_interface_dispatch' END AS dispatch_kind, CAST(50 + c_custkey % 51 AS INT) AS dispatch_confidence FROM {customer}""",
    "handler_response_flow_facts": """SELECT c_custkey AS id, c_custkey * 3 AS consumer_ep_id, c_custkey * 8 + 1 AS producer_call_node_id, c_custkey * 8 + 2 AS producer_return_node_id, CAST(NULL AS BIGINT) AS receiver_node_id, c_custkey * 16 + 1 AS payload_node_id,
        CASE c_custkey % 4 WHEN 0 THEN 'unordered' ELSE 'producer_before_receiver_before_payload' END AS ordering_kind, CAST(50 + c_custkey % 51 AS INT) AS confidence FROM {customer}""",
    "mutating_receiver_alias": """SELECT s_suppkey AS id, s_suppkey * 7 AS consumer_ep_id, concat('src/m', s_suppkey % 13, '/h', s_suppkey % 21, '.go') AS call_site_file, CAST(s_suppkey * 3 % 300 AS INT) AS call_site_line, CAST(50 + s_suppkey % 51 AS INT) AS confidence FROM {supplier}""",
    "decl_use_impact_edges": """SELECT p_partkey AS id, p_partkey * 2 AS consumer_ep_id, concat('src/m', p_partkey % 40, '/h', p_partkey % 97, '.go') AS changed_file, CAST(p_partkey % 400 AS INT) AS changed_start_line, CAST(p_partkey % 400 + 30 AS INT) AS changed_end_line, CAST(50 + p_partkey % 51 AS INT) AS confidence FROM {part}""",
    "source_files": """SELECT concat(source, '/', doc_id, '.txt') AS file_path, text AS content FROM {documents}""",
    "wide_changes": """SELECT CAST(n_nationkey + 100 AS INT) AS change_id, concat('/h', n_nationkey, '.go') AS path, CAST(1 AS INT) AS first_line, CAST(250 AS INT) AS last_line FROM {nation}""",
    "changes": """SELECT * FROM (VALUES (1, 'm3/h11.go', 1, 60), (2, '/src/m7/h20.go', 100, 240), (3, 'm12/h40.ts', 1, 500), (4, 'M5/H33.GO', 30, 90), (5, 'h50.go', 200, 230), (6, 'src/m0/h0.go', 0, 499),
        (7, 'm9/h77.ts', 241, 250), (8, 'none/such.go', 1, 9)) AS c(change_id, path, first_line, last_line)""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _needs(sql: str) -> list[str]:
    return [x for x in (*DEFINITIONS, *TABLES) if "{" + x + "}" in sql]


def frame(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table, or a derived fact table, as a DataFrame."""
    made = {} if made is None else made
    if name not in made:
        if name in DEFINITIONS:
            needs = {x: frame(spark, sf_dir, x, made) for x in _needs(DEFINITIONS[name])}
            if name == "items":  # lines are hardly ever repeated: combining them before the shuffle takes memory by the split and saves nothing
                needs["lineitem"] = spread(needs["lineitem"], needs["lineitem"].count(), "l_orderkey")
            made[name] = spark.sql(DEFINITIONS[name], **needs)
        else:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return made[name]


def oracle(sql: str) -> str:
    """``sql`` over ``{names}`` with the definitions that it needs before it."""
    order: list[str] = []

    def add(text: str) -> None:
        for x in _needs(text):
            if x in DEFINITIONS and x not in order:
                add(DEFINITIONS[x])
                order.append(x)

    add(sql)
    plain = {x: x for x in (*DEFINITIONS, *TABLES)}
    parts = [f"{x} AS ({DEFINITIONS[x].format(**plain)})" for x in order]
    body = sql.format(**plain)
    if not parts:
        return body
    head = "WITH RECURSIVE " if body.lstrip().upper().startswith("WITH RECURSIVE") else "WITH "
    if body.lstrip().upper().startswith("WITH"):
        body = body.lstrip()[len(head if head != "WITH " else "WITH ") :]
        return head + ", ".join(parts) + ", " + body
    return head + ", ".join(parts) + " " + body
