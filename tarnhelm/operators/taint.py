"""Taint flow as joins: rules mark sources, edges carry tags within an entry point, sanitizers annotate, sinks make findings.

Tables: nodes (id, ep_id, ...), edges (from_node_id, to_node_id, ep_id, edge_type), calls (call_id, ep_id, callee, callee_type, chain, ret_node),
call_args (call_id, idx, name, node). Signatures meet calls by equality, regexes are broadcast up to a bound; every reachability key holds the entry point, so
no tag crosses to another one. Flow is insensitive to order within a function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..scratch import written
from . import graph

#: Edges that carry taint only from a tainted end, which is what following them from the seeds does.
BUFFERED = ("merge", "union_compose")


def recorded_edges(edges: DataFrame, tainted: DataFrame) -> DataFrame:
    """What a writer keeps: no self edges, one of equal (from, to, type, entry point), and merges only from tainted nodes (node)."""
    plain = edges.where(F.col("from_node_id") != F.col("to_node_id")).dropDuplicates(["from_node_id", "to_node_id", "edge_type", "ep_id"])
    merges = F.col("edge_type").isin(*BUFFERED)
    return plain.where(~merges).unionByName(plain.where(merges).join(tainted.select(F.col("node").alias("from_node_id")).distinct(), "from_node_id", "left_semi"))


def type_matches(declared: Column, wanted: Column) -> Column:
    """No wanted type, the same, or its last segments."""
    return wanted.isNull() | (wanted == "") | (wanted == "*") | (declared == wanted) | F.endswith(declared, F.concat(F.lit("."), wanted))


#: Rules with a regex that are broadcast at most; more are joined as Spark sees fit.
REGEX_RULES = 10_000


def by_signature(calls: DataFrame, rules: DataFrame, fsig: str = "fsig") -> DataFrame:
    """calls x rules whose signature is the callee or its last segments: the callee's ends, a dozen at most, meet signatures by equality."""
    parts = F.split("callee", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    r = rules.where(F.col(fsig).isNotNull() & (F.col(fsig) != "")).withColumnRenamed(fsig, "_fsig")
    return calls.withColumn("_end", F.explode(ends)).join(r, F.col("_end") == F.col("_fsig")).drop("_end", "_fsig")


def match_calls(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """calls x rules by signature (fsig) or regex (fregex), callee type and argument number; the rule that comes first stays. Rules: rule_id, rule_order, fsig, fregex, callee_type, arg_num."""
    r = rules.select("rule_id", "rule_order", "fsig", "fregex", F.col("callee_type").alias("wanted_type"), "arg_num", "kind")
    regex = r.where("fregex is not null").drop("fsig")
    few = regex.limit(REGEX_RULES + 1).count() <= REGEX_RULES
    by_regex = calls.join(F.broadcast(regex) if few else regex, F.rlike("callee", F.col("fregex")))
    fit = by_signature(calls, r.drop("fregex")).unionByName(by_regex.drop("fregex"))
    fit = fit.where(type_matches(F.col("callee_type"), F.col("wanted_type")) & (F.col("arg_num").isNull() | (F.col("arg_num") == F.col("n_args"))))
    first = fit.groupBy("call_id").agg(F.min_by(F.struct(*calls.columns, "rule_id", "kind"), F.struct("rule_order", "rule_id")).alias("m"))
    return first.select("m.*")


def select_args(call_args: DataFrame, selectors: DataFrame) -> DataFrame:
    """call_args x selectors of their rule: position, keyword, receiver (-1), or all but the receiver. One row a (call, node)."""
    a = call_args.join(selectors, "rule_id")
    hit = ((F.col("sel_type") == "all") & (F.col("idx") >= 0)) | (F.col("sel_type").isin("position", "receiver") & (F.col("idx") == F.col("sel_index"))) | ((F.col("sel_type") == "keyword") & (F.col("name") == F.col("sel_name")))
    return a.where(hit).select(*call_args.columns).distinct()


def select_args_by_type(call_args: DataFrame, arg_types: DataFrame) -> DataFrame:
    """call_args (rule_id, arg_type, ...) whose definite type is one of their rule's, or ends in it. arg_types: rule_id, wanted. One row an argument."""
    a = call_args.where(P.present(F.col("arg_type"))).join(arg_types, "rule_id")
    fits = (F.col("arg_type") == F.col("wanted")) | F.endswith("arg_type", F.concat(F.lit("."), F.col("wanted")))
    return a.where(fits).select(*call_args.columns).distinct()


def package_value_matches(qid: Column, fsig: Column) -> Column:
    """All parts of the dotted signature stand in the id: the first before a dot, inner ones as calls, the last after a dot."""
    parts = F.split(fsig, r"\.")
    last = F.size(parts) - 1
    mark = lambda x, i: F.when(i == 0, F.concat(x, F.lit("."))).when(i == last, F.concat(F.lit("."), x)).otherwise(F.concat(F.lit("."), x, F.lit("(")))
    return P.present(qid) & F.forall(F.transform(parts, mark), lambda x: F.contains(qid, x))


def invocation_sinks(invocations: DataFrame, sinks: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """call, sink_id. invocations: call, literal, fsig, callee_type; sinks: sink_id, fsig, callee_type; hierarchy: type, related (its base and sub types).

    Without a type, the written call or the signature is the sink's. With one, the signature is the same and the callee's type or a related one is the
    sink's or ends in it, or the written call ends in type and signature. Each alternative is an equi-join.
    """
    k = sinks.where(P.present(F.col("fsig"))).select("sink_id", F.col("fsig").alias("_fsig"), F.col("callee_type").alias("_type"))
    plain, typed = k.where(~F.coalesce(P.present(F.col("_type")), F.lit(False))), k.where(P.present(F.col("_type")))
    out = [invocations.join(plain, F.col(c) == F.col("_fsig")).select("call", "sink_id") for c in ("literal", "fsig")]
    own = invocations.where(P.present(F.col("callee_type"))).select("call", "fsig", F.col("callee_type").alias("type"))
    types = own.unionByName(own.join(hierarchy, "type").select("call", "fsig", F.col("related").alias("type"))).distinct()
    out.append(types.join(typed, F.col("fsig") == F.col("_fsig")).where((F.col("type") == F.col("_type")) | F.endswith("type", F.concat(F.lit("."), F.col("_type")))).select("call", "sink_id"))
    written_ = typed.select("sink_id", F.concat("_type", F.lit("."), "_fsig").alias("fsig"))
    out.append(by_signature(invocations.select("call", F.col("literal").alias("callee")).where("callee is not null"), written_).select("call", "sink_id"))
    return out[0].union(out[1]).union(out[2]).union(out[3]).distinct()


def callback_calls(calls: DataFrame, args: DataFrame, models: DataFrame) -> DataFrame:
    """call, model_id, callback (the argument that is called), args (those after it, numbered anew, if the model passes the tail on).

    calls: call, language, method, receivers (identities); args: call, idx, kind, name, node; models: model_id, model_order, language, method, identities,
    min_args, callback_index, callback_keyword, mapping. The first model that fits counts.
    """
    held = args.groupBy("call").agg(F.array_sort(F.collect_list(F.struct("idx", "kind", "name", "node"))).alias("args"))  # one call's
    j = calls.join(held, "call").join(models, ["language", "method"])
    picked = F.filter("args", lambda a: F.when(F.col("callback_index").isNotNull(), a["idx"] == F.col("callback_index")).otherwise((a["kind"] == "keyword") & (a["name"] == F.col("callback_keyword"))))
    j = j.withColumn("callback", F.try_element_at(picked, F.lit(1))).where((F.size("args") >= F.coalesce("min_args", F.lit(1))) & F.arrays_overlap("receivers", "identities") & F.col("callback").isNotNull())
    tail = F.transform(F.filter("args", lambda a: a["idx"] > F.col("callback.idx")), lambda a, i: F.struct(i.alias("idx"), a["node"].alias("node")))
    j = j.withColumn("args", F.when(F.col("mapping") == "tail", tail).otherwise(F.expr("cast(array() as array<struct<idx:int,node:bigint>>)")))
    best = j.groupBy("call").agg(F.min_by(F.struct("model_id", F.col("callback.node").alias("callback"), "args"), F.struct("model_order", "model_id")).alias("m"))
    return best.select("call", "m.*")


def path_sources(members: DataFrame, scopes: DataFrame, paths: DataFrame) -> DataFrame:
    """tag, node that the rules' paths lead to from their scopes along members. members: node, name, child; scopes: rule_id, node; paths: rule_id, tag, path.

    A segment is a member's name, ``*`` for any member, or ``**`` for the node itself and all below it, at any depth. Each segment is a join of the nodes
    reached so far; a final ``**`` a closure.
    """
    at = scopes.join(paths, "rule_id").select("tag", "node", F.split("path", r"\.").alias("rest"))
    done = None
    longest = at.agg(F.max(F.size("rest"))).first()[0] or 0
    for _ in range(longest):
        head = at.withColumn("seg", F.element_at("rest", 1)).withColumn("rest", F.slice("rest", 2, F.size("rest")))
        below = head.where("seg = '**'").select("tag", "node")
        all_below = graph.reachable(members.select(F.col("node").alias("src"), F.col("child").alias("dst")), below.distinct()).select("tag", "node")
        step = head.where("seg != '**'").join(members, "node").where((F.col("seg") == "*") | (F.col("seg") == F.col("name"))).select("tag", F.col("child").alias("node"), "rest")
        found = step.where("size(rest) = 0").select("tag", "node").unionByName(all_below)
        done = found if done is None else done.unionByName(found)
        at = written(step.where("size(rest) > 0").distinct(), "paths")
        if not at.limit(1).count():
            break
    return done.distinct() if done is not None else at.select("tag", "node")


def return_sources(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """tag, ep_id, node of calls whose return value a rule marks."""
    return match_calls(calls, rules).select(F.col("kind").alias("tag"), "ep_id", F.col("ret_node").alias("node")).where("node is not null").distinct()


def argument_sources(calls: DataFrame, call_args: DataFrame, rules: DataFrame, selectors: DataFrame) -> DataFrame:
    hit = match_calls(calls, rules).select("call_id", "ep_id", "rule_id", F.col("kind").alias("tag"))
    return select_args(call_args.join(hit, "call_id"), selectors).select("tag", "ep_id", "node").distinct()


def identifier_sources(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Nodes whose sid, qid or name is a rule's path, in its scope file and function where it names them. Three equi-joins, not one on either key."""
    r = rules.select(F.col("path").alias("_path"), F.col("scope_file").alias("_file"), F.col("scope_func").alias("_func"), F.col("kind").alias("tag"))
    parts = [nodes.join(r, nodes[k] == F.col("_path")) for k in ("sid", "qid", "name")]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    scope = (F.col("_file").isNull() | (F.col("_file") == "all") | F.endswith("file", F.col("_file"))) & (F.col("_func").isNull() | (F.col("_func") == "all") | (F.col("func") == F.col("_func")))
    return found.where(scope).select("tag", "ep_id", F.col("id").alias("node")).distinct()


def member_sources(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    r = rules.select("class_name", F.col("path").alias("property"), F.col("kind").alias("tag"))
    return nodes.join(r, ["class_name", "property"]).select("tag", "ep_id", F.col("id").alias("node")).distinct()


def library_edges(calls: DataFrame, call_args: DataFrame, models: DataFrame) -> DataFrame:
    """from_node_id, to_node_id, ep_id, edge_type. models: fsig, from_kind, from_index, to_kind, to_index; kinds are ARG, THIS, RET.

    A call with a model has that model's edges; any other passes each argument and the receiver on to its return.
    """
    m = models.withColumnRenamed("fsig", "_fsig")
    modelled = by_signature(calls, m, "_fsig")
    args = call_args.select("call_id", "idx", "node")

    def end(rows: DataFrame, side: str, out: str) -> DataFrame:
        idx = F.when(F.col(f"{side}_kind") == "THIS", -1).otherwise(F.col(f"{side}_index"))
        j = rows.withColumn("_idx", idx).join(args.select("call_id", F.col("idx").alias("_idx"), F.col("node").alias("_node")), ["call_id", "_idx"], "left")
        return j.withColumn(out, F.when(F.col(f"{side}_kind") == "RET", F.col("ret_node")).otherwise(F.col("_node"))).drop("_idx", "_node")

    by_model = end(end(modelled, "from", "from_node_id"), "to", "to_node_id").select("from_node_id", "to_node_id", "ep_id", F.lit("lib_model").alias("edge_type"))
    rest = calls.join(modelled.select("call_id").distinct(), "call_id", "left_anti").join(args, "call_id").select(F.col("node").alias("from_node_id"), F.col("ret_node").alias("to_node_id"), "ep_id", F.lit("lib_arg_to_ret").alias("edge_type"))
    return by_model.unionByName(rest).where("from_node_id is not null and to_node_id is not null and from_node_id != to_node_id").distinct()


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """tag, ep_id, node: all that the seeds reach within their entry point."""
    e = edges.select("ep_id", F.col("from_node_id").alias("src"), F.col("to_node_id").alias("dst"))
    return graph.reachable(e, seeds, ("ep_id",))


def sanitizer_scenario(to: Column) -> Column:
    """Where a sanitizer acts, from its ``to``: its return, its arguments, or the whole entry point."""
    return F.when(to == "RET", "FILTER").when(F.startswith(to, F.lit("ARG")), "VALIDATE").when(to == "CONFIG", "CONFIG").otherwise("CALLSTACK")


def sanitized_nodes(calls: DataFrame, call_args: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """sanitizer_id, ep_id, node (null: the whole entry point)."""
    hit = by_signature(calls, sanitizers).withColumn("scenario", sanitizer_scenario(F.col("to")))
    ret = hit.where(F.col("scenario").isin("FILTER", "CONFIG")).select("sanitizer_id", "ep_id", F.col("ret_node").alias("node"))
    args = hit.where("scenario = 'VALIDATE'").join(call_args.select("call_id", "node"), "call_id").select("sanitizer_id", "ep_id", "node")
    whole = hit.where("scenario = 'CALLSTACK'").select("sanitizer_id", "ep_id", F.lit(None).cast("long").alias("node"))
    return ret.unionByName(args).unionByName(whole).distinct()


def operand_sanitized(operations: DataFrame, rules: DataFrame) -> DataFrame:
    """node, sanitizer_id: an operator with a literal operand that wholly matches a rule's regex sanitises the other operand. operations: operator, left, right, left_literal, right_literal."""
    r = rules.select("sanitizer_id", "operator", "regex")
    full = F.concat(F.lit("^(?:"), F.col("regex"), F.lit(")$"))
    j = operations.join(r, "operator")
    a = j.where(F.rlike("left_literal", full)).select(F.col("right").alias("node"), "sanitizer_id")
    b = j.where(F.rlike("right_literal", full)).select(F.col("left").alias("node"), "sanitizer_id")
    return a.unionByName(b).distinct()


def findings(tainted: DataFrame, calls: DataFrame, call_args: DataFrame, sinks: DataFrame, selectors: DataFrame, sanitized: DataFrame | None = None) -> DataFrame:
    """rule_id, tag, ep_id, call_id, node, sanitizers (ids that act on the node or its entry point; findings are annotated, not dropped)."""
    hit = match_calls(calls, sinks).select("call_id", "ep_id", "rule_id")
    args = select_args(call_args.join(hit, "call_id"), selectors)
    found = args.join(tainted, ["ep_id", "node"]).select("rule_id", "tag", "ep_id", "call_id", "node").distinct()
    if sanitized is None:
        return found.withColumn("sanitizers", F.expr("cast(array() as array<string>)"))
    own = sanitized.where("node is not null").groupBy("ep_id", "node").agg(F.collect_set("sanitizer_id").alias("own"))
    whole = sanitized.where("node is null").groupBy("ep_id").agg(F.collect_set("sanitizer_id").alias("whole"))
    none = F.expr("cast(array() as array<string>)")
    return found.join(own, ["ep_id", "node"], "left").join(whole, "ep_id", "left").select("rule_id", "tag", "ep_id", "call_id", "node", F.array_sort(F.array_union(F.coalesce("own", none), F.coalesce("whole", none))).alias("sanitizers"))


def merge_flows(results: DataFrame) -> DataFrame:
    """One result a (sink, entry point) with the distinct flows of all; results that lack either stay as they are. results: sink, entrypoint, flow."""
    known = results.where("sink is not null and entrypoint is not null").groupBy("sink", "entrypoint").agg(F.array_sort(F.collect_set("flow")).alias("flows"))
    rest = results.where("sink is null or entrypoint is null").select("sink", "entrypoint", F.array("flow").alias("flows"))
    return known.unionByName(rest)


def merge_traces(mine: Column, other: Column) -> Column:
    """Maps tag -> trace (array of tags): another's trace comes in where there is none, or where the old one has no source and the new one has."""
    sourced = lambda t: F.exists(t, lambda x: x == "SOURCE: ")
    return F.map_zip_with(mine, other, lambda k, a, b: F.when(a.isNull() | (b.isNotNull() & ~sourced(a) & sourced(b)), b).otherwise(a))


def union_values(a: Column, b: Column) -> Column:
    """Arrays of value ids as one: no nulls, each once."""
    return F.array_compact(F.array_distinct(F.concat(a, b)))


def implementers_within(implementations: DataFrame, most: int = 8) -> DataFrame:
    """interface, impl of the interfaces that have at most ``most``; larger groups are no evidence and go whole."""
    few = implementations.groupBy("interface").agg(F.countDistinct("impl").alias("n")).where(F.col("n") <= most).select("interface")
    return implementations.select("interface", "impl").distinct().join(few, "interface", "left_semi")


#: Elements of a range that a bounded iteration looks at.
UNROLLED = 30


def unrolled(values: Column, most: int = UNROLLED) -> Column:
    """The first values of an array, in order."""
    return F.slice(values, 1, most)


def appended(values: DataFrame) -> DataFrame:
    """union, pos, value: a union's values in order, each once by kind and content, or by location if it is a symbol; a union is no value of its own. values: union, pos, value, kind, content, loc."""
    key = F.when((F.col("kind") == "symbol") & F.col("loc").isNotNull(), F.concat(F.lit("loc|"), "loc")).otherwise(F.concat(F.lit("is|"), F.coalesce("kind", F.lit("")), F.lit("|"), F.coalesce("content", F.lit(""))))
    own = values.where(F.col("union") != F.col("value"))
    return own.withColumn("_key", key).groupBy("union", "_key").agg(F.min_by(F.struct("pos", "value"), F.struct("pos", "value")).alias("v")).select("union", "v.pos", "v.value")


def merged_buffers(held: DataFrame, buffered: DataFrame, keyed: tuple[str, ...]) -> DataFrame:
    """strategy, key, seq: findings held and those of a buffer. Of the strategies in ``keyed``, which have a key for equal findings, only new ones come in, the first of each; others all."""
    has = F.col("strategy").isin(*keyed)
    fresh = buffered.where(has).join(held.select("strategy", "key").distinct(), ["strategy", "key"], "left_anti").groupBy("strategy", "key").agg(F.min("seq").alias("seq"))
    return held.select("strategy", "key", "seq").unionByName(fresh).unionByName(buffered.where(~has).select("strategy", "key", "seq"))


def with_source_kinds(rules: DataFrame, kind: str) -> DataFrame:
    """Rules whose kinds (array) hold ``kind`` once, whatever they were."""
    none = F.expr("cast(array() as array<string>)")
    return rules.withColumn("kinds", F.array_union(F.coalesce("kinds", none), F.array(F.lit(kind))))


def flow_locations(config: DataFrame, files: DataFrame) -> DataFrame:
    """file, role, line: configured places (role, place as path:line) in the files that end with their path."""
    c = config.select("role", F.substring_index("place", ":", 1).alias("_path"), F.try_element_at(F.split("place", ":"), F.lit(2)).cast("int").alias("line"))
    return files.select("file").distinct().join(c, F.endswith("file", F.col("_path"))).select("file", "role", "line")
