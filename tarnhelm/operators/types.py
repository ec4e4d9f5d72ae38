"""Type resolution of calls as joins: candidates, overloads, unknown callees, summary keys.

calls: call, caller, owner (declared type or null), method, arg_types (array; an ambiguous or unknown type is empty).
methods: owner, method, pos, param_types, varargs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def same_type(arg: Column, param: Column) -> Column:
    """An empty argument type is any; array marks don't count; the last segments of a qualified name do."""
    a, p = F.replace(arg, F.lit("[]"), F.lit("")), F.replace(param, F.lit("[]"), F.lit(""))
    return (F.coalesce(a, F.lit("")) == "") | (a == p) | F.endswith(p, F.concat(F.lit("."), a)) | F.endswith(a, F.concat(F.lit("."), p))


def accepts(args: Column, params: Column, varargs: Column) -> Column:
    """Types match one by one; with varargs the last parameter takes all arguments from its place on."""
    n = F.size(params)
    wanted = F.transform(args, lambda a, i: F.struct(a.alias("a"), F.try_element_at(params, F.least(i + 1, n)).alias("p")))
    count = F.when(varargs, F.size(args) >= n - 1).otherwise(F.size(args) == n)
    return count & F.forall(wanted, lambda x: same_type(x["a"], x["p"]))


def resolve(calls: DataFrame, methods: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """call, owner, method, pos, resolved: for each owner that the call may have, the first overload whose types match, else the last of its arity, else the first; one unresolved row for a call without any.

    hierarchy: super, sub (closed, without the type itself). Calls through ``super.`` (via_super) aren't expanded to subtypes.

    Overloads are chosen once for each distinct owner, method and types, among the subtypes that have the method; calls meet the choices last. Only calls
    of several rows have to be ranked again, over their rows.
    """
    kind = ["_declared", "_method", "_args", "_super"]
    keyed = calls.select("call", F.col("owner").alias("_declared"), F.col("method").alias("_method"), F.col("arg_types").alias("_args"), F.coalesce("via_super", F.lit(True)).alias("_super"))
    kinds = keyed.select(*kind).where("_declared is not null and _method is not null").distinct()
    pairs = hierarchy.select(F.col("super").alias("_declared"), F.col("sub").alias("owner")).where("_declared != owner").distinct()
    having = pairs.join(methods.select("owner", F.col("method").alias("_method")).distinct(), "owner")
    own = kinds.select(*kind, F.col("_declared").alias("owner"))
    subs = kinds.where("not _super").join(having, ["_declared", "_method"]).select(*kind, "owner")
    cases = own.unionByName(subs).join(methods.withColumnRenamed("method", "_method"), ["owner", "_method"])
    level = F.when(accepts(F.col("_args"), F.col("param_types"), F.col("varargs")), 0).when((F.size("_args") == F.size("param_types")) | F.col("varargs"), 1).otherwise(2)
    rank = F.struct("level", F.when(F.col("level") == 1, -F.col("pos")).otherwise(F.col("pos")).alias("at"))
    order = Window.partitionBy(*kind, "owner").orderBy("_rank")
    best = cases.withColumn("level", level).withColumn("_rank", rank).withColumn("r", F.row_number().over(order)).where("r = 1").select(*(F.col(c).alias(c + "_") for c in kind), "owner", F.col("_method").alias("method"), "pos", "_rank")
    best = written(best, "overloads")
    same = (F.col("_declared") == F.col("_declared_")) & (F.col("_method") == F.col("_method_")) & F.col("_args").eqNullSafe(F.col("_args_")) & (F.col("_super") == F.col("_super_"))
    parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed.join(keyed.groupBy("call").agg((F.count("*") > 1).alias("_many")), "call").repartition(parts, "call")  # a call becomes many rows
    found = rows.join(best, same).select("call", "owner", "method", "pos", "_rank", "_many")
    many = found.where("_many").groupBy("call", "owner").agg(F.min_by(F.struct("method", "pos"), "_rank").alias("m")).select("call", "owner", "m.*")
    found = found.where("not _many").select("call", "owner", "method", "pos").unionByName(many).withColumn("resolved", F.lit(True))
    some = keyed.join(best.select(*(c + "_" for c in kind)).distinct(), same, "left_semi").select("call").distinct()
    none = calls.join(some, "call", "left_anti").select("call", "owner", "method", F.lit(None).cast("int").alias("pos"), F.lit(False).alias("resolved"))
    return found.unionByName(none)


def argument_types(candidates: DataFrame) -> DataFrame:
    """call, idx, type: the type of an argument if all candidates agree, else empty. candidates: call, idx, type."""
    return candidates.groupBy("call", "idx").agg(F.when(F.countDistinct("type") == 1, F.min("type")).otherwise("").alias("type"))


def summary_key(caller: Column, callee: Column, arg_types: Column, tainted: Column) -> Column:
    """Calls with equal keys have equal summaries: who calls whom, the number and types of arguments, and which are tainted."""
    return F.concat_ws("|", F.coalesce(caller, F.lit("")), F.coalesce(callee, F.lit("")), F.size(arg_types).cast("string"), F.array_join(arg_types, ",", ""), F.array_join(F.transform(tainted, lambda t: t.cast("int").cast("string")), ""))


def distinct_summaries(calls: DataFrame) -> DataFrame:
    """key, n, first_call: what has to be expanded once. calls: call, caller, callee, arg_types, tainted."""
    return calls.groupBy(summary_key(F.col("caller"), F.col("callee"), F.col("arg_types"), F.col("tainted")).alias("key")).agg(F.count("*").alias("n"), F.min("call").alias("first_call"))
