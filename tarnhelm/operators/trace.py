"""Operators on ordered traces. steps: finding, pos, tag, file, line and more; ``pos`` is the order, and every result keeps it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

# Tags as they are written, with their spaces.
SOURCE, SINK, CALL, ARG_PASS, CALL_RETURN, RETURN_VALUE, FIELD = "SOURCE: ", "SINK: ", "CALL: ", "ARG PASS: ", "CALL RETURN:", "Return Value: ", "Field: "
AT = ("file", "line", "tag")


def _order():
    return Window.partitionBy("finding").orderBy("pos")


def _upto():
    return _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _all():
    return Window.partitionBy("finding")


def drop_adjacent_repeats(steps: DataFrame, key: tuple[str, ...] = AT) -> DataFrame:
    """Without steps equal to the one just before."""
    here = F.struct(*key)
    return steps.withColumn("_before", F.lag(here).over(_order())).where(F.col("_before").isNull() | (F.col("_before") != here)).drop("_before")


def first_source_only(steps: DataFrame) -> DataFrame:
    """Without the sources after the first."""
    n = F.sum((F.col("tag") == SOURCE).cast("int")).over(_upto())
    return steps.withColumn("_n", n).where((F.col("tag") != SOURCE) | (F.col("_n") == 1)).drop("_n")


def bounded(steps: DataFrame) -> DataFrame:
    """From the first source to the first sink after it, or to the end; traces without a source stay whole."""
    s = F.min(F.when(F.col("tag") == SOURCE, F.col("pos"))).over(_all())
    marked = steps.withColumn("_s", s)
    e = F.min(F.when((F.col("tag") == SINK) & (F.col("pos") > F.col("_s")), F.col("pos"))).over(_all())
    marked = marked.withColumn("_e", e)
    return marked.where("_s is null or (pos >= _s and (_e is null or pos <= _e))").drop("_s", "_e")


def valid_findings(steps: DataFrame) -> DataFrame:
    """finding, valid: two steps or more, a source first, a sink last with a file, neither between."""
    first, last = F.min_by("tag", "pos"), F.max_by(F.struct("tag", "file"), "pos")
    edge = F.sum(F.col("tag").isin(SOURCE, SINK).cast("int"))
    facts = steps.groupBy("finding").agg(F.count("*").alias("n"), first.alias("first"), last.alias("last"), edge.alias("edges"))
    fine = (F.col("n") >= 2) & (F.col("first") == SOURCE) & (F.col("last.tag") == SINK) & (F.coalesce("last.file", F.lit("")) != "") & (F.col("edges") == 2)
    return facts.select("finding", fine.alias("valid"))


def segments_in_frame(framed: DataFrame) -> DataFrame:
    """finding, valid: after each argument pass the steps stay in its frame, or leave it as a call, a return or an outer frame allows.

    One fold over a finding's ordered steps; its state is the current frame, the frame of a call that waits for its callee, and whether all
    was in order so far. A step is in the current frame; or in the deeper frame of the waiting call, or any deeper one if that call
    is in the current frame; or it is a returned value and the next located step is back; or a call's return to an outer frame; or in an
    outer frame while no call waits. A null frame is none.
    """
    here = F.coalesce(F.col("frame"), F.lit(-1))
    located = F.col("file").isNotNull() & F.col("line").isNotNull()
    stops = F.col("tag").isin(ARG_PASS, SINK)
    seen = F.when((F.col("tag") != SOURCE) & (stops | located), F.struct(stops.alias("stops"), here.alias("frame")))
    nxt = F.first(seen, ignorenulls=True).over(_order().rowsBetween(1, Window.unboundedFollowing))
    marked = framed.withColumn("_back", F.when(~nxt["stops"], nxt["frame"]))
    item = F.struct("pos", "tag", here.alias("frame"), located.alias("located"), "_back")
    start = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("call"), F.lit(True).alias("ok"))

    def state(s: Column, at: Column | None = None, call: Column | None = None, ok: Column | None = None) -> Column:
        return F.struct((s["at"] if at is None else at).alias("at"), (s["call"] if call is None else call).alias("call"), (s["ok"] if ok is None else ok).alias("ok"))

    def step(s: Column, x: Column) -> Column:
        none, frame = F.lit(-1), x["frame"]
        waited = (frame > s["at"]) & ((s["call"] == s["at"]) | (frame == s["call"]))
        outer = (frame >= 0) & (frame < s["at"])
        return (
            F.when(x["tag"] == ARG_PASS, state(s, frame, none))
            .when((s["at"] < 0) | x["tag"].isin(SOURCE, SINK), s)
            .when(x["tag"] == CALL, state(s, call=frame))
            .when(~x["located"], s)
            .when((frame == s["at"]) | waited, state(s, frame, none))
            .when((x["tag"] == RETURN_VALUE) & F.coalesce(x["_back"] == s["at"], F.lit(False)), s)
            .when((x["tag"] == CALL_RETURN) & outer, state(s, frame, none))
            .when(outer & (s["call"] < 0), state(s, frame))
            .otherwise(state(s, ok=F.lit(False)))
        )

    items = F.array_sort(F.collect_list(item))  # one finding's trace
    return marked.groupBy("finding").agg(items.alias("t")).select("finding", F.aggregate("t", start, step)["ok"].alias("valid"))


def frames(steps: DataFrame, stack: DataFrame) -> DataFrame:
    """Each step's innermost frame. stack: finding, idx, file, start_line, end_line; the deepest frame that holds the line wins; null where none does."""
    held = stack.where("file is not null and start_line is not null and end_line is not null").groupBy(F.col("finding").alias("_finding")).agg(F.collect_list(F.struct("idx", "file", "start_line", "end_line")).alias("_stack"))  # one finding's
    inside = F.filter("_stack", lambda f: (f["file"] == F.col("file")) & F.col("line").between(f["start_line"], f["end_line"]))
    return steps.join(held, F.col("finding") == F.col("_finding"), "left").withColumn("frame", F.array_max(F.transform(inside, lambda f: f["idx"]))).drop("_finding", "_stack")


def first_pass_per_frame(framed: DataFrame) -> DataFrame:
    """Argument passes after the first of a frame go, with a call just before them."""
    nth = F.row_number().over(Window.partitionBy("finding", "frame", "tag").orderBy("pos"))
    gone = (F.col("tag") == ARG_PASS) & F.col("frame").isNotNull() & (F.col("_nth") > 1)
    marked = framed.withColumn("_nth", nth).withColumn("_gone", gone)
    after = F.coalesce(F.lead("_gone").over(_order()), F.lit(False))
    return marked.withColumn("_next", after).where(~F.col("_gone") & ~((F.col("tag") == CALL) & F.col("_next"))).drop("_nth", "_gone", "_next")


def edge_invariant(framed: DataFrame, stack: DataFrame) -> DataFrame:
    """finding, valid: with E the frames from 1 that hold an argument pass plus the sink steps, and N the located frames plus one: E >= 1 and N >= E + 1."""
    e = F.countDistinct(F.when((F.col("tag") == ARG_PASS) & (F.col("frame") >= 1), F.col("frame"))) + F.sum((F.col("tag") == SINK).cast("int"))
    left = framed.groupBy("finding").agg(e.alias("e"))
    n = stack.where("file is not null").groupBy("finding").agg((F.countDistinct("idx") + 1).alias("n"))
    return left.join(n, "finding", "left").select("finding", ((F.col("e") >= 1) & (F.coalesce("n", F.lit(1)) >= F.col("e") + 1)).alias("valid"))


def bridged(framed: DataFrame, stack: DataFrame) -> DataFrame:
    """With steps for the located frames from 1 that no argument pass is in: an argument pass at the frame's first line and, where the call's place is known, the call before it.

    They come before the first step between source and sink that is in the frame or a deeper one, else before a final sink, else last;
    outer frames first. Then an argument pass without a call just before it gets its frame's call, if that is at another place.
    stack: finding, idx, file, start_line, end_line, call_file, call_line. Positions are numbered anew.
    """
    located = stack.where("file is not null and start_line is not null and end_line is not null")
    have = framed.where(F.col("tag") == ARG_PASS).where("frame is not null").select("finding", F.col("frame").alias("idx")).distinct()
    missing = located.where("idx >= 1").join(have, ["finding", "idx"], "left_anti")
    ends = framed.groupBy("finding").agg(F.max("pos").alias("_last"), F.max_by("tag", "pos").alias("_tag"), F.min("pos").alias("_first"))
    middle = framed.where("frame is not null").where(~F.col("tag").isin(SOURCE, SINK)).select(F.col("finding").alias("_f"), F.col("frame").alias("_frame"), F.col("pos").alias("_pos"))
    keys = ["finding", "idx", "file", "start_line", "call_file", "call_line"]
    at = missing.join(middle, (F.col("finding") == F.col("_f")) & (F.col("_frame") >= F.col("idx")), "left").groupBy(*keys).agg(F.min("_pos").alias("_before"))
    place = F.coalesce("_before", F.when(F.col("_tag") == SINK, F.col("_last")).otherwise(F.col("_last") + 1))
    site = F.col("call_file").isNotNull() & F.col("call_line").isNotNull()
    call = F.struct(F.lit(0).alias("o"), F.lit(CALL).alias("tag"), F.col("call_file").alias("file"), F.col("call_line").alias("line"))
    entry = F.struct(F.lit(1).alias("o"), F.lit(ARG_PASS).alias("tag"), F.col("file").alias("file"), F.col("start_line").alias("line"))
    made = at.join(ends, "finding").select("finding", place.alias("pos"), F.lit(0).alias("_own"), F.col("idx").alias("_rank"), F.explode(F.when(site, F.array(call, entry)).otherwise(F.array(entry))).alias("x"))
    made = made.select("finding", "pos", "_own", "_rank", F.col("x.o").alias("_o"), F.col("x.tag").alias("tag"), F.col("x.file").alias("file"), F.col("x.line").alias("line"))
    own = framed.select("finding", "pos", F.lit(1).alias("_own"), F.lit(0).alias("_rank"), F.lit(0).alias("_o"), "tag", "file", "line")
    order = Window.partitionBy("finding").orderBy("pos", "_own", "_rank", "_o")
    both = written(frames(own.unionByName(made).withColumn("pos", F.row_number().over(order).cast("int")).drop("_own", "_rank", "_o"), stack), "both")
    sites = stack.where(site).select(F.col("finding").alias("_f"), F.col("idx").alias("_idx"), "call_file", "call_line")
    alone = both.withColumn("_before", F.lag("tag").over(_order())).where((F.col("tag") == ARG_PASS) & F.col("frame").isNotNull() & (F.coalesce("_before", F.lit("")) != CALL))
    calls = alone.join(sites, (F.col("finding") == F.col("_f")) & (F.col("frame") == F.col("_idx"))).where((F.col("call_file") != F.col("file")) | (F.col("call_line") != F.col("line")))
    calls = calls.select("finding", "pos", F.lit(0).alias("_own"), F.lit(CALL).alias("tag"), F.col("call_file").alias("file"), F.col("call_line").alias("line"))
    every = both.select("finding", "pos", F.lit(1).alias("_own"), "tag", "file", "line").unionByName(calls)
    return frames(every.withColumn("pos", F.row_number().over(Window.partitionBy("finding").orderBy("pos", "_own")).cast("int")).drop("_own"), stack)


def without_foreign_callbacks(steps: DataFrame, stack: DataFrame) -> DataFrame:
    """Without neighbouring call and argument pass that are marked as one callback edge (callback, owner) whose owner is no function of the stack (func)."""
    own = stack.groupBy(F.col("finding").alias("_finding")).agg(F.collect_set("func").alias("_funcs"))  # one finding's
    marked = steps.join(own, F.col("finding") == F.col("_finding"), "left").withColumn("_edge", F.coalesce("callback", F.lit(False)) & (F.coalesce("owner", F.lit("")) != ""))
    here = F.struct("tag", "_edge", "owner")
    marked = marked.withColumn("_n", F.lead(here).over(_order())).withColumn("_p", F.lag(here).over(_order()))
    foreign = ~F.coalesce(F.array_contains("_funcs", F.col("owner")), F.lit(False))
    pair = lambda other, mine, its: F.coalesce(F.col("_edge") & (F.col("tag") == mine) & F.col(f"{other}._edge") & (F.col(f"{other}.tag") == its) & (F.col(f"{other}.owner") == F.col("owner")), F.lit(False))
    return marked.where(~((pair("_n", CALL, ARG_PASS) | pair("_p", ARG_PASS, CALL)) & foreign)).drop("_finding", "_funcs", "_edge", "_n", "_p")


def in_callstack_order(steps: DataFrame, stack: DataFrame, callee_only: bool = False) -> DataFrame:
    """Steps within the stack whose argument passes enter its frames one after another, with their ``frame``.

    Foreign callback edges go first; then all steps but sources and sinks that are in no frame or in a function (func) outside the stack.
    Frame 1 is expected first. An argument pass in the expected frame, or unless ``callee_only`` in the one before, is kept and the
    next frame is expected; any other goes, with a call just before it. stack: finding, idx, file, start_line, end_line, func.
    """
    own = stack.groupBy(F.col("finding").alias("_finding")).agg(F.collect_set("func").alias("_funcs"), F.countDistinct("idx").cast("int").alias("_depth"))
    framed = frames(without_foreign_callbacks(steps, stack), stack).join(own, F.col("finding") == F.col("_finding"), "left").drop("_finding")
    inside = F.col("frame").isNotNull() & (F.col("func").isNull() | F.coalesce(F.array_contains("_funcs", F.col("func")), F.lit(False)))
    kept = framed.where(F.col("tag").isin(SOURCE, SINK) | inside)
    passes = F.array_sort(F.collect_list(F.when(F.col("tag") == ARG_PASS, F.struct("pos", "frame"))))  # one finding's
    start = F.struct(F.lit(1).alias("next"), F.expr("cast(array() as array<int>)").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        enters = x["frame"] == s["next"] if callee_only else x["frame"].isin(s["next"], s["next"] - 1)
        return F.when((s["next"] < F.col("_depth")) & enters, F.struct((s["next"] + 1).alias("next"), F.concat(s["kept"], F.array(x["pos"])).alias("kept"))).otherwise(s)

    entered = kept.groupBy(F.col("finding").alias("_finding"), "_depth").agg(passes.alias("_passes")).select("_finding", F.aggregate("_passes", start, step)["kept"].alias("_kept"))
    marked = kept.join(entered, F.col("finding") == F.col("_finding")).withColumn("_gone", (F.col("tag") == ARG_PASS) & ~F.array_contains("_kept", F.col("pos")))
    after = F.coalesce(F.lead("_gone").over(_order()), F.lit(False))
    return marked.withColumn("_next", after).where(~F.col("_gone") & ~((F.col("tag") == CALL) & F.col("_next"))).drop("_finding", "_funcs", "_depth", "_kept", "_gone", "_next")


def callstack_findings(steps: DataFrame, stack: DataFrame, callee_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(steps of the findings that stay, verdicts: finding, reason), null for those that stay; what an output of call stacks does to each trace, in order.

    From source to sink; boundary; order of the stack; bridges for frames without steps; segments in their frames; with ``callee_only`` one pass a
    frame; boundary; edges against frames; one source; no repeats; boundary. The first check that fails is the reason.
    """
    cut = bounded(steps)
    ordered = written(in_callstack_order(cut, stack, callee_only), "ordered")
    bridges = written(bridged(ordered, stack), "bridges")
    shown = first_pass_per_frame(bridges) if callee_only else bridges
    final = written(drop_adjacent_repeats(first_source_only(shown)), "trace")
    checks = [("boundary", valid_findings(cut)), ("segment", segments_in_frame(bridges)), ("boundary after", valid_findings(shown)), ("edges", edge_invariant(shown, stack)), ("boundary at the end", valid_findings(final))]
    found = steps.select("finding").distinct()
    reason = F.lit(None).cast("string")
    for i, (name, check) in reversed([*enumerate(checks)]):
        found = found.join(check.withColumnRenamed("valid", f"_v{i}"), "finding", "left")
        reason = F.when(~F.coalesce(F.col(f"_v{i}"), F.lit(False)), name).otherwise(reason)
    verdicts = found.select("finding", reason.alias("reason"))
    return final.join(verdicts.where("reason is null").select("finding"), "finding", "left_semi"), verdicts


def summarised(steps: DataFrame) -> DataFrame:
    """finding, n, source, sink, places (of the steps between)."""
    place = F.concat_ws(":", "file", "line")
    items = F.array_sort(F.collect_list(F.struct("pos", "tag", place.alias("place"))))
    t = steps.groupBy("finding").agg(items.alias("t"))
    mid = F.transform(F.slice("t", 2, F.greatest(F.size("t") - 2, F.lit(0))), lambda x: x["place"])
    edge = lambda i: F.concat(F.element_at("t", i)["tag"], F.element_at("t", i)["place"])
    return t.select("finding", F.size("t").alias("n"), edge(1).alias("source"), edge(-1).alias("sink"), mid.alias("places"))


def degenerate(steps: DataFrame) -> DataFrame:
    """finding: of findings with the same source and sink, those that are only a source and a sink, or whose steps between all are in a longer one.

    Findings are compared by what they have in common: each distinct set of places with its longest trace, and only sets that share the smaller one's first place.
    """
    s = summarised(steps).where(F.startswith("source", F.lit(SOURCE)) & F.startswith("sink", F.lit(SINK)) & (F.col("n") >= 2))
    s = written(s.select("finding", "source", "sink", "n", F.array_sort(F.array_distinct("places")).alias("places")), "summaries")
    sets = written(s.groupBy("source", "sink", "places").agg(F.min("n").alias("n"), F.max("n").alias("_n")), "sets")
    longest = sets.groupBy("source", "sink").agg(F.max("_n").alias("_n"))
    bare = s.where("n = 2").join(longest, ["source", "sink"]).where("n < _n")
    longer = sets.select("source", "sink", F.col("places").alias("_places"), "_n", F.explode("places").alias("_at"))
    pair = sets.where("n > 2").drop("_n").withColumn("_at", F.element_at("places", 1)).join(longer, ["source", "sink", "_at"]).where("n < _n")
    within = pair.where(F.size(F.array_except("places", "_places")) == 0).groupBy("source", "sink", "places").agg(F.max("_n").alias("_n"))
    return bare.select("finding").unionByName(s.where("n > 2").join(within, ["source", "sink", "places"]).where("n < _n").select("finding"))


def shortest_per_flow(steps: DataFrame) -> DataFrame:
    """source, sink, finding, n: the shortest trace of each source and sink; the least finding of equal ones."""
    return summarised(steps).groupBy("source", "sink").agg(F.min(F.struct("n", "finding")).alias("x")).select("source", "sink", "x.finding", "x.n")
