"""Two revisions compared: diffs to ranges, entry points to changes, findings merged, lines moved."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..scratch import written


def parse_diff(lines: DataFrame) -> DataFrame:
    """file, kind (added, deleted), line, seq from a unified diff's lines (n, text). Old and new line numbers are running sums from each hunk's header."""
    by = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    header = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    is_hunk, is_file = F.col("text").rlike(header), F.col("text").rlike(r"^\+\+\+ ")
    marked = lines.withColumn("hunk", F.sum(is_hunk.cast("int")).over(by)).withColumn("part", F.sum(F.startswith("text", F.lit("diff --git ")).cast("int")).over(by))
    old = Window.partitionBy("part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    name = lambda mark: F.regexp_extract("text", rf"^{mark} (?:[ab]/)?([^\t]*)", 1)
    marked = marked.withColumn("new_file", F.last(F.when(is_file, name(r"\+\+\+")), ignorenulls=True).over(old)).withColumn("old_file", F.last(F.when(F.col("text").rlike("^--- "), name("---")), ignorenulls=True).over(old))
    within = Window.partitionBy("part", "hunk")
    body = marked.withColumn("old_start", F.max(F.when(is_hunk, F.regexp_extract("text", header, 1).cast("int"))).over(within)).withColumn("new_start", F.max(F.when(is_hunk, F.regexp_extract("text", header, 2).cast("int"))).over(within))
    body = body.where(F.col("old_start").isNotNull() & ~is_hunk & ~F.col("text").rlike(r"^(diff --git |index |--- |\+\+\+ |\\)"))
    sign = F.substring("text", 1, 1)
    running = Window.partitionBy("part", "hunk").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    body = body.withColumn("old_n", F.sum((sign != "+").cast("int")).over(running)).withColumn("new_n", F.sum((sign != "-").cast("int")).over(running))
    kind = F.when(sign == "+", "added").when(sign == "-", "deleted")
    line = F.when(sign == "+", F.col("new_start") + F.col("new_n") - 1).otherwise(F.col("old_start") + F.col("old_n") - 1)
    file = F.when(F.col("new_file") == "/dev/null", F.col("old_file")).otherwise(F.col("new_file"))
    return body.where(sign.isin("+", "-")).select(file.alias("file"), kind.alias("kind"), line.cast("int").alias("line"), "n")


def coalesce_ranges(lines: DataFrame) -> DataFrame:
    """file, kind, first_line, last_line, seq: neighbouring lines of one kind as islands. lines: file, kind, line, n (order)."""
    w = Window.partitionBy("file").orderBy("n")
    breaks = F.when((F.lag("kind").over(w) == F.col("kind")) & (F.lag("line").over(w) + 1 >= F.col("line")) & (F.lag("line").over(w) <= F.col("line")) & (F.lag("n").over(w) + 1 == F.col("n")), 0).otherwise(1)
    isl = lines.withColumn("_b", breaks).withColumn("_i", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return isl.groupBy("file", "_i", "kind").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.min("n").alias("seq"), F.max("n").alias("last_seq")).drop("_i")


def pair_modified(ranges: DataFrame) -> DataFrame:
    """Deleted islands with the added ones right after them become one ``modified`` range that keeps the old lines."""
    w = Window.partitionBy("file").orderBy("seq")
    joined = (F.col("kind") == "added") & (F.lag("kind").over(w) == "deleted") & (F.lag("last_seq").over(w) + 1 == F.col("seq"))
    step = ranges.withColumn("_j", F.coalesce(joined, F.lit(False)))
    block = step.withColumn("_g", F.sum((~F.col("_j")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of = lambda k, c, f: f(F.when(F.col("kind") == k, F.col(c)))
    g = block.groupBy("file", "_g").agg(
        of("added", "first_line", F.min).alias("a1"), of("added", "last_line", F.max).alias("a2"), of("deleted", "first_line", F.min).alias("d1"), of("deleted", "last_line", F.max).alias("d2"), F.min("seq").alias("seq")
    )
    kind = F.when(F.col("a1").isNull(), "deleted").when(F.col("d1").isNull(), "added").otherwise("modified")
    old = lambda c: F.when(kind == "modified", F.col(c))
    return g.select("file", kind.alias("kind"), F.coalesce("a1", "d1").alias("first_line"), F.coalesce("a2", "d2").alias("last_line"), old("d1").alias("old_first"), old("d2").alias("old_last"), "seq")


def entrypoint_key(*columns: str) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


KEY = ("file", "func_name", "ep_type", "start_line", "end_line", "attribute")


def compare_entrypoints(base: DataFrame, head: DataFrame) -> DataFrame:
    """status (same, moved, added, deleted), base_key, head_key. Keys that differ pair up by (file, function, type, attribute), in order of their lines."""
    side = lambda df, n: df.withColumn("key", entrypoint_key(*KEY)).dropDuplicates(["key"]).select(F.col("key").alias(f"{n}_key"), *(F.col(c).alias(f"{n}_{c}") for c in KEY))
    b, h = side(base, "base"), side(head, "head")
    both = b.join(h, b["base_key"] == h["head_key"], "full_outer")
    same = both.where("base_key is not null and head_key is not null").select(F.lit("same").alias("status"), "base_key", "head_key")
    loose = ("file", "func_name", "ep_type", "attribute")

    def numbered(df: DataFrame, n: str, other: str) -> DataFrame:
        w = Window.partitionBy(*(f"{n}_{c}" for c in loose)).orderBy(f"{n}_start_line", f"{n}_key")
        return df.where(f"{other}_key is null").withColumn("nth", F.row_number().over(w)).select(f"{n}_key", "nth", *(F.coalesce(F.col(f"{n}_{c}"), F.lit("")).alias(c) for c in loose))

    drift = numbered(both, "base", "head").join(numbered(both, "head", "base"), ["nth", *loose], "full_outer")
    status = F.when(F.col("base_key").isNull(), "added").when(F.col("head_key").isNull(), "deleted").otherwise("moved")
    return same.unionByName(drift.select(status.alias("status"), "base_key", "head_key"))


def allowed(entrypoints: DataFrame, allow: DataFrame) -> DataFrame:
    """The entry points whose key is in ``allow`` (key)."""
    return entrypoints.withColumn("key", entrypoint_key(*KEY)).join(allow.select("key").distinct(), "key", "left_semi")


def touches(start: Column, end: Column, first: Column, last: Column, old_first: Column, old_last: Column) -> Column:
    """The new range, or the old one of a modification, shares a line."""
    return ((start <= last) & (end >= first)) | F.coalesce((start <= old_last) & (end >= old_first), F.lit(False))


def canonical_key(key: Column) -> Column:
    """Six-part keys without their lines; others as they are."""
    p = F.split(key, r"\|")
    return F.when(F.size(p) == 6, F.concat_ws("|", *(F.element_at(p, i) if i not in (4, 5) else F.lit("") for i in range(1, 7)))).otherwise(key)


STATUSES = ("added", "deleted", "modified", "moved", "same")


def needs_full(changes: DataFrame) -> DataFrame:
    """full: whether any status is unknown, so that the head replaces the base."""
    return changes.agg(F.coalesce(F.max(~F.col("status").isin(*STATUSES)), F.lit(False)).alias("full"))


def merge_findings(base: DataFrame, head: DataFrame, changes: DataFrame) -> DataFrame:
    """rule_id, key, origin (kept, new), result_index. base, head: rule_id, entrypoint_key, result_index; changes: status, ep_key.

    Base findings of deleted entry points are resolved, of modified or added ones removed; the rest is kept, and the rerun's
    findings follow. An unknown status replaces the base by the head.
    """
    c = changes.select(canonical_key(F.col("ep_key")).alias("key")).distinct()
    full = needs_full(changes)
    kept = base.withColumn("key", canonical_key(F.col("entrypoint_key"))).join(c, "key", "left_anti").crossJoin(F.broadcast(full)).where("not full")
    rows = kept.select("rule_id", F.col("entrypoint_key").alias("key"), F.lit("kept").alias("origin"), F.col("result_index").alias("i"), F.lit(0).alias("o"))
    rows = rows.unionByName(head.select("rule_id", F.col("entrypoint_key").alias("key"), F.lit("new").alias("origin"), F.col("result_index").alias("i"), F.lit(1).alias("o")))
    return rows.withColumn("result_index", (F.row_number().over(Window.orderBy("o", "i", "rule_id")) - 1).cast("int")).select("rule_id", "key", "origin", "result_index")


def merge_counts(base: DataFrame, head: DataFrame, changes: DataFrame) -> DataFrame:
    """kept, removed, resolved, new."""
    c = changes.select(canonical_key(F.col("ep_key")).alias("key"), "status").groupBy("key").agg(F.max((F.col("status") == "deleted").cast("int")).alias("gone"))
    b = base.withColumn("key", canonical_key(F.col("entrypoint_key"))).join(c, "key", "left")
    s = lambda x: F.coalesce(F.sum(x.cast("int")), F.lit(0)).cast("long")
    left = b.agg(s(F.col("gone").isNull()).alias("kept"), s(F.col("gone") == 0).alias("removed"), s(F.col("gone") == 1).alias("resolved"))
    return left.crossJoin(head.agg(F.count("*").alias("new")))


def remap_lines(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """Lines of the base as lines of the head. findings: finding, file, line; changes: file, old_start, old_end, new_start, new_end.

    Within a changed range a line is clamped into the new one; the range of the least old start that holds it decides, whatever came before. After all
    ranges it moves by their lengths' differences. Lines are 1 at least.
    """
    length = lambda a, b: F.greatest(F.col(b) - F.col(a) + 1, F.lit(0))
    c = changes.distinct().withColumn("old_n", length("old_start", "old_end")).withColumn("new_n", length("new_start", "new_end"))
    j = findings.join(c, "file", "left")
    inside = (F.col("old_n") > 0) & F.col("line").between(F.col("old_start"), F.col("old_end"))
    into = F.col("new_start") + F.least(F.col("line") - F.col("old_start"), F.greatest(F.col("new_n") - 1, F.lit(0)))
    before = (F.col("line") >= F.col("old_start")) & ~inside
    g = j.groupBy("finding", "file", "line").agg(F.min_by(F.when(inside, into), F.when(inside, F.struct("old_start", "old_end", "new_start"))).alias("into"), F.coalesce(F.sum(F.when(before, F.col("new_n") - F.col("old_n"))), F.lit(0)).alias("offset"))
    return g.select("finding", "file", "line", F.coalesce("into", F.greatest(F.lit(1), F.col("line") + F.col("offset"))).cast("int").alias("new_line"))


def latest_per_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row written for each key: an aggregate, so a hot key is combined before it is shuffled."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, *(F.col(f"_r.{c}") for c in rest))


def insert_or_ignore(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """First row of each key; rows with a null in the key are all kept, for nulls differ in a unique index."""
    some_null = F.lit(False)
    for k in key:
        some_null = some_null | F.col(k).isNull()
    rest = [c for c in rows.columns if c not in key]
    first = rows.where(~some_null).groupBy(*key).agg(F.min_by(F.struct(*rest), seq).alias("_r")).select(*key, *(F.col(f"_r.{c}") for c in rest))
    return first.unionByName(rows.where(some_null).select(*key, *rest))


def skipped_by_reason(metrics: DataFrame) -> DataFrame:
    """reason, n of the rows that have a reason for which they were skipped."""
    return metrics.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def verdict_ratios(verdicts: DataFrame, key: str) -> DataFrame:
    """key, precision, recall of verdicts (reported, expected) by the benchmark's own definitions: tp / (tp + tn), tp / (tp + fp). Null where nothing is to divide by."""
    n = lambda r, e: F.sum(((F.col("reported") == r) & (F.col("expected") == e)).cast("int"))
    g = verdicts.groupBy(key).agg(n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, False).alias("tn"))
    ratio = lambda a: F.when(F.col("tp") + F.col(a) > 0, F.col("tp") / (F.col("tp") + F.col(a)))
    return g.select(key, ratio("tn").alias("precision"), ratio("fp").alias("recall"))


def impacted_entrypoints(found: DataFrame, bridge: DataFrame) -> DataFrame:
    """change_id, ep, reason: what the fact store says of a change. found: evidence, change_id, ep of body, call site and one edge; bridge: change_id, ep, class_name. Reasons are joined by ``+``, direct ones first."""
    direct = found.select("change_id", "ep", F.lit(0).alias("o"), F.col("evidence").alias("reason"))
    rows = direct.unionByName(bridge.select("change_id", "ep", F.lit(1).alias("o"), F.concat(F.lit("python_class_callgraph_bridge:"), "class_name").alias("reason"))).distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o", "reason"))), lambda x: x["reason"])
    return rows.groupBy("change_id", "ep").agg(F.array_join(ordered, "+").alias("reason"))


def _numbered(ranges: DataFrame, number: str) -> DataFrame:
    """The distinct ranges with a number each. Written, so a number stays."""
    return written(ranges.dropna().distinct().withColumn(number, F.monotonically_increasing_id()), "ranges")


def _alike(rows: DataFrame, ranges: DataFrame, met: DataFrame, key: str, number: str, name: str) -> DataFrame:
    """key, name: the numbers of the key's ranges that meet any of the other side. Keys with equal numbers meet the same."""
    some = ranges.join(met.select(number).distinct(), number, "left_semi")
    found = rows.join(some, [c for c in ranges.columns if c != number])
    return written(found.groupBy(key).agg(F.array_sort(F.collect_set(number)).alias(name)), "alike")


def deletion_changes(deleted: DataFrame, old: DataFrame, impacted: DataFrame) -> DataFrame:
    """change_id, status, ep, rerun, reason for deleted ranges (change_id, path, first_line, last_line).

    Entry points of the base (ep, file, start_line, end_line) in the range are deleted; others that the fact store links to it (impacted: change_id, ep, reason) are
    modified and run again; a range with neither is one row without impact. Distinct ranges meet distinct ranges; changes and entry points are paired by the sets of
    ranges that they have, so each pair comes once.
    """
    place = F.concat(P.trimmed(F.col("path")), F.lit(":"), "first_line", F.lit("-"), "last_line")
    places = deleted.select("change_id", place.alias("_place"))
    changed = deleted.select("change_id", P.trimmed(F.col("path")).alias("_file"), "first_line", "last_line")
    points = old.select("ep", P.trimmed(F.col("file")).alias("_file"), "start_line", "end_line")
    lines, bodies = _numbered(changed.drop("change_id"), "_lines"), _numbered(points.drop("ep"), "_body")
    meet = P.overlaps(F.col("start_line"), F.col("end_line"), F.col("first_line"), F.col("last_line"))
    met = written(lines.join(bodies, "_file").where(meet).select("_lines", "_body"), "met")
    changes, eps = _alike(changed, lines, met, "change_id", "_lines", "_changes"), _alike(points, bodies, met, "ep", "_body", "_eps")
    sets = lambda of, one, many: of.select(many).distinct().select(many, F.explode(many).alias(one))
    pairs = written(met.join(sets(changes, "_lines", "_changes"), "_lines").join(sets(eps, "_body", "_eps"), "_body").select("_changes", "_eps").distinct(), "pairs")
    # Only the rows of the result are as many as changes times entry points: no step after them sorts, sends or compares them.
    gone = pairs.join(changes.join(places, "change_id"), "_changes").join(eps, "_eps")
    rest = impacted.join(places, "change_id").join(changes, "change_id", "left").join(eps, "ep", "left").join(pairs, ["_changes", "_eps"], "left_anti")
    some = changes.select("change_id").union(rest.select("change_id")).distinct()
    row = lambda df, status, ep, rerun, reason: df.select("change_id", F.lit(status).alias("status"), ep.alias("ep"), F.lit(rerun).alias("rerun"), reason.alias("reason"))
    parts = [
        row(gone, "deleted", F.col("ep"), False, F.concat(F.lit("deleted_base_coordinate: "), "_place")),
        row(rest, "modified", F.col("ep"), True, F.concat("reason", F.lit(": "), "_place")),
        row(places.join(some, "change_id", "left_anti"), "no_ep_impact", F.lit(None).cast("long"), False, F.concat(F.lit("db_no_ep_fact: "), "_place")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


class UnsafePlan(ValueError):
    """An ep-only plan that would miss something."""


def final_mode(mode: str, changes: DataFrame, allow: DataFrame, fallbacks: DataFrame, head: DataFrame) -> tuple[DataFrame, bool]:
    """(allow list, whether the whole head runs). allow: key, reason; fallbacks: reason; changes: status; head: entry points with their key.

    With any fallback, auto and full-on-fallback run every entry point of the head. ep-only takes no risk: it fails on a fallback, on an added
    or unknown change, and on an empty allow list unless all changes are without impact.
    """
    reasons = [r["reason"] for r in fallbacks.select("reason").distinct().orderBy("reason").limit(20).collect()]
    if reasons and mode in ("auto", "full-on-fallback"):
        full = head.select("key", F.lit("; ".join(["full_head_fallback", *reasons])).alias("reason"))
        return allow.select("key", "reason").unionByName(full).distinct(), True
    if mode == "ep-only":
        bad = changes.where(F.col("status").isin("added", "unknown")).limit(1).count() > 0
        quiet = changes.limit(1).count() > 0 and changes.where("status != 'no_ep_impact'").limit(1).count() == 0
        if reasons or bad or (allow.limit(1).count() == 0 and not quiet):
            raise UnsafePlan(reasons[0] if reasons else "the allow list is empty or unsafe")
    missing = head.select("key").join(allow.select("key"), "key", "left_anti").limit(1).count()
    return allow.select("key", "reason"), head.limit(1).count() > 0 and not missing


def remapped_root(uri: Column, base: str, head: str) -> Column:
    """URIs under the base's source root as URIs under the head's, whatever the case and the slashes; others, and all where the roots are the same, as they are. The scheme's slashes stay."""
    plain = lambda x: re.sub(r"^/+", "", re.sub(r"^file://", "", x).replace("\\", "/")).rstrip("/")
    base, head = plain(base), plain(head)
    if not base or not head or base.lower() == head.lower():
        return uri
    raw = F.regexp_replace(F.replace(F.regexp_replace(uri, "^file://", ""), F.lit("\\"), F.lit("/")), "^/+", "")
    under = (F.lower(raw) == base.lower()) | F.startswith(F.lower(raw), F.lit(base.lower() + "/"))
    mapped = F.concat(F.lit(head), F.substring(raw, F.lit(len(base) + 1), F.length(raw)))
    mark = F.when(F.startswith(uri, F.lit("file:///")), "file:///").when(F.startswith(uri, F.lit("file://")), "file://").when(F.startswith(uri, F.lit("/")), "/").otherwise("")
    return F.when(under, F.concat(mark, mapped)).otherwise(uri)
