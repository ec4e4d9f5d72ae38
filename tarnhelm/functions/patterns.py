"""Name patterns: dotted patterns, call-chain patterns, index selectors."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dotted_regex(pattern: str) -> str:
    """A Java regex of a dotted pattern, for names with a dot before them. ``*`` is one segment. ``**`` at the end is the rest. ``**`` elsewhere runs to the first segment equal to the next literal, without ever going on to a later one; a ``*`` after it is a literal star there, then one segment."""
    parts = pattern.split(".")
    while len(parts) > 1 and parts[-1] == "**" and parts[-2] == "**":
        parts.pop()
    out: list[str] = []
    quote = lambda s: "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" if s else ""
    for i, part in enumerate(parts):
        if part == "**":
            if i == len(parts) - 1:
                out.append("(?:\\..*)?")
            else:
                nxt = quote(parts[i + 1])
                out.append(f"(?:\\.(?!{nxt}(?:\\.|$))[^.]*)*+")
        elif part == "*":
            out.append("\\." + (quote("*") if i and parts[i - 1] == "**" else "[^.]*"))
        else:
            out.append("\\." + quote(part))
    return "^" + "".join(out) + "$"


def dotted(qid: Column, pattern: str) -> Column:
    """``qid`` matches the dotted pattern."""
    return F.concat(F.lit("."), qid).rlike("(?s)" + dotted_regex(pattern))


def chain_matches(chain: Column, segments: Column) -> Column:
    """A call chain, root to leaf, of (kind, name) matches the segments of a signature, from the leaf back.

    Kinds: id, literal, this, new at the root; member, call, new after it. A segment is a name, a prefix with ``*``, or
    ``**`` for all that is left. A call whose receiver is still to come may end the signature; any other kind
    must use up the signature exactly at the root.
    """
    name = lambda el, x: F.when(el.endswith("*"), F.startswith(x, F.substring(el, F.lit(1), F.length(el) - 1))).otherwise(x == el)
    steps = F.reverse(F.transform(chain, lambda x, i: F.struct(x["kind"].alias("kind"), F.coalesce(x["name"], F.lit("")).alias("name"), (i == 0).alias("root"))))
    state = lambda i, done: F.struct(i.cast("int").alias("i"), done.cast("int").alias("done"))  # noqa: E731  done: 0 going on, 1 matched, 2 not

    def step(s: Column, x: Column) -> Column:
        el = F.try_element_at(segments, s["i"] + 1)
        same = F.coalesce(name(el, x["name"]), F.lit(False))
        bare = x["root"] & x["kind"].isin("id", "literal", "this", "new")
        done = (
            F.when(s["done"] > 0, s["done"])
            .when(s["i"] < 0, 2)
            .when(el == "**", 1)
            .when(~same, 2)
            .when(x["root"], F.when(s["i"] == 0, 1).otherwise(2))
            .when((x["kind"] == "call") & (s["i"] == 0), 1)
            .otherwise(0)
        )
        return state(F.when(bare, s["i"]).otherwise(s["i"] - 1), done)

    return F.aggregate(steps, state(F.size(segments) - 1, F.lit(0)), step)["done"] == 1


def selected(n: Column, rule: str | None) -> Column:
    """The positions 0 ... n - 1 that an index rule selects: ``*``, ``2``, ``0,2``, ``1:3`` or a mixture. An end that isn't a position counts as n."""
    every = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    if not rule or rule == "*":
        return every

    def number(text: str) -> int | None:
        m = re.match(r"\s*([+-]?\d+)", text)
        return int(m[1]) if m and int(m[1]) >= 0 else None

    def one(part: str) -> Column:
        if ":" in part:
            a, b = (number(x) for x in part.split(":")[:2])
            start = F.when(F.lit(a if a is not None else -1).between(0, n - 1), F.lit(a or 0)).otherwise(0)
            stop = F.when(F.lit(b if b is not None else -1).between(0, n - 1), F.lit(b or 0)).otherwise(n)
            return F.filter(every, lambda i: (i >= start) & (i < stop))
        k = number(part)
        return F.filter(every, lambda i: i == F.lit(-1 if k is None else k))

    return F.concat(*map(one, rule.split(",")))


def selectors(rule: dict) -> list[tuple[str, int | None, str | None]]:
    """An argument rule as (type, index, name): position, keyword, all, or receiver (index -1). Reads ``selectors``, or the older ``args`` and ``positions``."""
    out: list[tuple[str, int | None, str | None]] = []
    for x in rule.get("selectors") or [*(rule.get("args") or []), *(rule.get("positions") or [])]:
        if isinstance(x, dict):
            kind = x.get("type", "position")
            out.append((kind, x.get("index", -1 if kind == "receiver" else None), x.get("name")))
        elif x in ("*", "all"):
            out.append(("all", None, None))
        elif x == -1 or x in ("this", "receiver", "-1"):
            out.append(("receiver", -1, None))
        elif isinstance(x, int) or str(x).isdigit():
            out.append(("position", int(x), None))
        else:
            out.append(("keyword", None, str(x)))
    return list(dict.fromkeys(out))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _first_replaced(text: Column, old: str, new: str) -> Column:
    def cut(x: Column) -> Column:
        at = F.instr(x, old)
        return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), F.lit(new), F.substring(x, at + len(old), F.length(x)))).otherwise(x)

    return _let(text, cut)


def without_parentheses(text: Column) -> Column:
    """Without parentheses and all that is in them, nested ones too; an open one takes the rest with it."""
    start = F.struct(F.lit(0).alias("level"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        level = F.when(c == "(", s["level"] + 1).when(c == ")", F.greatest(s["level"] - 1, F.lit(0))).otherwise(s["level"])
        return F.struct(level.alias("level"), F.when((s["level"] == 0) & ~c.isin("(", ")"), F.concat(s["out"], c)).otherwise(s["out"]).alias("out"))

    return F.when(text.rlike("[()]"), F.aggregate(F.split(text, ""), start, step)["out"]).otherwise(text)


# Marks inside qualified ids.
BLOCK_MARKS, BLOCK_STARTS = ("<block", "<fileblock_", "<object", "__tmp"), ("<block", "<fileblock_", "<object_", "__tmp")
GLOBAL_MARKS = ("<global>.", "packageManager.", "moduleManager.", "fileManager.")
ALIASES = (("Egg.Application", "app"), ("Egg.Context", "ctx"))
LIBRARY_PREFIX = "syslib_from."


def without_blocks(qid: Column) -> Column:
    """Without the segments of blocks, and those that are the one before and ``_scope``, if there is any mark of a block."""
    parts = F.split(qid, r"\.")
    before = lambda i: F.when(i == 0, "NaN").otherwise(F.element_at(parts, F.greatest(i, F.lit(1))))
    block = lambda x: F.coalesce(*(F.when(F.startswith(x, F.lit(m)), True) for m in BLOCK_STARTS), F.lit(False))
    kept = F.filter(parts, lambda x, i: ~block(x) & (x != F.concat(before(i), F.lit("_scope"))))
    return F.when(F.greatest(*(F.instr(qid, m) for m in BLOCK_MARKS)) > 0, F.array_join(kept, ".")).otherwise(qid)


def unmarked_qid(qid: Column) -> Column:
    """A qualified id without marks but with its path: blocks, instances, copies, global prefixes, the prefix of unresolved imports, clones."""
    qid = _let(qid, without_blocks)
    for mark in ("instance_", "copied"):
        qid = F.regexp_replace(qid, f"<{mark}[^.]*?_endtag>", "")
    for mark in GLOBAL_MARKS:
        qid = _first_replaced(qid, mark, "")
    return F.regexp_replace(F.regexp_replace(qid, "^" + re.escape(LIBRARY_PREFIX), ""), "<cloned[^.]*?_endtag>", "")


def unified_qid(qid: Column) -> Column:
    """A qualified id without what differs between equal symbols, in this order: path separators, framework aliases, parentheses, blocks, instances, copies, global prefixes, clones, the prefix of unresolved imports."""
    qid = F.replace(F.regexp_replace(qid, "^/", ""), F.lit("/"), F.lit("."))
    for old, new in ALIASES:
        qid = _first_replaced(qid, old, new)
    qid = _let(_let(qid, without_parentheses), without_blocks)
    for mark in ("instance_", "copied"):
        qid = F.regexp_replace(qid, f"<{mark}[^.]*?_endtag>", "")
    for mark in GLOBAL_MARKS:
        qid = _first_replaced(qid, mark, "")
    qid = F.regexp_replace(qid, "<cloned[^.]*?_endtag>", "")
    return F.regexp_replace(qid, "^" + re.escape(LIBRARY_PREFIX), "")


def summary_function(text: Column) -> dict[str, Column]:
    """The parts of ``qual\\n[file : start_end]``, where ``\\n`` is written out."""
    pattern = r"^(.*?)\\n\[(.*?) : (\d+)_(\d+)\]$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return {"qual": part(1), "file": part(2), "start_line": part(3).cast("int"), "end_line": part(4).cast("int")}
