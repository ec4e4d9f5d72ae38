"""Read-only SQL over the fact tables: one SELECT or WITH ... SELECT, with positional or named parameters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Words that a read-only statement may not hold, even as names.
FORBIDDEN = frozenset("insert update delete replace create drop alter attach detach pragma vacuum reindex analyze begin commit rollback savepoint release truncate".split())

_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\$[A-Za-z_]\w*|[A-Za-z_]\w*|\s+|.", re.S)


class NotReadOnly(ValueError):
    pass


def tokens(sql: str) -> list[str]:
    """Words and signs, without comments, strings, quoted names and white space."""
    return [t for t in _TOKEN.findall(sql) if not t.isspace() and t[:2] not in ("--", "/*") and t[0] not in "'\"`"]


def validate(sql: str) -> None:
    found = tokens(sql)
    while found and found[-1] == ";":
        found.pop()
    if ";" in found:
        raise NotReadOnly("only one statement is allowed")
    words = [t.lower() for t in found]
    if not words or words[0] not in ("select", "with"):
        raise NotReadOnly("only SELECT is allowed")
    if bad := FORBIDDEN.intersection(words):
        raise NotReadOnly(f"only SELECT is allowed; found {', '.join(sorted(bad))}")
    if words[0] == "with":
        depth = 0
        outer = []
        for w in words:
            depth += (w == "(") - (w == ")")
            if not depth and w in ("select", "values", "table", "from"):
                outer.append(w)
        if not outer or outer[0] != "select":
            raise NotReadOnly("WITH must resolve to a SELECT")


def validate_params(params) -> None:
    if params is not None and not isinstance(params, (list, tuple, dict)):
        raise TypeError("parameters are a list or named")


def named_markers(sql: str) -> str:
    """``$name`` outside strings and comments as ``:name``."""
    return "".join(":" + t[1:] if re.fullmatch(r"\$[A-Za-z_]\w*", t) else t for t in _TOKEN.findall(sql))


def query(spark: SparkSession, sql: str, params=None) -> DataFrame:
    """The checked statement over the session's views."""
    validate(sql)
    validate_params(params)
    args = {k.lstrip("$:@"): v for k, v in params.items()} if isinstance(params, dict) else list(params) if params else None
    return spark.sql(named_markers(sql).rstrip().rstrip(";"), args=args)


def metadata(rows: dict[str, str]) -> dict[str, object]:
    """Snapshot metadata; while a writer runs, the commit is 0 and has no time."""
    state = rows.get("run_state", "running")
    done = state != "running"
    return {"commitSeq": int(rows.get("commit_seq", 0)) if done else 0, "committedAt": rows.get("committed_at", "") if done else "", "state": state}
