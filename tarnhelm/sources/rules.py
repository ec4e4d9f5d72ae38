"""Rule files as tables: sources, sinks, sanitizers, one row a rule with its place in the file, and argument selectors beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..functions.patterns import selectors

RULES = "rule_id string, rule_order int, section string, type string, checkers array<string>, fsig string, fregex string, callee_type string, arg_num int, path string, scope_file string, scope_func string, class_name string, kind string, sanitizer_ids array<string>, operator string, regex string, `to` string"
SELECTORS = "rule_id string, sel_type string, sel_index int, sel_name string"


def _kinds(rule: dict) -> str | None:
    kind = rule.get("kind") or rule.get("attribute")
    return ",".join(kind) if isinstance(kind, list) else kind


def flatten(rules: list[dict]) -> tuple[list[tuple], list[tuple]]:
    """(rules, selectors) of parsed rule files. Sections may be lists or maps from type to list."""
    rows: list[tuple] = []
    args: list[tuple] = []
    for group in rules:
        checkers = group.get("checkerIds") or []
        for section in ("sources", "sinks", "sanitizers", "entrypoints", "preconditions"):
            part = group.get(section) or {}
            for kind, items in (part if isinstance(part, dict) else {section: part}).items():
                for x in items or []:
                    n = len(rows)
                    name = x.get("id") or f"{section}-{n}"
                    rows.append((name, n, section, kind, checkers, x.get("fsig"), x.get("fregex"), x.get("calleeType"), x.get("argNum"), x.get("path"), x.get("scopeFile"), x.get("scopeFunc"), x.get("className"), _kinds(x), x.get("sanitizerIds") or [], x.get("operator"), x.get("regex"), x.get("to")))
                    args += [(name, *s) for s in selectors(x)]
    return rows, args


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rules, selectors) of the JSON files at ``path``, read by Spark, so in any store. Rules are written by hand and small; the driver flattens them."""
    texts = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    parsed = map(json.loads, texts)
    groups = [g for x in parsed for g in (x if isinstance(x, list) else [x])]
    rows, args = flatten(groups)
    return spark.createDataFrame(rows, RULES), spark.createDataFrame(args, SELECTORS)


def of_checkers(rules: DataFrame, checkers: list[str]) -> DataFrame:
    """The rules of these checkers; rules that name none belong to all."""
    from pyspark.sql import functions as F

    return rules.where((F.size("checkers") == 0) | F.arrays_overlap("checkers", F.array(*map(F.lit, checkers))))
