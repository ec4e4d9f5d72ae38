"""Findings as documents: SARIF results, call chains, call graphs in JSON and DOT, and the index of a SARIF file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINE_CHARS = 200


def sarif_results(findings: DataFrame, steps: DataFrame) -> DataFrame:
    """finding, result (JSON): one SARIF result a finding, its trace in order. findings: finding, rule_id, level, message; steps: finding, pos, tag, file, line, code."""
    location = F.struct(
        F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.struct(F.substring("code", 1, LINE_CHARS).alias("text")).alias("snippet")).alias("region")).alias("physicalLocation"),
        F.struct(F.col("tag").alias("text")).alias("message"),
    )
    flows = steps.groupBy("finding").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(location.alias("location")).alias("l")))), lambda x: x["l"]).alias("locations"))
    j = findings.join(flows, "finding", "left")
    body = F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.when(F.col("locations").isNotNull(), F.array(F.element_at("locations", -1)["location"])).alias("locations"), F.array(F.struct(F.array(F.struct("locations")).alias("threadFlows"))).alias("codeFlows"),
    )
    return j.select("finding", F.to_json(body).alias("result"))


def sarif_index(results: DataFrame) -> DataFrame:
    """result_index, rule_id, file, line of each result of a SARIF document (doc: JSON)."""
    schema = "struct<runs:array<struct<results:array<struct<ruleId:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>>"
    runs = results.select(F.explode(F.from_json("doc", schema)["runs"]).alias("run"))
    each = runs.select(F.posexplode("run.results").alias("result_index", "r"))
    at = F.element_at("r.locations", 1)["physicalLocation"]
    return each.select("result_index", F.col("r.ruleId").alias("rule_id"), at["artifactLocation"]["uri"].alias("file"), at["region"]["startLine"].alias("line"))


def call_chains(frames: DataFrame) -> DataFrame:
    """finding, chain (JSON) of frames (finding, idx, function, file, line): the last frame is the sink, type 1; the others type 0."""
    last = F.max("idx").over(Window.partitionBy("finding"))
    item = F.struct("idx", F.struct((F.col("idx") == last).cast("int").alias("type"), "function", "file", "line").alias("f"))
    marked = frames.withColumn("_item", item)
    return marked.groupBy("finding").agg(F.to_json(F.transform(F.array_sort(F.collect_list("_item")), lambda x: x["f"])).alias("chain"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.text(path)
