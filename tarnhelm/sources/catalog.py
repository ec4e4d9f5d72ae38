"""Fact tables by name, with what their columns mean when they are absent."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns that operators read, by table.
SCHEMAS: dict[str, str] = {
    "entrypoints": "id long, ep_id string, file string, func_name string, start_line int, end_line int, ep_type string, framework string, attribute string",
    "nodes": "id long, ep_id long, qid string, sid string, file string, line int, col int, class_name string, node_role string",
    "edges": "id long, ep_id long, from_node_id long, to_node_id long, edge_type string",
    "node_tags": "id long, node_id long, tag string, value string, provenance string",
    "builtin_sources": "id long, node_id long, ep_id string, source_type string, file string, line int",
    "callgraph": "id long, ep_id long, caller_func string, callee_qid string, callee_dotted_path string, callee_symbol_id string, call_site_file string, call_site_line int, callee_start_line int, callee_end_line int, call_node_id long, return_node_id long, resolution_kind string, confidence int",
    "symbols": "symbol_id string, qid string, sid string, vtype string, file string, start_line int, end_line int, provenance string",
    "call_args": "id long, call_node_id long, arg_index int, arg_node_id long, arg_name string, is_receiver int, provided int",
    "source_files": "file_path string, content string",
    "dataflow_metadata": "key string, value string",
    "go_interface_bindings": "id long, consumer_ep_id long, callgraph_id long, impl_method_qid string, impl_method_file string, impl_method_start_line int, impl_method_end_line int, dispatch_kind string, dispatch_confidence int",
    "module_deps": "id long, consumer_ep_id long, imported_file string, dep_kind string, confidence int",
    "handler_response_flow_facts": "id long, consumer_ep_id long, producer_callgraph_id long, producer_call_node_id long, producer_return_node_id long, producer_err_node_id long, producer_result_node_id long, receiver_call_node_id long, receiver_node_id long, payload_call_node_id long, payload_node_id long, ordering_kind string, evidence_kind string, confidence int",
    "impact_path_provenance": "id long, consumer_ep_id long, changed_file string, changed_line int, use_file string, use_line int, path_index int, path_length int, path_edge_ids string",
    "mutating_receiver_alias": "id long, consumer_ep_id long, call_site_file string, call_site_line int, receiver_vtype string, mutation_method string, confidence int",
    "decl_use_impact_edges": "id long, consumer_ep_id long, changed_file string, changed_start_line int, changed_end_line int, use_kind string, confidence int",
}


#: What rows are looked up by.
LOOKUPS: dict[str, tuple[str, ...]] = {
    "entrypoints": ("file", "start_line"), "nodes": ("file", "line"), "edges": ("from_node_id",), "callgraph": ("call_site_file", "call_site_line"), "builtin_sources": ("file", "line"), "symbols": ("file", "start_line"), "module_deps": ("imported_file",),
    "call_args": ("call_node_id",), "node_tags": ("node_id",), "source_files": ("file_path",), "go_interface_bindings": ("impl_method_file",), "decl_use_impact_edges": ("changed_file",),
}


def changed_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    """file_path, content of files whose content is not the cached one. cache: file_path, digest (sha-256 of the content), as ``digests`` gives it."""
    return files.withColumn("digest", F.sha2("content", 256)).join(cache.select("file_path", "digest"), ["file_path", "digest"], "left_anti").select("file_path", "content")


def digests(files: DataFrame) -> DataFrame:
    return files.select("file_path", F.sha2("content", 256).alias("digest"))


class FactCatalog:
    """Tables of one analysis run. A missing table is empty and a missing column is null, and ``has`` still tells which were there."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]):
        self.spark, self.tables = spark, dict(tables)

    @classmethod
    def read(cls, spark: SparkSession, folder: str, names: list[str]) -> FactCatalog:
        return cls(spark, {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})

    def has(self, table: str, *columns: str) -> bool:
        return table in self.tables and set(columns) <= set(self.tables[table].columns)

    def __getitem__(self, table: str) -> DataFrame:
        wanted = [x.rsplit(" ", 1) for x in SCHEMAS[table].split(", ")]
        if table not in self.tables:
            return self.spark.createDataFrame([], SCHEMAS[table])
        df = self.tables[table]
        return df.withColumns({c: F.lit(None).cast(kind) for c, kind in wanted if c not in df.columns})

    def write(self, folder: str, mode: str = "errorifexists", ordered: bool = False) -> None:
        """Each table as Parquet; Spark's committer moves finished files into place. ``ordered``: rows are range-partitioned and sorted by the column that lookups use, so that file statistics skip what they don't need."""
        for name, df in self.tables.items():
            by = [c for c in LOOKUPS.get(name, ()) if c in df.columns]
            df = df.repartitionByRange(*by).sortWithinPartitions(*by) if ordered and by else df
            df.write.mode(mode).parquet(f"{folder}/{name}.parquet")

    def views(self) -> None:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
