"""Source trees as tables: files, AST nodes, calls, functions, entry points. Python by the standard library's parser; other languages as text rows."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a scan reads and what it passes over.
EXTENSIONS = (".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".java", ".php", ".vue")
IGNORED = (".git", "node_modules", "dist", "build", "target", "vendor", "__pycache__", ".venv")

AST_NODES = "file string, node_id int, parent_id int, depth int, type string, name string, slot string, pos int, start_line int, end_line int, col int, literal string"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """file_path, content of the source files below ``root``; ignored folders and other extensions are left out before contents are decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.col("path")
    wanted = F.lit(False)
    for x in EXTENSIONS:
        wanted = wanted | F.endswith(F.lower(path), F.lit(x))
    for x in IGNORED:
        wanted = wanted & ~F.contains(path, F.lit(f"/{x}/"))
    return files.where(wanted).select(path.alias("file_path"), F.decode("content", "UTF-8").alias("content"))


def _name(node: ast.AST) -> str | None:
    for field in ("name", "id", "attr", "arg", "module"):
        if isinstance(value := getattr(node, field, None), str):
            return value
    return None


def flatten(file: str, content: str | None) -> list[tuple]:
    """Rows of one Python file in preorder; none if it doesn't parse."""
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows: list[tuple] = []
    stack: list[tuple[ast.AST, int, int, str, int]] = [(tree, -1, 0, "", 0)]
    while stack:
        node, parent, depth, slot, pos = stack.pop()
        me = len(rows)
        literal = repr(node.value) if isinstance(node, ast.Constant) else None
        rows.append((file, me, parent, depth, type(node).__name__, _name(node), slot, pos, getattr(node, "lineno", 0), getattr(node, "end_lineno", 0) or 0, getattr(node, "col_offset", 0), literal))
        below: list[tuple] = []
        for field, value in ast.iter_fields(node):
            for i, x in enumerate(value if isinstance(value, list) else [value]):
                if isinstance(x, ast.AST) and not isinstance(x, (ast.expr_context, ast.operator, ast.boolop, ast.cmpop, ast.unaryop)):
                    below.append((x, me, depth + 1, field, i))
        stack += reversed(below)
    return rows


def parse_python(files: DataFrame) -> DataFrame:
    """AST rows of the Python files of ``files`` (file_path, content)."""
    names = [x.split()[0] for x in AST_NODES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file_path"], batch["content"], strict=True):
                yield pd.DataFrame(flatten(file, content), columns=names)

    return files.where(F.endswith("file_path", F.lit(".py"))).select("file_path", "content").mapInPandas(run, AST_NODES)


def _dotted(node: ast.AST | None) -> str | None:
    parts: list[str] = []
    while node is not None:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Name):
            return ".".join([node.id, *reversed(parts)])
        else:
            return None
    return None


FUNCTIONS = "file string, class_name string, func_name string, start_line int, end_line int, params array<string>, decorators array<struct<name:string,call:boolean,first:string>>, bases array<string>"
CALLS = "file string, caller string, callee string, line int, col int, n_args int"


def _each_function(tree: ast.AST):
    stack: list[tuple[ast.AST, str | None, list[str]]] = [(tree, None, [])]
    while stack:
        node, owner, bases = stack.pop()
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield x, owner, bases
                stack.append((x, None, []))
            elif isinstance(x, ast.ClassDef):
                above = [b for b in map(_dotted, x.bases) if b]
                yield x, x.name, above
                stack.append((x, x.name, above))
            else:
                stack.append((x, owner, bases))


def _parsed(batch: pd.DataFrame):
    for file, content in zip(batch["file_path"], batch["content"], strict=True):
        try:
            yield file, ast.parse(content or "")
        except (SyntaxError, ValueError, RecursionError):
            continue


def functions(files: DataFrame) -> DataFrame:
    """A row for each function or method, with its decorators and its class's bases; and one for each class, without a func_name."""
    names = [x.split()[0] for x in FUNCTIONS.split(", ")]

    def first(d: ast.AST) -> str | None:
        return d.args[0].value if isinstance(d, ast.Call) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, tree in _parsed(batch):
                for f, owner, bases in _each_function(tree):
                    marks = [{"name": _dotted(d) or "", "call": isinstance(d, ast.Call), "first": first(d)} for d in f.decorator_list]
                    own = isinstance(f, ast.ClassDef)
                    params = [] if own else [a.arg for a in (*f.args.posonlyargs, *f.args.args)]
                    rows.append((file, owner, None if own else f.name, f.lineno, f.end_lineno or f.lineno, params, marks, bases))
            yield pd.DataFrame(rows, columns=names)

    return files.where(F.endswith("file_path", F.lit(".py"))).select("file_path", "content").mapInPandas(run, FUNCTIONS)


def calls(files: DataFrame) -> DataFrame:
    """A row for each call: the function it stands in, the dotted name it calls."""
    names = [x.split()[0] for x in CALLS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, tree in _parsed(batch):
                inside: list[tuple[ast.AST, str]] = [(tree, "")]
                while inside:
                    node, owner = inside.pop()
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        owner = f"{owner}.{node.name}" if owner else node.name
                    if isinstance(node, ast.Call) and (name := _dotted(node.func)):
                        rows.append((file, owner, name, node.lineno, node.col_offset, len(node.args) + len(node.keywords)))
                    inside += [(x, owner) for x in ast.iter_child_nodes(node)]
            yield pd.DataFrame(rows, columns=names)

    return files.where(F.endswith("file_path", F.lit(".py"))).select("file_path", "content").mapInPandas(run, CALLS)


def imports(nodes: DataFrame) -> DataFrame:
    """file, module, name of each import, from AST rows."""
    alias = nodes.where("type = 'alias'").select("file", F.col("parent_id").alias("node_id"), F.col("name").alias("imported"))
    heads = nodes.where("type in ('Import', 'ImportFrom')").select("file", "node_id", "type", F.col("name").alias("module"))
    return alias.join(heads, ["file", "node_id"]).select("file", F.when(F.col("type") == "Import", F.col("imported")).otherwise(F.col("module")).alias("module"), "imported")


def find_all(nodes: DataFrame, match, prune=None) -> DataFrame:
    """AST rows for which ``match`` (a column) holds, without those that ``prune`` marks; what is below a pruned node is still searched."""
    found = nodes.where(match)
    return found if prune is None else found.where(~prune)


def closest(nodes: DataFrame, line: int) -> DataFrame:
    """In each file, the innermost node at a line, nearest to its start."""
    held = nodes.where((F.col("start_line") <= line) & (F.col("end_line") >= line))
    key = F.struct((F.lit(0) - F.abs(F.col("start_line") - line)).alias("near"), "depth", (-F.col("node_id")).alias("first"))
    return held.groupBy("file").agg(F.max_by(F.struct("node_id", "type", "name", "start_line"), key).alias("n")).select("file", "n.*")
