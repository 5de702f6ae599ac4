"""Symbols, calls, imports and variables of source files.

Python is parsed in its tasks with the standard library's ``ast``; other languages are
read by their tokens (``sources.lexer``, ``sources.syntax``). Whatever crosses
files (imports, calls, data flow) is resolved by joins in ``operators.resolve``."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "file_id string, seq int, what string, scope string, name string, kind string, start_line int, end_line int, signature string, receiver string, docs string, bases array<string>"


def _signature(args: ast.arguments) -> str | None:
    """Types of the parameters; null if one besides self and cls has none."""
    every = [a for a in [*args.posonlyargs, *args.args, *args.kwonlyargs] if a.arg not in ("self", "cls")]
    if any(a.annotation is None for a in every):
        return None
    return "(" + ",".join(ast.unparse(a.annotation).split(".")[-1] for a in every) + ")"


def _python_rows(file_id: str, source: str | None) -> list[tuple]:
    """Rows of one file; of one that can't be parsed or is nested too deeply one row that tells the error."""
    try:
        return _facts_of(file_id, source)
    except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError) as failed:
        told = getattr(failed, "msg", None) or str(failed)
        return [(file_id, 0, "error", file_id, told, type(failed).__name__, getattr(failed, "lineno", None), None, None, None, None, None)]


def _facts_of(file_id: str, source: str | None) -> list[tuple]:
    """Symbols (class, function), calls, imports, variables and what they derive from."""
    out: list[tuple] = []

    def add(what, scope, name, kind, node, signature=None, receiver=None, docs=None, bases=None):
        out.append((file_id, len(out), what, scope, name, kind, getattr(node, "lineno", None), getattr(node, "end_lineno", None), signature, receiver, docs, bases))

    def refs(scope, var, value):
        for node in [value] if not isinstance(value, (ast.BoolOp, ast.BinOp, ast.Tuple, ast.List)) else ast.walk(value):
            if isinstance(node, ast.Name):
                add("derives", scope, node.id, "identifier", node, signature=var)
            elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
                add("derives", scope, node.func.id, "call", node, signature=var)
            elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
                add("derives", scope, node.func.attr, "call", node, signature=var, receiver=ast.unparse(node.func.value))
            elif isinstance(node, ast.Attribute):
                add("derives", scope, node.attr, "attribute", node, signature=var, receiver=ast.unparse(node.value))

    def variables(scope, body):
        for node in (n for s in body for n in ast.walk(s)):
            targets, value = [], getattr(node, "value", None)
            if isinstance(node, ast.Assign):
                targets = node.targets
            elif isinstance(node, (ast.AnnAssign, ast.AugAssign)):
                targets = [node.target]
            elif isinstance(node, (ast.For, ast.AsyncFor)):
                targets, value = [node.target], node.iter
            elif isinstance(node, (ast.With, ast.AsyncWith)):
                targets = [i.optional_vars for i in node.items if i.optional_vars]
                value = node.items[0].context_expr
            for target in targets:
                for leaf in ast.walk(target):
                    if isinstance(leaf, ast.Name):
                        add("variable", scope, leaf.id, "local", leaf)
                        if value is not None:
                            refs(scope, leaf.id, value)

    def function(node, scope):
        name = node.name + (_signature(node.args) or "")
        own = f"{scope}::{name}"
        add("symbol", scope, node.name, "function", node, _signature(node.args), docs=ast.get_docstring(node))
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            if a.arg not in ("self", "cls"):
                add("variable", own, a.arg, "parameter", a, ast.unparse(a.annotation) if a.annotation else None)
        for call in ast.walk(node):
            if isinstance(call, ast.Call) and isinstance(call.func, ast.Name):
                add("call", own, call.func.id, "bare", call)
            elif isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute):
                add("call", own, call.func.attr, "attribute", call, receiver=ast.unparse(call.func.value))
        variables(own, node.body)

    for node in ast.parse(source).body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(node, file_id)
        elif isinstance(node, ast.ClassDef):
            add("symbol", file_id, node.name, "class", node, docs=ast.get_docstring(node), bases=[ast.unparse(b) for b in node.bases])
            own = f"{file_id}::{node.name}"
            for member in node.body:
                if isinstance(member, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    function(member, own)
                elif isinstance(member, ast.AnnAssign) and isinstance(member.target, ast.Name):
                    add("variable", own, member.target.id, "field", member, ast.unparse(member.annotation))
        elif isinstance(node, ast.Import):
            for a in node.names:
                add("import", file_id, a.asname or a.name.split(".")[-1], "module", node, receiver=a.name)
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                add("import", file_id, a.asname or a.name, "from", node, receiver="." * node.level + (node.module or ""), signature=a.name)
    return out


def python_facts(sources: DataFrame) -> DataFrame:
    """All facts of the Python files among sources (file_id, content, language)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.strip().split(" ")[0] for c in ROWS.split(", ")]
        for frame in frames:
            rows = [r for file_id, content in zip(frame["file_id"], frame["content"], strict=True) for r in _python_rows(file_id, content)]
            yield pd.DataFrame(rows, columns=columns).astype({"start_line": "Int32", "end_line": "Int32", "seq": "int32"})

    return sources.where("language = 'python'").select("file_id", "content").mapInPandas(run, ROWS)


def errors(facts: DataFrame) -> DataFrame:
    """file_id, error, message, line of the files that have no other facts because of an error."""
    return facts.where("what = 'error'").select("file_id", F.col("kind").alias("error"), F.col("name").alias("message"), F.col("start_line").alias("line"))
