"""Outlines of long Python files: what they import, define and document, without bodies."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _head(lines: list[str], node) -> list[str]:
    """Decorators and the header of a definition, up to its body."""
    first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
    last = node.body[0].lineno if node.body[0].lineno > node.lineno else node.lineno
    end = last - 1 if node.body[0].lineno > node.lineno else last
    while end > node.lineno and not lines[end - 1].split("#")[0].rstrip().endswith(":"):
        end -= 1
    n = (node.end_lineno or node.lineno) - node.lineno + 1
    return [*lines[first - 1 : end - 1], f"{lines[end - 1]}  # {n} lines"]


def _outline(lines: list[str], body: list, pad: str) -> list[str]:
    out: list[str] = []
    for s in body:
        span = lines[s.lineno - 1 : s.end_lineno]
        if isinstance(s, (ast.Import, ast.ImportFrom)):
            out += span
        elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out += _head(lines, s)
            if doc := ast.get_docstring(s):
                out.append(f'{pad}    """{doc.strip().splitlines()[0]}"""')
            inner = _outline(lines, s.body, pad + "    ") if isinstance(s, ast.ClassDef) else []
            out += inner or [f"{pad}    ..."]
        elif isinstance(s, (ast.Assign, ast.AnnAssign)) and len(span) <= 2:
            out += span
        elif isinstance(s, (ast.If, ast.Try)):
            kept = [x for x in ast.walk(s) if isinstance(x, (ast.Import, ast.ImportFrom))]
            guard = isinstance(s, ast.If) and "__main__" in ast.unparse(s.test)
            if kept or guard:
                out += [span[0], *(lines[x.lineno - 1] for x in kept), *([f"{pad}    ..."] if guard else [])]
    return out


def outline(code: str) -> str | None:
    """The outline of a module, or None if it does not parse or has nothing to show."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return None
    doc = ast.get_docstring(tree)
    out = ([f'"""{doc.strip().splitlines()[0]}"""'] if doc else []) + _outline(code.splitlines(), tree.body, "")
    return "\n".join(out) + "\n" if out else None


@F.pandas_udf(T.StringType())
def outline_udf(code: pd.Series) -> pd.Series:
    return code.map(lambda c: outline(c) if c else None)


def definitions(code: str) -> dict[str, list[str]]:
    """Functions, classes, exports and called names of a module, each once and in order."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return {"functions": [], "classes": [], "exports": [], "call_sites": []}
    walk = list(ast.walk(tree))
    functions = [n.name for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    classes = [n.name for n in tree.body if isinstance(n, ast.ClassDef)]
    public = [f for f in functions if not f.startswith("_") or (f.startswith("__") and f.endswith("__"))]
    calls = dict.fromkeys(ast.unparse(n.func) for n in walk if isinstance(n, ast.Call))
    return {"functions": functions, "classes": classes, "exports": classes + public, "call_sites": list(calls)}


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("functions", "classes", "exports", "call_sites")]))
def definitions_udf(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([definitions(c or "") for c in code], columns=["functions", "classes", "exports", "call_sites"])
