"""Derived columns: ``df['new'] = <expression over df['col']>`` compiled to a Column, never executed as Python."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.columns import col

_MATH = {"log": F.log, "log1p": F.log1p, "log2": F.log2, "log10": F.log10, "sqrt": F.sqrt, "abs": F.abs, "exp": F.exp, "floor": F.floor, "ceil": F.ceil}
_CASTS = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}


class Rejected(ValueError):
    """The snippet holds something that isn't allowed."""


def _column(node: ast.AST) -> str | None:
    if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id == "df" and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
        return node.slice.value
    return None


class _Compiler:
    """(Column, whether it is text) of each node."""

    def __init__(self, types: dict[str, str]):
        self.types, self.used = types, []

    def visit(self, n: ast.AST) -> tuple[Column, bool]:
        if (name := _column(n)) is not None:
            self.used.append(name)
            return col(name), self.types.get(name) == "string"
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float, str, bool)):
            return F.lit(n.value), isinstance(n.value, str)
        if isinstance(n, ast.BinOp):
            return self._binary(n)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.Invert, ast.Not)):
            c, _ = self.visit(n.operand)
            return (-c if isinstance(n.op, ast.USub) else ~c), False
        if isinstance(n, ast.Compare) and len(n.ops) == 1:
            (a, _), (b, _) = self.visit(n.left), self.visit(n.comparators[0])
            ops = {ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b, ast.Eq: a == b, ast.NotEq: a != b}
            if type(n.ops[0]) in ops:
                return ops[type(n.ops[0])], False
        if isinstance(n, ast.Call) and not n.keywords and len(n.args) == 1 and isinstance(n.func, ast.Attribute):
            return self._call(n.func, n.args[0])
        raise Rejected(ast.dump(n)[:200])

    def _binary(self, n: ast.BinOp) -> tuple[Column, bool]:
        (a, s), (b, t) = self.visit(n.left), self.visit(n.right)
        if isinstance(n.op, ast.Add):
            return (F.concat(a.cast("string"), b.cast("string")), True) if s or t else (a + b, False)
        number = {
            ast.Sub: lambda: a - b,
            ast.Mult: lambda: a * b,
            ast.Div: lambda: F.try_divide(a.cast("double"), b.cast("double")),
            ast.FloorDiv: lambda: F.floor(F.try_divide(a.cast("double"), b.cast("double"))),
            ast.Mod: lambda: F.when(b != 0, F.pmod(a, F.when(b != 0, b))),
            ast.Pow: lambda: F.pow(a, b),
            ast.BitAnd: lambda: a & b,
            ast.BitOr: lambda: a | b,
        }
        if type(n.op) in number and not (s or t):
            return number[type(n.op)](), False
        raise Rejected(ast.dump(n)[:200])

    def _call(self, f: ast.Attribute, arg: ast.AST) -> tuple[Column, bool]:
        if f.attr == "astype":
            kind = arg.id if isinstance(arg, ast.Name) else arg.value if isinstance(arg, ast.Constant) else None
            if kind in _CASTS:
                return self.visit(f.value)[0].cast(_CASTS[kind]), kind == "str"
        elif f.attr == "fillna" and isinstance(arg, ast.Constant):
            c, text = self.visit(f.value)
            return F.coalesce(c, F.lit(arg.value)), text
        elif isinstance(f.value, ast.Name) and f.value.id == "np" and f.attr in _MATH:
            return _MATH[f.attr](self.visit(arg)[0]), False
        raise Rejected(ast.unparse(f)[:200])


def compile_snippet(snippet: str, df: DataFrame) -> tuple[str, Column, list[str]]:
    """(new column, expression, source columns) of ``df['new'] = ...``."""
    try:
        body = ast.parse(snippet.strip()).body
    except SyntaxError as e:
        raise Rejected(str(e)) from e
    if len(body) != 1 or not isinstance(body[0], ast.Assign) or len(body[0].targets) != 1 or (name := _column(body[0].targets[0])) is None:
        raise Rejected("one assignment to df['name'] is expected")
    compiler = _Compiler(dict(df.dtypes))
    c, _ = compiler.visit(body[0].value)
    return name, c, compiler.used


def derive(df: DataFrame, snippets: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with each snippet's column in turn; snippets whose source columns are missing are skipped and given back."""
    skipped = []
    for s in snippets:
        name, c, used = compile_snippet(s, df)
        if set(used) <= set(df.columns):
            df = df.withColumn(name, c)
        else:
            skipped.append(s)
    return df, skipped
