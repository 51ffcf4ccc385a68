"""Rule expressions: parsed once on the driver by a whitelist, compiled to a Column.  No text reaches a SQL parser."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column, functions as F

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


def compiled(expression: str, columns: dict[str, Column], tolerance: float = 0.0) -> Column:
    """Column of an expression of names, numbers, + - * /, unary minus and (chained) comparisons; ValueError for anything else.

    With a tolerance, == holds if both sides differ by that share of the larger at most.
    """
    def walk(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in columns:
                raise ValueError(f"unknown name {node.id}")
            return columns[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -walk(node.operand)
        if isinstance(node, ast.Compare) and all(type(op) in _COMPARE for op in node.ops):
            parts = [walk(x) for x in (node.left, *node.comparators)]
            out = F.lit(True)
            for op, left, right in zip(node.ops, parts, parts[1:]):
                if isinstance(op, ast.Eq) and tolerance:
                    out = out & (F.abs(left - right) <= tolerance * F.greatest(F.abs(left), F.abs(right)))
                else:
                    out = out & _COMPARE[type(op)](left, right)
            return out
        raise ValueError(f"not allowed in a rule: {type(node).__name__}")

    return walk(ast.parse(expression, mode="eval").body)
