"""A small formula language compiled to Spark columns.

A formula is one arithmetic expression over named variables and parameters. It is parsed and checked
on the driver against a whitelist, and becomes a native Column: no user code ever runs on a row.
Results follow IEEE 754 (x / 0 is infinite, log(0) is -infinite, log(-1) is NaN) although ANSI
mode would raise an error or give null.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LENGTH = 2000
#: The deepest nesting of a formula.
MAX_DEPTH = 200
NAN, INF = float("nan"), float("inf")
CONSTANTS = {"pi": math.pi, "e": math.e}


class FormulaError(ValueError):
    """The formula is not of the language, or names something unknown."""


def _log(x: Column, of: Callable[[Column], Column] = F.ln) -> Column:
    return F.when(x > 0, of(x)).when(x == 0, F.lit(-INF)).when(F.isnull(x), None).otherwise(F.lit(NAN))


FUNCTIONS = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "tanh": F.tanh, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs, "sign": F.signum,
    "log": _log, "log10": lambda x: _log(x, F.log10),
}


def divide(a: Column, b: Column) -> Column:
    """a / b by IEEE 754."""
    at_zero = F.when(F.isnull(a), None).when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: divide, ast.Pow: F.pow}


def parse(text: str, names: set[str] | frozenset[str] | None = None) -> ast.expr:
    """The checked syntax tree. Raises FormulaError for anything outside the language or, if names are given, for other names."""
    if not isinstance(text, str) or not text.strip():
        raise FormulaError("empty formula")
    if len(text) > MAX_LENGTH:
        raise FormulaError(f"longer than {MAX_LENGTH} characters")
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise FormulaError(f"not an expression: {e}") from None
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    level, depth = [tree], 0
    while level:
        depth += 1
        if depth > MAX_DEPTH:
            raise FormulaError(f"nested deeper than {MAX_DEPTH}")
        level = [c for n in level for c in ast.iter_child_nodes(n)]
    for n in ast.walk(tree):
        match n:
            case ast.Call(func=ast.Name(id=f), args=[_], keywords=[]) if f in FUNCTIONS:
                pass
            case ast.Call():
                raise FormulaError("only known functions of one argument can be called")
            case ast.Name(id=x):
                if id(n) not in called and names is not None and x not in names and x not in CONSTANTS:
                    raise FormulaError(f"unknown name: {x}")
            case ast.Constant(value=v):
                if isinstance(v, bool) or not isinstance(v, (int, float)):
                    raise FormulaError("only real numbers")
            case ast.BinOp(op=op) if type(op) in BINARY:
                pass
            case ast.UnaryOp(op=ast.UAdd() | ast.USub()):
                pass
            case ast.operator() | ast.unaryop() | ast.expr_context():
                pass
            case _:
                raise FormulaError(f"{type(n).__name__} is not allowed")
    return tree


def names_of(text: str) -> set[str]:
    tree = parse(text)
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called} - CONSTANTS.keys()


def compile_formula(text: str, columns: Mapping[str, Column | float]) -> Column:
    """A double Column; columns gives what each variable or parameter stands for."""

    def build(n: ast.expr) -> Column:
        match n:
            case ast.Constant(value=v):
                return F.lit(float(v))
            case ast.Name(id=x):
                v = columns.get(x, CONSTANTS.get(x))
                return v.cast("double") if isinstance(v, Column) else F.lit(float(v))
            case ast.UnaryOp(op=op, operand=x):
                return -build(x) if isinstance(op, ast.USub) else build(x)
            case ast.BinOp(left=a, op=op, right=b):
                return BINARY[type(op)](build(a), build(b))
            case ast.Call(func=f, args=[x]):
                return FUNCTIONS[f.id](build(x))
        raise FormulaError(f"{type(n).__name__} is not allowed")

    return build(parse(text, frozenset(columns)))


def normalise(text: Column) -> Column:
    """Formula text for comparison: trimmed, lower case, ^ for **, no white space."""
    return F.regexp_replace(F.replace(F.lower(F.trim(text)), F.lit("**"), F.lit("^")), r"\s+", "")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)
