"""User code over a row as a Column that never fails: what goes wrong in a row is null there.

The code is one expression: numbers, texts in quotes, true, false, null, fields (dots lead into structs), + - * / % **,
comparisons (== or =, != or <>, also chained), and, or, not, `x if test else y`, `x in (..)`, and the functions below. Words
may be in capitals. Numbers are doubles; text that is no number, a division by 0 and a logarithm of what has none are null,
as is all that is made of them. `and` and `or` know three values, as in SQL. Nothing else can be written, so no code can do
more than look at its row. Code that cannot be read is an error when the plan is made, not a row's.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from docquery.functions.fields import numeric, to_float, to_time
from docquery.functions.text import osa_column

#: SQL's spellings, outside quotes, as the ones that are read.
_SPELLINGS = ((r"\bAND\b", "and"), (r"\bOR\b", "or"), (r"\bNOT\b", "not"), (r"\bIN\b", "in"), (r"\bIS\b", "is"), (r"\bnull\b|\bNULL\b", "None"), (r"\btrue\b|\bTRUE\b", "True"), (r"\bfalse\b|\bFALSE\b", "False"), (r"<>", "!="), (r"(?<![<>=!])=(?!=)", "=="))
_QUOTED = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")""")
_ARITHMETIC: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: F.try_add,
    ast.Sub: F.try_subtract,
    ast.Mult: F.try_multiply,
    ast.Div: F.try_divide,
    ast.Mod: F.try_mod,
    ast.Pow: lambda a, b: _finite(F.pow(a, b)),
}
_COMPARE: dict[type, Callable[[Column, Column], Column]] = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _text(x: Column) -> Column:
    return x.cast("string")


#: Functions by name and number of arguments. div is 0 for a division by 0 and the first four take text that is no number
#: for 0; the others are null there.
FUNCTIONS: dict[tuple[str, int], Callable[..., Column]] = {
    ("toFloat64", 1): lambda x: to_float(x),
    ("add", 2): lambda a, b: F.try_add(to_float(a), to_float(b)),
    ("mul", 2): lambda a, b: F.try_multiply(to_float(a), to_float(b)),
    ("div", 2): lambda a, b: F.coalesce(F.try_divide(to_float(a), to_float(b)), F.lit(0.0)),
    ("log", 1): lambda x: _finite(F.ln(numeric(x))),
    ("sqrt", 1): lambda x: _finite(F.sqrt(numeric(x))),
    ("pow", 2): lambda a, b: _finite(F.pow(numeric(a), numeric(b))),
    ("abs", 1): lambda x: F.abs(numeric(x)),
    ("levenshtein", 2): lambda a, b: osa_column(_text(a), _text(b)).cast("double"),
    ("toTime", 1): lambda x: to_time(_text(x)),
    ("now", 0): F.current_timestamp,
    ("seconds", 1): lambda t: F.unix_micros(t) / 1e6,
    ("lower", 1): lambda x: F.lower(_text(x)),
    ("length", 1): lambda x: F.length(_text(x)).cast("double"),
    ("exists", 1): lambda x: x.isNotNull(),
}


def script(code: str, variables: dict[str, Column] | None = None) -> Column:
    """The value of user code in each row, null where it has none; a variable comes before a field of its name."""
    parts = _QUOTED.split(code)
    for i in range(0, len(parts), 2):
        for wrong, right in _SPELLINGS:
            parts[i] = re.sub(wrong, right, parts[i])
    try:
        tree = ast.parse("".join(parts).strip(), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"cannot read {code!r}: {e.msg}") from None
    return _value(tree.body, code, variables or {})


def _field(node: ast.expr) -> str | None:
    if isinstance(node, ast.Name):
        return f"`{node.id}`"
    if isinstance(node, ast.Attribute) and (inner := _field(node.value)):
        return f"{inner}.`{node.attr}`"
    return None


def _value(node: ast.expr, code: str, variables: dict[str, Column]) -> Column:
    value = lambda n: _value(n, code, variables)
    number = lambda n: numeric(value(n))
    match node:
        case ast.Constant(value=None | bool() | str() as v):
            return F.lit(v)
        case ast.Constant(value=int() | float() as v):
            return F.lit(float(v))
        case ast.Name(id=name) if name in variables:
            return variables[name]
        case ast.Name() | ast.Attribute() if path := _field(node):
            return F.col(path)
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _ARITHMETIC:
            return _ARITHMETIC[type(op)](number(a), number(b))
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -number(x)
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return ~_truth(value(x))
        case ast.BoolOp(op=op, values=values):
            join = (lambda a, b: a & b) if isinstance(op, ast.And) else (lambda a, b: a | b)
            return reduce(join, [_truth(value(v)) for v in values])
        case ast.IfExp(test=test, body=a, orelse=b):
            texts = any(isinstance(n, ast.Constant) and isinstance(n.value, str) for n in (a, b))
            one, other = (_text(value(n)) if texts else numeric(value(n)) for n in (a, b))
            return F.when(_truth(value(test)), one).otherwise(other)
        case ast.Compare(left=left, ops=ops, comparators=others):
            sides = [left, *others]
            return reduce(lambda a, b: a & b, [_compared(op, a, b, value, code) for op, a, b in zip(ops, sides, others, strict=False)])
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if (name, len(args)) in FUNCTIONS:
            return FUNCTIONS[name, len(args)](*[value(a) for a in args])
    raise ValueError(f"cannot read {ast.unparse(node)!r} in {code!r}")


def _truth(c: Column) -> Column:
    """A condition of what may be one or the text of one."""
    return c.try_cast("boolean")


def _compared(op: ast.cmpop, a: ast.expr, b: ast.expr, value: Callable[[ast.expr], Column], code: str) -> Column:
    """Numbers as such; with a text on either side as texts; truths with truths; nothing is equal to null, `is None` asks for it."""
    constant = lambda n, kind: isinstance(n, ast.Constant) and isinstance(n.value, kind)
    if isinstance(op, (ast.Is, ast.IsNot)) and constant(b, type(None)):
        return value(a).isNull() if isinstance(op, ast.Is) else value(a).isNotNull()
    if isinstance(op, (ast.In, ast.NotIn)) and isinstance(b, (ast.Tuple, ast.List)):
        found = reduce(lambda x, y: x | y, [_compared(ast.Eq(), a, item, value, code) for item in b.elts], F.lit(False))
        return found if isinstance(op, ast.In) else ~found
    if type(op) not in _COMPARE:
        raise ValueError(f"cannot read a comparison in {code!r}")
    timed = any(isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in ("toTime", "now") for n in (a, b))
    read = (lambda c: c) if timed else _text if constant(a, str) or constant(b, str) else _truth if constant(a, bool) or constant(b, bool) else numeric
    return _COMPARE[type(op)](read(value(a)), read(value(b)))
