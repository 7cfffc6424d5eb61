"""Style expressions as Columns: nested arrays of operators over a feature's properties, and their rewriting for a layer's opacity.

``["case", ["==", ["get", "kind"], "rail"], 2, ["coalesce", ["get", "width"], 1]]`` becomes one Column that Catalyst folds and pushes like any other.
Comparison never gives null: a missing property equals nothing but null.  An operator that is not known is an error when the Column is built.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Expression = object
_COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_SUM = {"+": lambda a, b: a + b, "*": lambda a, b: a * b}


def compile(expression: Expression, get: Callable[[str], Column], zoom: Column | None = None, geometry_type: Column | None = None) -> Column:  # noqa: A001
    """The Column of an expression.  ``get`` gives the Column of a property, null where a feature lacks it."""

    def of(e: Expression) -> Column:
        return compile(e, get, zoom, geometry_type)

    def truth(e: Expression) -> Column:
        return F.coalesce(of(e), F.lit(False))

    if not isinstance(expression, list):
        return F.lit(expression)
    if not expression:
        raise ValueError("an empty expression")
    op, *args = expression
    if op == "literal":
        return F.array(*map(F.lit, args[0])) if isinstance(args[0], list) else F.lit(args[0])
    if op == "get":
        return get(args[0])
    if op == "has":
        return get(args[0]).isNotNull()
    if op == "geometry-type" and geometry_type is not None:
        return geometry_type
    if op == "zoom" and zoom is not None:
        return zoom
    if op in ("==", "!="):
        same = of(args[0]).eqNullSafe(of(args[1]))
        return same if op == "==" else ~same
    if op in _COMPARE:
        return F.coalesce(_COMPARE[op](of(args[0]), of(args[1])), F.lit(False))
    if op == "!":
        return ~truth(args[0])
    if op == "all":
        return reduce(Column.__and__, map(truth, args), F.lit(True))
    if op == "any":
        return reduce(Column.__or__, map(truth, args), F.lit(False))
    if op == "in":
        within = args[1]
        if isinstance(within, list) and within[0] == "literal":
            return F.coalesce(of(args[0]).isin(*within[1]), F.lit(False)) if within[1] else F.lit(False)
        return F.coalesce(F.contains(of(within), of(args[0])), F.lit(False))
    if op == "case":
        *pairs, last = args
        return reduce(lambda have, k: F.when(truth(pairs[k]), of(pairs[k + 1])).otherwise(have), reversed(range(0, len(pairs), 2)), of(last))
    if op == "match":
        value, *pairs, last = args
        hits = lambda labels: of(value).isin(*(labels if isinstance(labels, list) else [labels]))
        return reduce(lambda have, k: F.when(F.coalesce(hits(pairs[k]), F.lit(False)), of(pairs[k + 1])).otherwise(have), reversed(range(0, len(pairs), 2)), of(last))
    if op == "coalesce":
        return F.coalesce(*map(of, args))
    if op in _SUM:
        return reduce(_SUM[op], map(of, args))
    if op == "-":
        return -of(args[0]) if len(args) == 1 else of(args[0]) - of(args[1])
    if op == "/":
        return of(args[0]) / F.nullif(of(args[1]), F.lit(0))
    if op in ("min", "max"):
        return (F.least if op == "min" else F.greatest)(*map(of, args)) if len(args) > 1 else of(args[0])
    if op == "concat":
        return F.concat(*[F.coalesce(of(a).cast("string"), F.lit("")) for a in args])
    if op == "step":
        at, first, *stops = args
        return reduce(lambda have, k: F.when(of(at) >= stops[k], of(stops[k + 1])).otherwise(have), range(0, len(stops), 2), of(first))
    if op == "interpolate":
        kind, at, *stops = args
        if kind != ["linear"]:
            raise ValueError(f"interpolation {kind}")
        x = of(at)
        out = of(stops[1])
        for k in range(0, len(stops) - 2, 2):
            low, high = of(stops[k + 1]), of(stops[k + 3])
            out = F.when(x >= stops[k], low + (high - low) * (x - stops[k]) / (stops[k + 2] - stops[k])).otherwise(out)
        return F.when(x >= stops[-2], of(stops[-1])).otherwise(out)
    raise ValueError(f"unknown operator {op!r}")


def scaled(value: Expression, by: float) -> Expression:
    """An opacity times a number.  The zoom must stay the input of a top-level ``interpolate`` or ``step``, so there the outputs are scaled one by one."""

    def output(e: Expression) -> Expression:
        if isinstance(e, (int, float)) and not isinstance(e, bool):
            return e * by
        return e if by == 1 else 0 if by == 0 else ["*", e, by]

    if value is None:
        return output(1)
    stops = {"interpolate": 3, "step": 2}.get(value[0]) if isinstance(value, list) and value else None
    if stops is None or value[stops - 1] != ["zoom"]:
        return output(value)
    first_output = 2 if value[0] == "step" else 4
    return [output(e) if k >= first_output and (k - first_output) % 2 == 0 else e for k, e in enumerate(value)]
