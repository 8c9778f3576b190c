"""Named vegetation and radar indices as column expressions, with the intervals they are read by."""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Bands = Mapping[str, Column]


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def or_zero(b: Column, value: Column) -> Column:
    """value, 0 where b is 0."""
    return F.when(b != 0, value).otherwise(F.lit(0.0))


#: Formulas (fixed values) over the bands blue, green, red, edge, nir, swir, vv and vh.
INDICES: dict[str, Callable[[Bands], Column]] = {
    "NDVI": lambda b: ratio(b["nir"] - b["red"], b["nir"] + b["red"]),
    "SAVI": lambda b: ratio(1.5 * (b["nir"] - b["red"]), b["nir"] + b["red"] + 0.5),
    "RECI": lambda b: or_zero(b["red"], ratio(b["nir"], b["red"]) - 1),
    "GCI": lambda b: or_zero(b["green"], ratio(b["nir"], b["green"]) - 1),
    "EVI2": lambda b: ratio(2.5 * (b["nir"] - b["red"]), b["nir"] + 2.4 * b["red"] + 1),
    "SIPI": lambda b: or_zero(b["nir"] - b["red"], ratio(b["nir"] - b["blue"], b["nir"] - b["red"])),
    "NDRE": lambda b: ratio(b["nir"] - b["edge"], b["nir"] + b["edge"]),
    "NDMI": lambda b: ratio(b["nir"] - b["swir"], b["nir"] + b["swir"]),
    "NDRVI": lambda b: ratio(2 * (b["vh"] - b["vv"]), b["vh"] + b["vv"]),
    "RI": lambda b: or_zero(b["vv"], ratio(b["vh"], b["vv"])),
    "RVI": lambda b: ratio(4 * b["vh"], b["vh"] + b["vv"]),
    "RVI4S1": lambda b: F.sqrt(ratio(b["vv"], b["vv"] + b["vh"])) * ratio(4 * b["vh"], b["vh"] + b["vv"]),
}
#: Which band of an eight-band scene is which (fixed values).
EIGHT_BANDS = {"blue": "b2", "green": "b4", "red": "b6", "edge": "b7", "nir": "b8"}
EIGHT_BAND_INDICES = ("NDVI", "SAVI", "RECI", "GCI", "EVI2", "SIPI", "NDRE")
#: Lower ends of the intervals and their colours (fixed values): NDVI.
NDVI_LEGEND = ((0.0, "#F44336"), (0.2, "#FF9800"), (0.4, "#FFEB3B"), (0.6, "#8BC34A"), (0.8, "#4CAF50"))


def index(name: str, bands: Bands) -> Column:
    return INDICES[name](bands)


_STEPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: ratio, ast.Pow: F.pow}
_CALLS = {"sqrt": F.sqrt, "abs": F.abs, "log": F.log, "exp": F.exp}


def expression(formula: str, bands: Bands) -> Column:
    """A caller's own index, e.g. "(nir - red) / (nir + red)": band names, numbers, + - * / **, sqrt, abs, log and exp; null where a divisor is 0."""

    def column(node: ast.expr) -> Column:
        match node:
            case ast.BinOp(left, op, right) if type(op) in _STEPS:
                return _STEPS[type(op)](column(left), column(right))
            case ast.UnaryOp(ast.USub(), x):
                return -column(x)
            case ast.Constant(value) if isinstance(value, (int, float)):
                return F.lit(float(value))
            case ast.Name(name) if name in bands:
                return bands[name].cast("double")
            case ast.Call(ast.Name(name), [x], []) if name in _CALLS:
                return _CALLS[name](column(x))
        raise ValueError(f"not a part of an index formula: {ast.unparse(node)}")

    return column(ast.parse(formula, mode="eval").body)


def interval(value: Column, lows: tuple[float, ...]) -> Column:
    """The number of the interval (low, next low] that value lies in, from 1; open above, null at or below the first low."""
    out = F.lit(None).cast("int")
    for i, low in enumerate(lows, 1):
        out = F.when(value > low, i).otherwise(out)
    return out


def signed_cbrt_nan(x: Column) -> Column:
    """x to the power 1/3; NaN for a negative x, as the power of a negative base is."""
    return F.when(x < 0, F.lit(float("nan"))).otherwise(F.cbrt(x))


def avi(b: Bands) -> Column:
    """Advanced vegetation index of 16-bit bands."""
    return F.cbrt(b["nir"] + 1) * F.cbrt(65536 - b["red"]) * signed_cbrt_nan((b["nir"] - b["red"]).cast("double"))


def si(b: Bands) -> Column:
    """Shadow index of 16-bit bands."""
    return F.cbrt(65536 - b["blue"]) * F.cbrt(65536 - b["green"]) * F.cbrt(65536 - b["red"])


def evi(b: Bands) -> Column:
    return ratio(2.5 * (b["nir"] - b["red"]), 1 + b["nir"] + 6 * b["red"] - 7.5 * b["blue"])
