"""Numbers rounded half to even on the exact value of the double, as printf does, not on its shortest decimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to here a scaled double and its neighbours at half steps are exact.
_EXACT = float(2**51)


def _bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it: its expression isn't copied into each place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _nearest(x: Column, step: Column) -> Column:
    """x * step, a power of ten up to 10^11, to the nearest whole number, ties to even; null where the product is too large to tell.

    The product of two doubles and its rounding error are both doubles; a product at a half step is a tie only where the
    error is zero, else the error tells the side.
    """
    spread = F.lit(float(2**27 + 1))

    def settle(s):
        half = F.abs(s["product"] - F.rint(s["product"])) == 0.5
        n = F.when(half & (s["error"] > 0), s["product"] + 0.5).when(half & (s["error"] < 0), s["product"] - 0.5)
        return F.when(F.abs(s["product"]) < _EXACT, n.otherwise(F.rint(s["product"])))

    def split(s):
        error = (s["high"] * step - s["product"]) + (s["x"] - s["high"]) * step
        return _bound(F.struct(s["product"].alias("product"), error.alias("error")), settle)

    parts = lambda v: F.struct(v.alias("x"), (v * step).alias("product"), (v * spread - (v * spread - v)).alias("high"))
    return _bound(x, lambda v: _bound(parts(v), split))


def rounded(value: Column, digits: int) -> Column:
    """A double to so many places; 2.675 gives 2.67, since the double lies below the tie, and 0.125 gives 0.12.

    Null stays null.  From 2^51 / 10^digits on, and for NaN and infinities, bround answers.
    """
    x = value.cast("double")
    step = F.lit(float(10**digits))
    return F.coalesce(_nearest(x, step) / step, F.bround(x, digits))


def short(value: Column) -> Column:
    """A number to six digits without zeros at its end: 24, 2.8, 0.0125; for values from a ten-thousandth to a million.

    Others keep the text of their double.
    """

    def text(s):
        cut = (_nearest(s["x"], s["step"]) / s["step"]).cast("decimal(20,10)").cast("string")
        return F.when((s["x"] >= 1e-4) & (s["x"] < 999999.5), F.regexp_replace(cut, r"\.?0+$", "")).otherwise(s["x"].cast("string"))

    step = lambda v: F.pow(F.lit(10.0), F.lit(5) - F.floor(F.log10(v)))
    return _bound(value.cast("double"), lambda v: _bound(F.struct(v.alias("x"), step(v).alias("step")), text))


def fixed(value: Column, digits: int) -> Column:
    """rounded() as text with all its places, null for null; what is below zero keeps its sign, as -0.00 too."""
    unit = F.lit(10**digits).cast("long")

    def text(s):
        whole = F.abs(s["n"]).cast("long")
        places = [F.lit("."), F.lpad((whole % unit).cast("string"), digits, "0")] if digits else []
        sign = F.when(F.startswith(s["x"].cast("string"), F.lit("-")), "-").otherwise("")
        known = F.concat(sign, F.call_function("div", whole, unit).cast("string"), *places)
        return F.when(s["n"].isNotNull(), known).when(s["x"].isNotNull(), F.format_string(f"%.{digits}f", s["x"]))

    return _bound(value.cast("double"), lambda v: _bound(F.struct(v.alias("x"), _nearest(v, F.lit(float(10**digits))).alias("n")), text))
