"""Column functions on matrices [a b c d e f], rectangles and page geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = "abcdef"


def matrix(*v) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).alias(n) for x, n in zip(v, NAMES)])


def then(m: Column, n: Column) -> Column:
    """The matrix that applies m, then n."""
    g = lambda x, k: x.getField(k)
    return matrix(
        g(m, "a") * g(n, "a") + g(m, "b") * g(n, "c"), g(m, "a") * g(n, "b") + g(m, "b") * g(n, "d"),
        g(m, "c") * g(n, "a") + g(m, "d") * g(n, "c"), g(m, "c") * g(n, "b") + g(m, "d") * g(n, "d"),
        g(m, "e") * g(n, "a") + g(m, "f") * g(n, "c") + g(n, "e"), g(m, "e") * g(n, "b") + g(m, "f") * g(n, "d") + g(n, "f"),
    )


def apply(m: Column, x: Column, y: Column) -> Column:
    g = m.getField
    return F.struct((g("a") * x + g("c") * y + g("e")).alias("x"), (g("b") * x + g("d") * y + g("f")).alias("y"))


def inverse(m: Column) -> Column:
    """The inverse, null where there is none."""
    g = m.getField
    det = g("a") * g("d") - g("b") * g("c")
    d = F.when(F.abs(det) > 1e-12, det)
    return matrix(g("d") / d, -g("b") / d, -g("c") / d, g("a") / d, (g("c") * g("f") - g("d") * g("e")) / d, (g("b") * g("e") - g("a") * g("f")) / d)


def scale_of(m: Column) -> Column:
    """Mean scale: square root of the area factor."""
    g = m.getField
    return F.sqrt(F.abs(g("a") * g("d") - g("b") * g("c")))


def box_of(m: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Upright box around a transformed rectangle."""
    p = [apply(m, x, y) for x in (x0, x1) for y in (y0, y1)]
    xs, ys = [q.getField("x") for q in p], [q.getField("y") for q in p]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners in order; null where one isn't finite."""
    bad = None
    for v in (x0, y0, x1, y1):
        test = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        bad = test if bad is None else bad | test
    return F.when(~bad, F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1")))


def rotation(degrees: Column) -> Column:
    """0, 90, 180 or 270: the angle mod 360, floored to a quarter turn."""
    return (F.floor(F.pmod(F.coalesce(degrees, F.lit(0)), F.lit(360)) / 90) * 90).cast("int")


def page_size(box: Column, turn: Column) -> Column:
    """Width and height of a page as shown: never below 1, swapped by a quarter turn."""
    w, h = F.greatest(F.abs(box.getItem(2) - box.getItem(0)), F.lit(1.0)), F.greatest(F.abs(box.getItem(3) - box.getItem(1)), F.lit(1.0))
    side = rotation(turn).isin(90, 270)
    return F.struct(F.when(side, h).otherwise(w).alias("width"), F.when(side, w).otherwise(h).alias("height"))


def advance(w0: Column, size: Column, char_space: Column, word_space: Column, code: Column, stretch: Column) -> Column:
    """Horizontal advance of a glyph; word spacing counts for the one-byte code 32."""
    return (w0 / 1000.0 * size + char_space + F.when(code == 32, word_space).otherwise(0.0)) * stretch / 100.0
