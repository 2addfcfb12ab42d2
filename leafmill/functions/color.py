"""Column functions on colours: colour spaces to RGB, blend modes, compositing."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(v: Column) -> Column:
    """0 .. 1 to 0 .. 255, clamped and rounded half up; what isn't finite counts as 0."""
    ok = F.when(F.isnan(v) | v.isNull() | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    return F.floor(F.least(F.greatest(ok, F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5).cast("int")


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def gray_to_rgb(g: Column) -> Column:
    return rgb(channel(g), channel(g), channel(g))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    ink = lambda v: channel(1.0 - F.least(F.lit(1.0), F.greatest(v, F.lit(0.0)) + F.greatest(k, F.lit(0.0))))
    return rgb(ink(c), ink(m), ink(y))


def lab_to_rgb(l: Column, a: Column, b: Column, white: tuple[float, float, float] = (0.9505, 1.0, 1.089)) -> Column:  # noqa: E741
    """CIE L*a*b* over a white point, through XYZ and the sRGB matrix (IEC 61966-2-1), without adaptation."""
    fy = (F.least(F.greatest(l, F.lit(0.0)), F.lit(100.0)) + 16.0) / 116.0
    edge = 6.0 / 29.0
    part = lambda t, w: F.when(t > edge, t * t * t).otherwise(3.0 * edge * edge * (t - 4.0 / 29.0)) * max(w, 1e-10)
    x, y, z = part(a / 500.0 + fy, white[0]), part(fy, white[1]), part(fy - b / 200.0, white[2])
    # fixed values: XYZ to linear sRGB
    rows = [(3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252)]

    def gamma(v):
        v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        return F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)

    return rgb(*[channel(gamma(p * x + q * y + r * z)) for p, q, r in rows])


def indexed(index: Column, table: list[tuple[int, int, int]]) -> Column:
    """Colour of a table entry; the index is rounded and clamped to the table."""
    at = F.least(F.greatest(F.floor(index + 0.5), F.lit(0)), F.lit(len(table) - 1)).cast("int") + 1
    return F.element_at(F.array(*[rgb(*[F.lit(c) for c in t]) for t in table]), at)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    """JFIF colours of 0 .. 255 samples, rounded and clamped."""
    fit = lambda v: F.least(F.greatest(F.floor(v + 0.5), F.lit(0)), F.lit(255)).cast("int")
    return rgb(fit(y + 1.402 * (cr - 128)), fit(y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128)), fit(y + 1.772 * (cb - 128)))


def decode_map(v: Column, low: float, high: float, top: int) -> Column:
    """A sample of 0 .. top mapped linearly to low .. high."""
    return low + v * (high - low) / top


_FLOAT = "float"


def _f(v) -> Column:
    return F.lit(v).cast(_FLOAT)


def _hard(b: Column, s: Column) -> Column:
    t = _f(2.0) * s - _f(1.0)
    return F.when(s <= _f(0.5), b * (_f(2.0) * s)).otherwise(b + t - b * t)


def _soft(b: Column, s: Column) -> Column:
    curve = F.when(b <= _f(0.25), ((_f(16.0) * b - _f(12.0)) * b + _f(4.0)) * b).otherwise(F.sqrt(b).cast(_FLOAT))
    return F.when(s <= _f(0.5), b - (_f(1.0) - _f(2.0) * s) * b * (_f(1.0) - b)).otherwise(b + (_f(2.0) * s - _f(1.0)) * (curve - b))


#: B(backdrop, source) of the separable modes, in single precision.
SEPARABLE = {
    "Normal": lambda b, s: s,
    "Multiply": lambda b, s: b * s,
    "Screen": lambda b, s: b + s - b * s,
    "Overlay": lambda b, s: _hard(s, b),
    "Darken": F.least,
    "Lighten": F.greatest,
    "ColorDodge": lambda b, s: F.when(s >= _f(1.0), _f(1.0)).otherwise(F.least((b / (_f(1.0) - F.when(s < _f(1.0), s))).cast(_FLOAT), _f(1.0))),
    "ColorBurn": lambda b, s: F.when(s <= _f(0.0), _f(0.0)).otherwise(_f(1.0) - F.least(((_f(1.0) - b) / F.when(s > _f(0.0), s)).cast(_FLOAT), _f(1.0))),
    "HardLight": _hard,
    "SoftLight": _soft,
    "Difference": lambda b, s: F.abs(b - s),
    "Exclusion": lambda b, s: b + s - _f(2.0) * b * s,
}
NONSEPARABLE = ("Hue", "Saturation", "Color", "Luminosity")


def _byte(v: Column) -> Column:
    return F.floor(F.least(F.greatest(v, _f(0.0)), _f(1.0)) * _f(255.0) + _f(0.5)).cast("int")


def _unit(v: Column) -> Column:
    return (v.cast(_FLOAT) / _f(255.0)).cast(_FLOAT)


def lum(c: list[Column]) -> Column:
    return _f(0.3) * c[0] + _f(0.59) * c[1] + _f(0.11) * c[2]


def sat(c: list[Column]) -> Column:
    return F.greatest(*c) - F.least(*c)


def _let(values: list[Column], f) -> Column:
    """f of the values, each of them computed once: a lambda binds them, so that expressions stay small."""
    packed = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(packed, lambda s: f([s.getField(f"v{i}") for i in range(len(values))])), F.lit(0))


def _clip(c: list[Column], then) -> Column:
    """Pull a colour into the gamut along its luminosity."""
    zero, one = _f(0.0), _f(1.0)

    def high(v):
        *c, mid, top = v
        return then([F.when(top <= one, x).when(F.abs(top - mid) > _f(1e-9), mid + ((x - mid) * (one - mid) / (top - mid)).cast(_FLOAT)).otherwise(mid) for x in c])

    def low(v):
        *c, mid, bottom, top = v
        raised = [F.when(bottom >= zero, x).when(F.abs(mid - bottom) > _f(1e-9), mid + ((x - mid) * mid / (mid - bottom)).cast(_FLOAT)).otherwise(mid) for x in c]
        return _let([*raised, mid, top], high)

    return _let(c, lambda c: _let([*c, lum(c), F.least(*c), F.greatest(*c)], low))


def set_lum(c: list[Column], light: Column, then=lambda c: rgb(*c)) -> Column:
    """A colour shifted to a luminosity and clipped; `then` makes the result of its channels."""
    return _let([*c, light], lambda v: _clip([x + (v[3] - lum(v[:3])) for x in v[:3]], then))


def set_sat(c: list[Column], s: Column) -> list[Column]:
    """Stretch a colour from its least to its greatest channel to the saturation s; a grey one gives black."""
    low, high = F.least(*c), F.greatest(*c)
    return [F.when(high > low, F.when(v == high, s).when(v == low, _f(0.0)).otherwise(((v - low) * s / (high - low)).cast(_FLOAT))).otherwise(_f(0.0)) for v in c]


def blend(backdrop: list[Column], source: list[Column], mode: str) -> Column:
    """Blended colour of two 0 .. 255 colours, before compositing."""
    b, s = [_unit(v) for v in backdrop], [_unit(v) for v in source]
    if mode in SEPARABLE:
        return rgb(*[_byte(SEPARABLE[mode](x, y)) for x, y in zip(b, s)])
    made = {"Hue": lambda b, s: (set_sat(s, sat(b)), lum(b)), "Saturation": lambda b, s: (set_sat(b, sat(s)), lum(b)), "Color": lambda b, s: (s, lum(b)), "Luminosity": lambda b, s: (b, lum(s))}[mode]
    return _let([*b, *s], lambda v: set_lum(*made(v[:3], v[3:]), then=lambda c: rgb(*[_byte(x) for x in c])))


def over(source: Column, backdrop: Column, alpha: Column) -> Column:
    """Integer source-over of one channel onto an opaque backdrop."""
    return F.floor((source * alpha + backdrop * (255 - alpha) + 127) / 255).cast("int")


def over_all(layers: Column, backdrop: Column) -> Column:
    """Ordered fold of (value, alpha) layers onto a backdrop channel."""
    return F.aggregate(layers, backdrop.cast("int"), lambda d, x: over(x["value"], d, x["alpha"]))


