"""PDF function objects as Column expressions, so that evaluation stays in the JVM.

`build` takes a function's description and gives a Python function from input columns to output columns.
Type 4 programs are compiled by running them on a stack of expressions; only a program whose stack depends
on data (copy, index or roll with a computed count, branches of unlike height) has no such form.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Make = Callable[[list[Column]], list[Column]]


def clamp(x: Column, low: float, high: float) -> Column:
    """x between two bounds, given in any order."""
    a, b = sorted((float(low), float(high)))
    return F.least(F.greatest(x, F.lit(a)), F.lit(b))


def interpolate(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Linear map of x0 .. x1 to y0 .. y1; a range without width gives y0."""
    if abs(x1 - x0) < 1e-12:
        return F.lit(float(y0))
    return y0 + (x - x0) * (y1 - y0) / (x1 - x0)


def wrap(core: Make, domain: list, range_: list | None) -> Make:
    """Clamp inputs to the domain (a missing one is 0) and outputs to the range."""

    def call(xs):
        given = [xs[i] if i < len(xs) else F.lit(0.0) for i in range(len(domain))]
        ys = core([clamp(x, *d) for x, d in zip(given, domain)])
        return [clamp(y, *range_[i]) if range_ and i < len(range_) else y for i, y in enumerate(ys)]

    return call


def sampled(samples: list[float], size: list[int], outputs: int, encode: list | None = None, decode: list | None = None, top: float = 1.0) -> Make:
    """Type 0. Inputs are mapped from 0 .. 1 to sample places; linear in one or two dimensions, else nearest."""
    encode = encode or [(0, s - 1) for s in size]
    decode = decode or [(0, 1)] * outputs
    table = F.array(*[F.lit(float(s)) for s in samples])

    def at(places, k):
        flat, step = F.lit(0), 1
        for p, s in zip(places, size):
            flat, step = flat + p * step, step * s
        return F.element_at(table, (flat * outputs + k + 1).cast("int"))

    def call(xs):
        c = [clamp(interpolate(x, 0, 1, *e), 0, max(s - 1, 0)) for x, e, s in zip(xs, encode, size)]
        out = []
        for k in range(outputs):
            if len(c) == 1:
                lo = F.floor(c[0])
                hi = F.least(lo + 1, F.lit(size[0] - 1))
                v = at([lo], k) + (at([hi], k) - at([lo], k)) * (c[0] - lo)
            elif len(c) == 2:
                lo, hi = [F.floor(x) for x in c], [F.least(F.floor(x) + 1, F.lit(s - 1)) for x, s in zip(c, size)]
                fx, fy = c[0] - lo[0], c[1] - lo[1]
                v = (at([lo[0], lo[1]], k) * (1 - fx) + at([hi[0], lo[1]], k) * fx) * (1 - fy) + (at([lo[0], hi[1]], k) * (1 - fx) + at([hi[0], hi[1]], k) * fx) * fy
            else:
                v = at([F.floor(x + 0.5) for x in c], k)
            out.append(interpolate(v, 0, top, *decode[k]))
        return out

    return call


def exponential(c0: list[float], c1: list[float], n: float) -> Make:
    """Type 2: c0 + x^n (c1 - c0), for x of 0 or more."""
    return lambda xs: [a + F.pow(F.greatest(xs[0], F.lit(0.0)), F.lit(float(n))) * (b - a) for a, b in zip(c0, c1)]


def stitched(parts: list[Make], bounds: list[float], encode: list) -> Make:
    """Type 3: the first part whose bound lies above x. The first starts at 0 and the last ends at 1, whatever the domain."""

    def call(xs):
        x, outs = xs[0], []
        for i, part in enumerate(parts):
            low = 0.0 if i == 0 else bounds[i - 1]
            high = bounds[i] if i < len(bounds) else 1.0
            outs.append(part([interpolate(x, low, high, *encode[i])]))
        result = outs[-1]
        for i in range(len(parts) - 2, -1, -1):
            result = [F.when(x < bounds[i], y).otherwise(z) for y, z in zip(outs[i], result)]
        return result

    return call


_TOKEN = re.compile(r"[{}]|[^\s{}]+")


def _parse(text: str) -> list:
    stack: list[list] = [[]]
    for t in _TOKEN.findall(re.sub(r"%[^\r\n]*", "", text)):
        if t == "{":
            stack.append([])
            if len(stack) > 64:
                raise ValueError("program is nested too deeply")
        elif t == "}":
            block = stack.pop()
            if not stack:
                raise ValueError("unbalanced braces")
            stack[-1].append(block)
        else:
            stack[-1].append(t)
    if len(stack) != 1:
        raise ValueError("unbalanced braces")
    top = stack[0]
    return top[0] if len(top) == 1 and isinstance(top[0], list) else top


class DynamicStack(ValueError):
    """The program's stack depends on data."""


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def _long(v: Column) -> Column:
    return v.cast("long")


def _safe(v: Column) -> Column:
    return F.when(v != 0, v)


def _whole(v: Column) -> Column:
    """Cut to a whole number; what a long can't hold becomes its nearest, what isn't a number 0."""
    return F.when(F.isnan(v), F.lit(0).cast("long")).when(v >= 9.223372036854775e18, F.lit(2**63 - 1).cast("long")).when(v <= -9.223372036854775e18, F.lit(-(2**63)).cast("long")).otherwise(v.cast("long"))


_DEG = math.pi / 180
_ONE = {
    "neg": lambda a: -a, "abs": F.abs, "ceiling": lambda a: F.ceil(a).cast("double"), "floor": lambda a: F.floor(a).cast("double"),
    "round": lambda a: F.signum(a) * F.floor(F.abs(a) + 0.5), "truncate": lambda a: F.signum(a) * F.floor(F.abs(a)),
    "sqrt": lambda a: F.sqrt(F.abs(a)), "sin": lambda a: F.sin(a * _DEG), "cos": lambda a: F.cos(a * _DEG),
    "ln": lambda a: F.coalesce(F.ln(_safe(F.abs(a))), F.lit(0.0)), "log": lambda a: F.coalesce(F.log10(_safe(F.abs(a))), F.lit(0.0)),
    "cvi": lambda a: F.signum(a) * F.floor(F.abs(a)), "cvr": lambda a: a,
    "not": lambda a: F.when((a == 0) | (a == 1), 1 - a).otherwise(F.bitwise_not(_long(a)).cast("double")),
}
_TWO = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b,
    "div": lambda a, b: F.coalesce(a / _safe(b), F.lit(0.0)),
    "idiv": lambda a, b: F.coalesce(F.call_function("div", _whole(a), _safe(_whole(b))).cast("double"), F.lit(0.0)),
    "mod": lambda a, b: F.coalesce((_whole(a) % _safe(_whole(b))).cast("double"), F.lit(0.0)),
    "exp": lambda a, b: F.pow(a, b),
    "atan": lambda a, b: F.pmod(F.degrees(F.atan2(a, b)) + 360.0, F.lit(360.0)),
    "eq": lambda a, b: _flag(F.abs(a - b) < 1e-12), "ne": lambda a, b: _flag(F.abs(a - b) >= 1e-12),
    "gt": lambda a, b: _flag(a > b), "ge": lambda a, b: _flag(a >= b), "lt": lambda a, b: _flag(a < b), "le": lambda a, b: _flag(a <= b),
    "and": lambda a, b: _long(a).bitwiseAND(_long(b)).cast("double"), "or": lambda a, b: _long(a).bitwiseOR(_long(b)).cast("double"), "xor": lambda a, b: _long(a).bitwiseXOR(_long(b)).cast("double"),
}


def _shift(a: Column, n: float) -> Column:
    k = max(-63, min(63, int(n)))
    return (F.shiftleft(_long(a), k) if k >= 0 else F.shiftright(_long(a), -k)).cast("double")


def calculator(text: str) -> Make:
    """Type 4 program as expressions. Too few operands leave an operator without effect; 100 values are kept."""
    program = _parse(text)

    def number(v) -> float:
        if not isinstance(v, tuple):
            raise DynamicStack("a count isn't a literal")
        return v[0]

    def col(v) -> Column:
        return F.lit(v[0]) if isinstance(v, tuple) else v

    def run(tokens: list, stack: list) -> list:
        i = 0
        while i < len(tokens):
            t = tokens[i]
            if isinstance(t, list):
                nxt = tokens[i + 1] if i + 1 < len(tokens) else None
                if nxt == "if" and stack:
                    test, rest = col(stack[-1]), stack[:-1]
                    stack = merge(test, run(t, list(rest)), rest)
                    i += 2
                elif isinstance(nxt, list) and i + 2 < len(tokens) and tokens[i + 2] == "ifelse" and stack:
                    test, rest = col(stack[-1]), stack[:-1]
                    stack = merge(test, run(t, list(rest)), run(nxt, list(rest)))
                    i += 3
                else:
                    i += 1
                continue
            i += 1
            step(t, stack)
            del stack[:-100]
        return stack

    def merge(test: Column, yes: list, no: list) -> list:
        if len(yes) != len(no):
            raise DynamicStack("branches leave stacks of unlike height")
        return [a if a is b else F.when(test != 0, col(a)).otherwise(col(b)) for a, b in zip(yes, no)]

    def step(t: str, s: list) -> None:
        if t in ("true", "false"):
            s.append((float(t == "true"),))
        elif t in _ONE:
            if s:
                s.append(_ONE[t](col(s.pop())))
        elif t in _TWO:
            if len(s) >= 2:
                b, a = s.pop(), s.pop()
                s.append(_TWO[t](col(a), col(b)))
            else:
                s.clear()
        elif t == "bitshift":
            if len(s) >= 2:
                n, a = number(s.pop()), s.pop()
                s.append(_shift(col(a), n))
        elif t == "pop":
            del s[-1:]
        elif t == "exch":
            if len(s) >= 2:
                s[-1], s[-2] = s[-2], s[-1]
        elif t == "dup":
            s.extend(s[-1:])
        elif t == "copy":
            n = int(number(s.pop())) if s else 0
            if 0 < n <= len(s):
                s.extend(s[-n:])
        elif t == "index":
            n = int(number(s.pop())) if s else -1
            if 0 <= n < len(s):
                s.append(s[-1 - n])
        elif t == "roll":
            if len(s) >= 2:
                j, n = int(number(s.pop())), int(number(s.pop()))
                if 0 < n <= len(s):
                    part = s[-n:]
                    s[-n:] = part[-(j % n) :] + part[: n - j % n] if j % n else part
        else:
            try:
                s.append((float(t),))
            except ValueError:
                raise ValueError(f"unknown operator {t!r}") from None

    return lambda xs: [col(v) for v in run(program, list(xs))]


def program(text: str, outputs: int) -> Make:
    """A calculator program of any kind: expressions where its stack is known, else a vectorised kernel.

    Gives the first `outputs` values of the stack; those that a run doesn't leave are 0.
    """
    compiled = calculator(text)

    def interpreted(xs: list[Column]) -> list[Column]:
        from leafmill.operators.colorspaces import run_calculator_columns
        from leafmill.shipping import ship

        spark = SparkSession.getActiveSession()
        ship(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")  # rows are narrow; file queries lower it

        @F.arrow_udf("array<double>")
        def run(*inputs: pa.Array) -> pa.Array:
            got = run_calculator_columns(text, [x.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False) for x in inputs], outputs)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * outputs), pa.array(got.reshape(-1)))

        got = run(*[x.cast("double") for x in xs])
        return [F.get(got, F.lit(i)) for i in range(outputs)]

    def make(xs: list[Column]) -> list[Column]:
        try:
            made = compiled(xs)
        except DynamicStack:
            return interpreted(xs)
        return [*made, *[F.lit(0.0)] * outputs][:outputs]

    return make
