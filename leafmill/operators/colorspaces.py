"""Colour spaces and function objects inside the render kernel: numbers and numpy arrays instead of columns."""

from __future__ import annotations

import math
import re

import numpy as np

from leafmill.sources.codecs import FilterFault
from leafmill.sources.document import Document
from leafmill.sources.syntax import Name, Stream

PARTS = {"DeviceGray": 1, "CalGray": 1, "G": 1, "DeviceRGB": 3, "CalRGB": 3, "RGB": 3, "DeviceCMYK": 4, "CMYK": 4, "Pattern": 0}


def _nums(doc: Document, v) -> list[float]:
    v = doc.get(v)
    return [float(x) for x in map(doc.get, v) if isinstance(x, (int, float))] if isinstance(v, list) else []


class Function:
    """A function object: call it with a list of arrays."""

    def __init__(self, doc: Document, v, depth: int = 0):
        v = doc.get(v)
        if isinstance(v, list):  # one function for each output
            parts = [Function(doc, x, depth + 1) for x in v]
            self.core, self.domain, self.range = lambda xs: [y for p in parts for y in p(xs)], [], []
            return
        d = v.dict if isinstance(v, Stream) else v if isinstance(v, dict) else {}
        pairs = lambda k: (lambda n: list(zip(n[::2], n[1::2])))(_nums(doc, d.get(k)))
        self.domain, self.range = pairs("Domain"), pairs("Range")
        kind = doc.get(d.get("FunctionType"))
        if kind == 2:
            c0, c1, n = _nums(doc, d.get("C0")) or [0.0], _nums(doc, d.get("C1")) or [1.0], float(doc.get(d.get("N")) or 1)
            self.core = lambda xs: [a + np.maximum(xs[0], 0.0) ** n * (b - a) for a, b in zip(c0, c1)]
        elif kind == 3 and depth < 8:
            parts = [Function(doc, x, depth + 1) for x in doc.get(d.get("Functions")) or []]
            self.core = self._stitch(parts, _nums(doc, d.get("Bounds")), pairs("Encode"))
        elif kind == 0 and isinstance(v, Stream):
            self.core = self._sampled(doc, v, pairs("Encode"), pairs("Decode"))
        elif kind == 4 and isinstance(v, Stream):
            program = doc.decoded(v).decode("latin-1")
            self.core = lambda xs: run_calculator(program, xs)
        else:
            raise FilterFault(f"function type {kind}")

    def __call__(self, xs: list) -> list:
        xs = [np.clip(xs[i] if i < len(xs) else 0.0, min(d), max(d)) for i, d in enumerate(self.domain)] if self.domain else xs
        ys = self.core(xs)
        return [np.clip(y, min(self.range[i]), max(self.range[i])) if i < len(self.range) else y for i, y in enumerate(ys)]

    @staticmethod
    def _stitch(parts, bounds, encode):
        def call(xs):
            x = np.asarray(xs[0], float)
            outs = []
            for i, p in enumerate(parts):
                lo, hi = (0.0 if i == 0 else bounds[i - 1]), (bounds[i] if i < len(bounds) else 1.0)
                a, b = encode[i] if i < len(encode) else (0.0, 1.0)
                outs.append(p([np.full_like(x, a) if abs(hi - lo) < 1e-12 else a + (x - lo) * (b - a) / (hi - lo)]))
            at = np.searchsorted(np.asarray(bounds[: len(parts) - 1]), x, side="right")
            return [np.choose(at, [np.broadcast_to(o[k], x.shape) for o in outs]) if len(parts) < 32 else outs[0][k] for k in range(len(outs[0]))]

        return call

    def _sampled(self, doc, s, encode, decode):
        d = s.dict
        size, bits = [max(1, int(v)) for v in _nums(doc, d.get("Size"))], int(doc.get(d.get("BitsPerSample")) or 8)
        outs, raw = max(1, len(self.range)), np.frombuffer(doc.decoded(s), np.uint8)
        every = np.unpackbits(raw)
        n = len(every) // bits
        table = every[: n * bits].reshape(n, bits).astype(np.float64) @ (2.0 ** np.arange(bits - 1, -1, -1))
        need = outs * math.prod(size)
        table = np.concatenate([table, np.zeros(max(0, need - len(table)))])[:need].reshape(*size[::-1], outs)
        encode = encode or [(0, v - 1) for v in size]
        decode = decode or self.range
        top = 2.0**bits - 1

        def call(xs):
            # places follow from 0 .. 1, not from the domain
            c = [np.clip(e[0] + np.asarray(x, float) * (e[1] - e[0]), 0, v - 1) for x, e, v in zip(xs, encode, size)]
            if len(c) == 1:
                lo = np.floor(c[0]).astype(int)
                hi = np.minimum(lo + 1, size[0] - 1)
                f = (c[0] - lo)[..., None]
                y = table[lo] * (1 - f) + table[hi] * f
            elif len(c) == 2:
                lo, hi = [np.floor(x).astype(int) for x in c], [np.minimum(np.floor(x).astype(int) + 1, v - 1) for x, v in zip(c, size)]
                fx, fy = (c[0] - lo[0])[..., None], (c[1] - lo[1])[..., None]
                y = (table[lo[1], lo[0]] * (1 - fx) + table[lo[1], hi[0]] * fx) * (1 - fy) + (table[hi[1], lo[0]] * (1 - fx) + table[hi[1], hi[0]] * fx) * fy
            else:
                y = table[tuple(np.floor(x + 0.5).astype(int) for x in reversed(c))]
            return [a + y[..., k] * (b - a) / top for k, (a, b) in enumerate(decode)]

        return call


def run_calculator(text: str, xs: list) -> list:
    """A calculator program on numbers; arrays are run value by value."""
    if any(np.ndim(x) for x in xs):
        shape = np.broadcast_shapes(*[np.shape(x) for x in xs])
        flat = [np.broadcast_to(x, shape).reshape(-1) for x in xs]
        rows = [run_calculator(text, [float(f[i]) for f in flat]) for i in range(len(flat[0]))]
        return [np.array([r[k] for r in rows]).reshape(shape) for k in range(len(rows[0]))] if rows else []
    from leafmill.functions.pdf_functions import _parse

    stack = [float(x) for x in xs]
    _run(_parse(text), stack)
    return stack


def _sign(v: float) -> float:
    return math.copysign(1.0, v)


def _whole(v: float) -> int:
    return 0 if math.isnan(v) else int(max(-(2.0**63), min(2.0**63, v)))


def _divide(a: float, b: float) -> float:
    """Quotient of the whole parts, cut towards zero; 0 by 0."""
    a, b = _whole(a), _whole(b)
    return float(abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)) if b else 0.0


def _rest(a: float, b: float) -> float:
    a, b = _whole(a), _whole(b)
    return float(abs(a) % abs(b) * (-1 if a < 0 else 1)) if b else 0.0


_ONE = {
    "neg": lambda a: -a, "abs": abs, "ceiling": math.ceil, "floor": math.floor, "round": lambda a: _sign(a) * math.floor(abs(a) + 0.5), "truncate": math.trunc, "cvi": math.trunc, "cvr": float,
    "sqrt": lambda a: math.sqrt(abs(a)), "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)),
    "ln": lambda a: math.log(abs(a)) if a else 0.0, "log": lambda a: math.log10(abs(a)) if a else 0.0, "not": lambda a: 1 - a if a in (0, 1) else ~int(a),
}
_TWO = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b if b else 0.0, "idiv": _divide,
    "mod": _rest, "exp": lambda a, b: a**b if a > 0 or b == int(b) and (a or b > 0) else 0.0, "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360.0,
    "eq": lambda a, b: abs(a - b) < 1e-12, "ne": lambda a, b: abs(a - b) >= 1e-12, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
    "and": lambda a, b: int(a) & int(b), "or": lambda a, b: int(a) | int(b), "xor": lambda a, b: int(a) ^ int(b),
    "bitshift": lambda a, b: int(a) << min(63, int(b)) if b >= 0 else int(a) >> min(63, int(-b)),
}


def _run(tokens: list, s: list) -> None:
    i = 0
    while i < len(tokens):
        t = tokens[i]
        i += 1
        if isinstance(t, list):
            nxt = tokens[i] if i < len(tokens) else None
            if nxt == "if":
                i += 1
                if s and s.pop():
                    _run(t, s)
            elif isinstance(nxt, list) and i + 1 < len(tokens) and tokens[i + 1] == "ifelse":
                i += 2
                if s:
                    _run(t if s.pop() else nxt, s)
        elif t in _ONE:
            if s:
                s.append(float(_ONE[t](s.pop())))
        elif t in _TWO:
            if len(s) >= 2:
                b, a = s.pop(), s.pop()
                try:
                    s.append(float(_TWO[t](a, b)))
                except OverflowError:
                    s.append(0.0)
        elif t == "pop":
            del s[-1:]
        elif t == "exch":
            if len(s) >= 2:
                s[-2:] = s[:-3:-1]
        elif t == "dup":
            s += s[-1:]
        elif t in ("copy", "index"):
            n = int(s.pop()) if s else -1
            if t == "copy" and 0 < n <= len(s):
                s += s[-n:]
            elif t == "index" and 0 <= n < len(s):
                s.append(s[-1 - n])
        elif t == "roll":
            if len(s) >= 2:
                j, n = int(s.pop()), int(s.pop())
                if 0 < n <= len(s):
                    part = s[-n:]
                    j %= n
                    s[-n:] = part[n - j :] + part[: n - j]
        elif t in ("true", "false"):
            s.append(float(t == "true"))
        elif re.fullmatch(r"[+-]?[0-9.]+", t):
            s.append(float(t))
        del s[:-100]


def _finite(*v) -> bool:
    return all(bool((np.abs(x) < 2.0**53).all()) for x in v)


#: The same on arrays, bit for bit; None where an array holds what only the function of one value settles.
_ONE_ARRAY = {
    "neg": np.negative, "abs": np.abs, "cvr": lambda a: a, "sqrt": lambda a: np.sqrt(np.abs(a)),
    "ceiling": lambda a: np.ceil(a) + 0.0 if _finite(a) else None, "floor": lambda a: np.floor(a) + 0.0 if _finite(a) else None,
    "truncate": lambda a: np.trunc(a) + 0.0 if _finite(a) else None, "cvi": lambda a: np.trunc(a) + 0.0 if _finite(a) else None,
    "round": lambda a: np.copysign(1.0, a) * np.floor(np.abs(a) + 0.5) if _finite(a) else None,
}
_TWO_ARRAY = {
    "add": np.add, "sub": np.subtract, "mul": np.multiply, "div": lambda a, b: np.where(b != 0, a / b, 0.0),
    "mod": lambda a, b: np.where(np.trunc(b) != 0, np.fmod(np.trunc(a), np.trunc(b)), 0.0) + 0.0 if _finite(a, b) else None,
    "eq": lambda a, b: np.abs(a - b) < 1e-12, "ne": lambda a, b: np.abs(a - b) >= 1e-12, "gt": np.greater, "ge": np.greater_equal, "lt": np.less, "le": np.less_equal,
}


def run_calculator_columns(text: str, xs: list[np.ndarray], outputs: int) -> np.ndarray:
    """The first `outputs` values of the stack that a program leaves for each row, 0 where there is none.

    Rows that take the same way through the program are run together; where a branch or a count comes from
    data, they part.
    """
    from leafmill.functions.pdf_functions import _parse

    n = len(xs[0]) if xs else 0
    out = np.zeros((n, outputs))
    todo = [([(_parse(text), 0)], [np.asarray(x, np.float64) for x in xs], np.arange(n))] if n else []

    def call(f, arrays, args):
        """An operator on a whole column, or value by value."""
        got = arrays(*args) if arrays else None
        return np.array([f(*v) for v in zip(*[a.tolist() for a in args])], np.float64) if got is None else np.asarray(got, np.float64)

    def two(t):
        def one(a, b):
            try:
                return float(_TWO[t](a, b))
            except OverflowError:
                return 0.0

        return one

    with np.errstate(all="ignore"):
        while todo:
            frames, s, rows = todo.pop()
            while frames:
                tokens, i = frames.pop()
                if i >= len(tokens):
                    del s[:-100]
                    continue
                t, held = tokens[i], (list(frames), list(s))
                nxt = tokens[i + 1] if i + 1 < len(tokens) else None
                either = isinstance(t, list) and isinstance(nxt, list) and i + 2 < len(tokens) and tokens[i + 2] == "ifelse"
                takes = 1 if isinstance(t, list) and (nxt == "if" or either) or t in ("copy", "index") else 2 if t == "roll" and len(s) >= 2 else 0
                if takes and len(s) >= takes:  # what rows take from the stack here must be the same for all
                    picked = np.stack([s[-k] for k in range(1, takes + 1)])
                    keys = picked != 0 if isinstance(t, list) else np.trunc(picked)
                    if not (keys == keys[:, :1]).all():
                        if not np.isfinite(keys).all():
                            raise ValueError("a count isn't a number")
                        kinds, of = np.unique(keys, axis=1, return_inverse=True)
                        for k in range(kinds.shape[1]):
                            mine = np.flatnonzero(of.reshape(-1) == k)
                            todo.append(([*held[0], (tokens, i)], [x[mine] for x in held[1]], rows[mine]))
                        break
                step = 1
                if isinstance(t, list):
                    step = 2 if nxt == "if" else 3 if either else 1
                    block = None
                    if step > 1 and s:
                        test = bool(s.pop()[0])
                        block = t if test else nxt if either else None
                    frames.append((tokens, i + step))
                    if block is not None:
                        frames.append((block, 0))
                        continue
                else:
                    frames.append((tokens, i + 1))
                    if t in _ONE:
                        if s:
                            s.append(call(lambda v, t=t: float(_ONE[t](v)), _ONE_ARRAY.get(t), [s.pop()]))
                    elif t in _TWO:
                        if len(s) >= 2:
                            b, a = s.pop(), s.pop()
                            s.append(call(two(t), _TWO_ARRAY.get(t), [a, b]))
                    elif t in ("copy", "index", "roll"):  # counts are alike: stand-ins show where each value goes
                        take = min(len(s), 2 if t == "roll" else 1)
                        if take and (t != "roll" or take == 2):
                            base = s[: len(s) - take]
                            counts = [float(x[0]) for x in s[len(s) - take :]]
                            s[:] = [base[k] for k in _placed(t, len(base), counts)]
                    elif t == "pop":
                        del s[-1:]
                    elif t == "exch":
                        if len(s) >= 2:
                            s[-2:] = s[:-3:-1]
                    elif t == "dup":
                        s += s[-1:]
                    else:
                        own: list[float] = []
                        _run([t], own)
                        s += [np.full(len(rows), v) for v in own]
                del s[:-100]
            else:
                for k, v in enumerate(s[:outputs]):
                    out[rows, k] = v
    return out


def _placed(t: str, n: int, counts: list[float]) -> list[int]:
    """Places in a stack of n values after copy, index or roll with these counts."""
    places: list = list(range(n))
    if t == "roll":
        n_roll, j = int(counts[0]), int(counts[1])
        if 0 < n_roll <= n:
            part, j = places[-n_roll:], j % n_roll
            places[-n_roll:] = part[n_roll - j :] + part[: n_roll - j]
    else:
        k = int(counts[0])
        if t == "copy" and 0 < k <= n:
            places += places[-k:]
        elif t == "index" and 0 <= k < n:
            places.append(places[-1 - k])
    return places


class Space:
    """A colour space: `n` components, `rgb` from arrays of them to floats of 0 .. 1."""

    def __init__(self, doc: Document, v=Name("DeviceGray"), resources: dict | None = None, depth: int = 0):
        v = doc.get(v)
        named = doc.value(resources or {}, "ColorSpace", dict) or {}
        if isinstance(v, Name) and v not in PARTS and v in named and depth < 8:
            v = doc.get(named[v])
        self.kind, self.n, self.base, self.under = "DeviceGray", 1, None, None
        if depth > 8:
            return
        if isinstance(v, Name):
            self._device(str(v))
            return
        if not isinstance(v, list) or not v:
            return
        kind = str(doc.get(v[0]))
        arg = lambda i: doc.get(v[i]) if i < len(v) else None
        if kind in PARTS:
            self._device(kind)
            if kind == "Pattern" and len(v) > 1:
                self.under = Space(doc, v[1], resources, depth + 1)
        elif kind == "ICCBased":
            s = arg(1)
            alternate = doc.value(s, "Alternate") if isinstance(s, Stream) else None
            if alternate is not None:
                other = Space(doc, alternate, resources, depth + 1)
                self.__dict__.update(other.__dict__)
            else:
                n = doc.value(s, "N") if isinstance(s, Stream) else 3
                self._device({1: "DeviceGray", 4: "DeviceCMYK"}.get(n, "DeviceRGB"))
        elif kind == "Lab":
            self.kind, self.n = "Lab", 3
            d = arg(1) if isinstance(arg(1), dict) else {}
            self.white = _nums(doc, d.get("WhitePoint")) or [0.9505, 1.0, 1.089]
            self.limits = _nums(doc, d.get("Range")) or [-100.0, 100.0, -100.0, 100.0]
        elif kind in ("Indexed", "I"):
            self.kind, self.n, self.base = "Indexed", 1, Space(doc, arg(1), resources, depth + 1)
            table = arg(3)
            raw = doc.decoded(table) if isinstance(table, Stream) else bytes(table or b"")
            self.top = max(0, min(255, int(arg(2) or 0)))
            need = (self.top + 1) * self.base.n
            self.table = np.frombuffer(raw[:need].ljust(need, b"\0"), np.uint8).reshape(-1, self.base.n)
        elif kind in ("Separation", "DeviceN"):
            names = arg(1)
            self.kind, self.n = "Tint", len(names) if isinstance(names, list) else 1
            self.base, self.tint = Space(doc, arg(2), resources, depth + 1), Function(doc, arg(3))

    def _device(self, kind: str) -> None:
        n = PARTS.get(kind, 1)
        self.kind, self.n = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK", 0: "Pattern"}[n], n

    def start(self) -> list[float]:
        return [0.0, 0.0, 0.0, 1.0] if self.kind == "DeviceCMYK" else [1.0] * self.n if self.kind == "Tint" else [0.0] * self.n

    def ranges(self, bits: int) -> list[tuple[float, float]]:
        """Decode array that images of this space have unless they say another."""
        if self.kind == "Indexed":
            return [(0.0, float(2**bits - 1))]
        if self.kind == "Lab":
            return [(0.0, 100.0), tuple(self.limits[:2]), tuple(self.limits[2:4])]
        return [(0.0, 1.0)] * self.n

    def rgb(self, c: list) -> np.ndarray:
        c = [np.nan_to_num(np.asarray(x, float)) for x in c] + [np.zeros(())] * max(0, self.n - len(c))
        if self.kind == "DeviceRGB":
            out = c[:3]
        elif self.kind == "DeviceCMYK":
            out = [1 - np.minimum(1, np.maximum(x, 0) + np.maximum(c[3], 0)) for x in c[:3]]
        elif self.kind == "Lab":
            fy = (np.clip(c[0], 0, 100) + 16) / 116
            f = [c[1] / 500 + fy, fy, fy - c[2] / 200]
            x, y, z = (np.where(t > 6 / 29, t**3, 3 * (6 / 29) ** 2 * (t - 4 / 29)) * max(w, 1e-10) for t, w in zip(f, self.white))
            lin = [3.2404542 * x - 1.5371385 * y - 0.4985314 * z, -0.9692660 * x + 1.8760108 * y + 0.0415560 * z, 0.0556434 * x - 0.2040259 * y + 1.0572252 * z]
            out = [np.where(v <= 0.0031308, 12.92 * v, 1.055 * np.clip(v, 0, 1) ** (1 / 2.4) - 0.055) for v in (np.clip(w, 0, 1) for w in lin)]
        elif self.kind == "Indexed":
            at = np.clip(np.floor(c[0] + 0.5), 0, self.top).astype(int)
            part = self.table[at] / 255.0
            low = self.base.ranges(8)
            return self.base.rgb([low[k][0] + part[..., k] * (low[k][1] - low[k][0]) for k in range(self.base.n)])
        elif self.kind == "Tint":
            return self.base.rgb(self.tint(c[: self.n]))
        else:
            out = [c[0]] * 3
        return np.clip(np.stack(np.broadcast_arrays(*out), -1), 0, 1)
