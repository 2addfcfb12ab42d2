"""JBIG2: generic, refinement, symbol, text, pattern and halftone segments on a page, arithmetic coding.

Output is one bit a pixel, white 1, as image filters give it. Huffman coded symbols and text, segments of
unknown length and MMR halftones are refused.
"""

from __future__ import annotations

import numpy as np

from leafmill.sources.codecs import FilterFault

MAX_SIDE = 65_536

# Fixed values (ITU-T T.88, table E.1): estimate, next state after the likelier and the other symbol, switch.
_QE = [
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0),
    (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0),
    (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0),
    (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0),
    (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
]


class Arithmetic:
    """The MQ decoder; contexts are lists of (state, likelier symbol) packed as state * 2 + symbol."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.c = self._byte(0) << 16
        self.ct = 0
        self._fill()
        self.c <<= 7
        self.ct -= 7
        self.a = 0x8000

    def _byte(self, i: int) -> int:
        return self.data[i] if i < len(self.data) else 0xFF

    def _fill(self) -> None:
        if self._byte(self.at) == 0xFF:
            if self._byte(self.at + 1) > 0x8F:
                self.c += 0xFF00
                self.ct = 8
            else:
                self.at += 1
                self.c += self._byte(self.at) << 9
                self.ct = 7
        else:
            self.at += 1
            self.c += self._byte(self.at) << 8
            self.ct = 8

    def bit(self, cx: list[int], i: int) -> int:
        packed = cx[i]
        state, mps = packed >> 1, packed & 1
        qe, up, down, switch = _QE[state]
        self.a -= qe
        if (self.c >> 16) < qe:  # the lower part
            exchanged = self.a < qe
            self.a = qe
            lps = not exchanged
        else:
            self.c -= qe << 16
            if self.a & 0x8000:
                return mps
            lps = self.a < qe
        d = mps ^ lps
        cx[i] = (down << 1 | mps ^ switch) if lps else (up << 1 | mps)
        while True:
            if not self.ct:
                self._fill()
            self.a <<= 1
            self.c = self.c << 1 & 0xFFFFFFFF
            self.ct -= 1
            if self.a & 0x8000:
                return d

    def integer(self, cx: list[int]) -> int | None:
        """A number, None for out of band."""
        prev = 1

        def bit():
            nonlocal prev
            b = self.bit(cx, prev)
            prev = prev << 1 | b if prev < 256 else (prev << 1 | b) & 511 | 256
            return b

        sign = bit()
        for size, base in ((2, 0), (4, 4), (6, 20), (8, 84), (12, 340), (32, 4436)):
            if size == 32 or not bit():
                break
        v = 0
        for _ in range(size):
            v = v << 1 | bit()
        v += base
        return (-v if v else None) if sign else v

    def ident(self, cx: list[int], size: int) -> int:
        prev = 1
        for _ in range(size):
            prev = prev << 1 | self.bit(cx, prev)
        return prev - (1 << size)


# Pixels of the generic templates in context order, highest bit first; "a" marks adaptive ones.
_TEMPLATES = [
    ["a3", (-1, -2), (0, -2), (1, -2), "a2", "a1", (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), "a0", (-4, 0), (-3, 0), (-2, 0), (-1, 0)],
    [(-1, -2), (0, -2), (1, -2), (2, -2), (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), "a0", (-3, 0), (-2, 0), (-1, 0)],
    [(-1, -2), (0, -2), (1, -2), (-2, -1), (-1, -1), (0, -1), (1, -1), "a0", (-2, 0), (-1, 0)],
    [(-3, -1), (-2, -1), (-1, -1), (0, -1), (1, -1), "a0", (-4, 0), (-3, 0), (-2, 0), (-1, 0)],
]
_TYPICAL = [0x9B25, 0x0795, 0x00E5, 0x0195]


def generic(mq: Arithmetic, cx: list[int], w: int, h: int, template: int, at: list, typical: bool = False, skip: np.ndarray | None = None) -> np.ndarray:
    """A bitmap (h, w) coded pixel by pixel against its neighbours."""
    _fits(w, h)
    near = [at[int(p[1])] if isinstance(p, str) else p for p in _TEMPLATES[template]]
    pad = 130
    rows = [[0] * (w + 2 * pad) for _ in range(h + pad)]
    same = 0
    for y in range(h):
        row = rows[y + pad]
        if typical:
            same ^= mq.bit(cx, _TYPICAL[template])
            if same:
                row[:] = rows[y + pad - 1]
                continue
        lines = [(rows[y + pad + dy], dx + pad) for dx, dy in near]
        for x in range(w):
            if skip is not None and skip[y, x]:
                continue
            c = 0
            for line, dx in lines:
                c = c << 1 | line[x + dx]
            row[x + pad] = mq.bit(cx, c)
    return np.array([r[pad : pad + w] for r in rows[pad:]], np.uint8).reshape(h, w)


_REFINE = [
    ([(-1, -1), (0, -1), (1, -1), (-1, 0)], [(-1, -1), (0, -1), (1, -1), (-1, 0), (0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]),
    ([(-1, -1), (0, -1), (1, -1), (-1, 0)], [(0, -1), (-1, 0), (0, 0), (1, 0), (0, 1), (1, 1)]),
]


def refine(mq: Arithmetic, cx: list[int], w: int, h: int, template: int, ref: np.ndarray, dx: int, dy: int, at: list) -> np.ndarray:
    """A bitmap coded against another one."""
    _fits(w, h)
    own, other = _REFINE[template]
    own, other = list(own), list(other)
    if not template:
        own[0], other[0] = at[0], at[1]
    out = np.zeros((h, w), np.uint8)
    rh, rw = ref.shape
    for y in range(h):
        for x in range(w):
            c = 0
            for ox, oy in own:
                px, py = x + ox, y + oy
                c = c << 1 | (int(out[py, px]) if 0 <= px < w and 0 <= py < h else 0)
            for ox, oy in other:
                px, py = x - dx + ox, y - dy + oy
                c = c << 1 | (int(ref[py, px]) if 0 <= px < rw and 0 <= py < rh else 0)
            out[y, x] = mq.bit(cx, c)
    return out


def combine(page: np.ndarray, part: np.ndarray, x: int, y: int, how: int) -> None:
    """0 or, 1 and, 2 xor, 3 xnor, 4 replace."""
    h, w = page.shape
    x0, y0, x1, y1 = max(0, x), max(0, y), min(w, x + part.shape[1]), min(h, y + part.shape[0])
    if x0 >= x1 or y0 >= y1:
        return
    src, dst = part[y0 - y : y1 - y, x0 - x : x1 - x], page[y0:y1, x0:x1]
    dst[:] = (dst | src, dst & src, dst ^ src, 1 - (dst ^ src), src)[how]


def _fits(w: int, h: int) -> None:
    if not 0 <= w <= MAX_SIDE or not 0 <= h <= MAX_SIDE or w * h > 1 << 28:
        raise FilterFault("JBIG2 size")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def u(self, n: int) -> int:
        v = int.from_bytes(self.data[self.at : self.at + n], "big")
        if self.at + n > len(self.data):
            raise FilterFault("JBIG2 data ends")
        self.at += n
        return v

    def adaptive(self, n: int) -> list[tuple[int, int]]:
        return [tuple(v - 256 if v > 127 else v for v in (self.u(1), self.u(1))) for _ in range(n)]


class _Page:
    def __init__(self):
        self.px = None
        self.results: dict[int, object] = {}

    def run(self, data: bytes) -> None:
        r = _Reader(data)
        while r.at + 11 <= len(data):
            number, flags = r.u(4), r.u(1)
            count = r.u(1)
            if count >> 5 == 7:
                r.at -= 1
                n = r.u(4) & 0x1FFFFFFF
                r.at += -(-(n + 1) // 8)
            else:
                n = count >> 5
            size = 1 if number <= 256 else 2 if number <= 65536 else 4
            refs = [r.u(size) for _ in range(n)]
            r.u(4 if flags & 64 else 1)
            length = r.u(4)
            if length == 0xFFFFFFFF:
                raise FilterFault("JBIG2 segment of unknown length")
            body = _Reader(data[r.at : r.at + length])
            r.at += length
            self.segment(flags & 63, number, refs, body)

    def segment(self, kind: int, number: int, refs: list[int], r: _Reader) -> None:
        if kind == 48:
            w, h = r.u(4), r.u(4)
            r.at += 8
            flags, stripe = r.u(1), r.u(2)
            if h == 0xFFFFFFFF:
                h = stripe & 0x7FFF
            _fits(w, h)
            self.px = np.full((h, w), flags >> 2 & 1, np.uint8)
        elif kind == 0:
            self.results[number] = self.symbols(refs, r)
        elif kind == 16:
            self.results[number] = self.patterns(r)
        elif kind in (4, 6, 7, 20, 22, 23, 36, 38, 39, 40, 42, 43):
            w, h, x, y, how = r.u(4), r.u(4), r.u(4), r.u(4), r.u(1) & 7
            _fits(w, h)
            make = self.text if kind < 8 else self.halftone if kind < 24 else self.generic_region if kind < 40 else self.refinement
            part = make(refs, r, w, h) if kind < 40 else self.refinement(refs, r, w, h, x, y)
            if kind in (4, 20, 36, 40):
                self.results[number] = part
            else:
                if self.px is None:
                    raise FilterFault("JBIG2 region before its page")
                if y + h > self.px.shape[0] and y + h <= MAX_SIDE:  # a page of stripes grows
                    self.px = np.concatenate([self.px, np.zeros((y + h - self.px.shape[0], self.px.shape[1]), np.uint8)])
                combine(self.px, part, x, y, how)

    def generic_region(self, refs, r: _Reader, w: int, h: int) -> np.ndarray:
        flags = r.u(1)
        if flags & 1:
            return _mmr(r.data[r.at :], w, h)
        template = flags >> 1 & 3
        at = r.adaptive(4 if template == 0 else 1)
        return generic(Arithmetic(r.data[r.at :]), [0] * 65536, w, h, template, at, bool(flags & 8))

    def refinement(self, refs, r: _Reader, w: int, h: int, x: int, y: int) -> np.ndarray:
        flags = r.u(1)
        at = r.adaptive(2) if not flags & 1 else []
        ref = self.results[refs[0]] if refs else self.px[y : y + h, x : x + w]
        return refine(Arithmetic(r.data[r.at :]), [0] * 8192, w, h, flags & 1, ref, 0, 0, at)

    def symbols(self, refs, r: _Reader) -> list[np.ndarray]:
        flags = r.u(2)
        if flags & 1:
            raise FilterFault("Huffman symbols")
        aggregate, template, refined = flags >> 1 & 1, flags >> 10 & 3, flags >> 12 & 1
        at = r.adaptive(4 if template == 0 else 1)
        rat = r.adaptive(2) if aggregate and not refined else []
        n_out, n_new = r.u(4), r.u(4)
        known = [s for k in refs for s in self.results.get(k, []) if isinstance(self.results.get(k), list)]
        mq = Arithmetic(r.data[r.at :])
        cx = _Contexts(len(known) + n_new)
        out, height = [], 0
        while len(out) < n_new:
            height += mq.integer(cx["dh"]) or 0
            width = 0
            while True:
                dw = mq.integer(cx["dw"])
                if dw is None or len(out) >= n_new:
                    break
                width += dw
                _fits(width, height)
                if not aggregate:
                    out.append(generic(mq, cx.generic, width, height, template, at))
                    continue
                n = mq.integer(cx["ai"])
                every = known + out
                if n == 1:
                    k = mq.ident(cx.ident, cx.size)
                    dx, dy = mq.integer(cx["rx"]) or 0, mq.integer(cx["ry"]) or 0
                    if k >= len(every):
                        raise FilterFault("JBIG2 symbol")
                    out.append(refine(mq, cx.refine, width, height, refined, every[k], dx, dy, rat))
                else:
                    out.append(_text(mq, cx, width, height, n or 0, every, {"refine": True, "strips": 1, "corner": 1, "how": 0, "default": 0, "offset": 0, "transposed": False, "log": 0, "template": refined, "at": rat}))
        every, keep, flag, i = known + out, [], 0, 0
        while i < len(every):
            run = mq.integer(cx["ex"])
            if run is None or run < 0 or i + run > len(every):
                break
            if flag:
                keep += every[i : i + run]
            i, flag = i + run, flag ^ 1
            if not run and i >= len(every):
                break
        return keep[:n_out]

    def text(self, refs, r: _Reader, w: int, h: int) -> np.ndarray:
        flags = r.u(2)
        if flags & 1:
            raise FilterFault("Huffman text")
        offset = flags >> 10 & 31
        p = {"refine": bool(flags & 2), "log": flags >> 2 & 3, "strips": 1 << (flags >> 2 & 3), "corner": flags >> 4 & 3, "transposed": bool(flags & 64), "how": flags >> 7 & 3, "default": flags >> 9 & 1, "offset": offset - 32 if offset > 15 else offset, "template": flags >> 15 & 1}
        p["at"] = r.adaptive(2) if p["refine"] and not p["template"] else []
        n = r.u(4)
        known = [s for k in refs if isinstance(self.results.get(k), list) for s in self.results[k]]
        return _text(Arithmetic(r.data[r.at :]), _Contexts(len(known)), w, h, n, known, p)

    def patterns(self, r: _Reader) -> list[np.ndarray]:
        flags, w, h, top = r.u(1), r.u(1), r.u(1), r.u(4)
        n = top + 1
        if flags & 1:
            whole = _mmr(r.data[r.at :], w * n, h)
        else:
            at = [(-w, 0), (-3, -1), (2, -2), (-2, -2)]
            whole = generic(Arithmetic(r.data[r.at :]), [0] * 65536, w * n, h, flags >> 1 & 3, at)
        return [whole[:, i * w : (i + 1) * w] for i in range(n)]

    def halftone(self, refs, r: _Reader, w: int, h: int) -> np.ndarray:
        flags = r.u(1)
        if flags & 1 or flags & 8:
            raise FilterFault("this halftone is not supported")
        template, how, default = flags >> 1 & 3, flags >> 4 & 7, flags >> 7
        gw, gh = r.u(4), r.u(4)
        signed = lambda v: v - (1 << 32) if v >> 31 else v
        x0, y0, vx, vy = signed(r.u(4)), signed(r.u(4)), r.u(2), r.u(2)
        cells = self.results[refs[0]]
        bits = max(1, (len(cells) - 1).bit_length())
        mq, cx = Arithmetic(r.data[r.at :]), [0] * 65536
        at = [(3 if template <= 1 else 2, -1), (-3, -1), (2, -2), (-2, -2)]
        planes = [generic(mq, cx, gw, gh, template, at)]
        for _ in range(bits - 1):  # Gray code, highest plane first
            planes.append(generic(mq, cx, gw, gh, template, at) ^ planes[-1])
        gray = sum(p.astype(np.int64) << (bits - 1 - i) for i, p in enumerate(planes))
        out = np.full((h, w), default, np.uint8)
        for m in range(gh):
            for n in range(gw):
                combine(out, cells[min(int(gray[m, n]), len(cells) - 1)], (x0 + m * vy + n * vx) >> 8, (y0 + m * vx - n * vy) >> 8, how)
        return out


class _Contexts(dict):
    """Contexts of one segment, made as they are asked for."""

    def __init__(self, symbols: int):
        self.size = max(symbols - 1, 0).bit_length()
        self.generic, self.refine, self.ident = [0] * 65536, [0] * 8192, [0] * (1 << (self.size + 1))

    def __missing__(self, key):
        self[key] = [0] * 512
        return self[key]


def _text(mq: Arithmetic, cx: _Contexts, w: int, h: int, n: int, known: list, p: dict) -> np.ndarray:
    """Instances of symbols in strips; the corner says which point of a symbol a place means."""
    out = np.full((h, w), p["default"], np.uint8)
    strip, first, done = -(mq.integer(cx["dt"]) or 0) * p["strips"], 0, 0
    while done < n:
        strip += (mq.integer(cx["dt"]) or 0) * p["strips"]
        first += mq.integer(cx["fs"]) or 0
        s = first
        while True:
            t = strip + ((mq.integer(cx["it"]) or 0) if p["strips"] > 1 else 0)
            k = mq.ident(cx.ident, cx.size)
            if k >= len(known):
                raise FilterFault("JBIG2 symbol")
            sym = known[k]
            if p["refine"] and mq.integer(cx["ri"]):
                dw, dh, dx, dy = (mq.integer(cx[c]) or 0 for c in ("rw", "rh", "rx", "ry"))
                sym = refine(mq, cx.refine, sym.shape[1] + dw, sym.shape[0] + dh, p["template"], sym, (dw >> 1) + dx, (dh >> 1) + dy, p["at"])
            sh, sw = sym.shape
            bottom, right = p["corner"] in (0, 2), p["corner"] in (2, 3)
            step = (sh if p["transposed"] else sw) - 1
            back = bottom if p["transposed"] else right
            s += step if back else 0
            x, y = (t, s) if p["transposed"] else (s, t)
            combine(out, sym, x - (sw - 1 if right else 0), y - (sh - 1 if bottom else 0), p["how"])
            s += 0 if back else step
            done += 1
            ds = mq.integer(cx["ds"])
            if ds is None or done >= n:
                break
            s += ds + p["offset"]
    return out


def _mmr(data: bytes, w: int, h: int) -> np.ndarray:
    from leafmill.sources import ccitt

    raw = ccitt.decode(data, {"K": -1, "Columns": w, "Rows": h, "BlackIs1": True})
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(h, -1), axis=1)[:, :w]


def decode(data: bytes, parms: dict) -> bytes:
    """Rows of an embedded file, its global segments first; white pixels are 1."""
    from leafmill.sources.codecs import decode_stream
    from leafmill.sources.syntax import Stream

    page, shared = _Page(), parms.get("JBIG2Globals")
    try:
        if isinstance(shared, Stream):
            page.run(decode_stream(shared))
        page.run(data)
    except (IndexError, KeyError, TypeError, AttributeError) as e:
        raise FilterFault(f"broken JBIG2: {e}") from None
    if page.px is None:
        raise FilterFault("JBIG2 without a page")
    return np.packbits(1 - page.px, axis=1).tobytes()
