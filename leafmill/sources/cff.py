"""Compact Font Format: indexes, dictionaries, and the Type 2 charstring machine."""

from __future__ import annotations

import math

from leafmill.sources.truetype import FontFault, directory

MAX_STEPS, MAX_CALLS = 100_000, 10


def _index(b: bytes, at: int) -> tuple[list[bytes], int]:
    n = int.from_bytes(b[at : at + 2], "big")
    if not n:
        return [], at + 2
    w = b[at + 2]
    if not 1 <= w <= 4:
        raise FontFault("bad index")
    ends = [int.from_bytes(b[at + 3 + i * w : at + 3 + (i + 1) * w], "big") for i in range(n + 1)]
    base = at + 2 + (n + 1) * w
    if base + ends[-1] > len(b):
        raise FontFault("the index runs past the data")
    return [b[base + x : base + y] for x, y in zip(ends, ends[1:])], base + ends[-1]


def _dict(b: bytes) -> dict[int, list[float]]:
    out, held, at = {}, [], 0
    while at < len(b):
        c = b[at]
        at += 1
        if c <= 21:
            if c == 12 and at < len(b):
                c = 1200 + b[at]
                at += 1
            out[c], held = held, []
        elif c == 30:
            text = ""
            while at < len(b):
                x = b[at]
                at += 1
                text += "".join("0123456789.EE -"[k] + ("-" if k == 12 else "") if k < 15 else "" for k in (x >> 4, x & 15))
                if x & 15 == 15 or x >> 4 == 15:
                    break
            try:
                held.append(float(text.replace(" ", "")))
            except ValueError:
                held.append(0.0)
        elif c == 28:
            held.append(int.from_bytes(b[at : at + 2], "big", signed=True))
            at += 2
        elif c == 29:
            held.append(int.from_bytes(b[at : at + 4], "big", signed=True))
            at += 4
        elif c <= 246:
            held.append(c - 139)
        elif c <= 250:
            held.append((c - 247) * 256 + b[at] + 108)
            at += 1
        elif c <= 254:
            held.append(-(c - 251) * 256 - b[at] - 108)
            at += 1
    return out


class Cff:
    def __init__(self, data: bytes):
        if data[:4] == b"OTTO":
            data = directory(data).get("CFF ", b"")
        if len(data) < 4:
            raise FontFault("no CFF data")
        self.data = data
        try:
            _, at = _index(data, data[2])
            tops, at = _index(data, at)
            self.strings, at = _index(data, at)
            self.globals, _ = _index(data, at)
            self.top = top = _dict(tops[0])
            self.glyphs, _ = _index(data, int(top[17][0]))
        except (IndexError, KeyError) as e:
            raise FontFault(f"broken CFF: {e}") from None
        self.matrix = tuple(top.get(1207) or (0.001, 0, 0, 0.001, 0, 0))
        self.cid = 1230 in top
        self.locals = [self._subrs(top)]
        self.select = None
        if self.cid and 1236 in top:
            fonts, _ = _index(data, int(top[1236][0]))
            self.locals = [self._subrs(_dict(f)) for f in fonts]
            self.select = self._fd_select(int(top[1237][0])) if 1237 in top else None
        self.charset = self._charset(int((top.get(15) or [0])[0]))

    def _subrs(self, d: dict) -> list[bytes]:
        size, at = (int(v) for v in (d.get(18) or [0, 0])[:2])
        private = _dict(self.data[at : at + size])
        if 19 not in private:
            return []
        return _index(self.data, at + int(private[19][0]))[0]

    def _fd_select(self, at: int) -> list[int]:
        b, n = self.data, len(self.glyphs)
        if b[at] == 0:
            return list(b[at + 1 : at + 1 + n])
        out, k = [], int.from_bytes(b[at + 1 : at + 3], "big")
        for i in range(k):
            e = at + 3 + 3 * i
            first, nxt = int.from_bytes(b[e : e + 2], "big"), int.from_bytes(b[e + 3 : e + 5], "big")
            out += [b[e + 2]] * (nxt - first)
        return out[:n]

    def _charset(self, at: int) -> list[int]:
        """String or character id of each glyph."""
        n, b = len(self.glyphs), self.data
        if at <= 2:
            return list(range(n))
        out, kind = [0], b[at]
        at += 1
        while len(out) < n and at + 1 < len(b):
            first = int.from_bytes(b[at : at + 2], "big")
            at += 2
            left = 0
            if kind:
                left = int.from_bytes(b[at : at + kind], "big")
                at += kind
            out += range(first, first + left + 1)
        return out[:n]

    def gid_of_cid(self, cid: int) -> int:
        return self.charset.index(cid) if self.cid and cid in self.charset else cid if cid < len(self.glyphs) else 0

    def draw(self, gid: int, path, m) -> None:
        if not 0 <= gid < len(self.glyphs):
            return
        from leafmill.operators.text import mul

        fd = self.select[gid] if self.select and gid < len(self.select) else 0
        _Machine(self, self.locals[fd] if fd < len(self.locals) else [], path, mul(self.matrix, m)).glyph(self.glyphs[gid])


class _Machine:
    """Type 2 charstrings. Each operator takes the whole stack; hints only count for their mask bytes."""

    def __init__(self, font: Cff, subrs: list[bytes], path, m):
        self.font, self.subrs, self.path, self.m = font, subrs, path, m
        self.stack: list[float] = []
        self.x = self.y = 0.0
        self.hints = self.steps = 0
        self.width_seen = self.open = self.done = False
        self.store: dict[int, float] = {}

    def glyph(self, code: bytes) -> None:
        self.run(code, 0)
        if self.open:
            self.path.close()

    def _at(self):
        m = self.m
        return m[0] * self.x + m[2] * self.y + m[4], m[1] * self.x + m[3] * self.y + m[5]

    def move(self, dx, dy):
        if self.open:
            self.path.close()
        self.x, self.y, self.open = self.x + dx, self.y + dy, True
        self.path.move(*self._at())

    def line(self, dx, dy):
        self.x, self.y = self.x + dx, self.y + dy
        self.path.line(*self._at())

    def curve(self, a, b, c, d, e, f):
        pts = []
        for dx, dy in ((a, b), (c, d), (e, f)):
            self.x, self.y = self.x + dx, self.y + dy
            pts.append(self._at())
        self.path.curve(*pts)

    def width(self, expected: int | None) -> None:
        """The first operator may have one value more: the width."""
        if not self.width_seen:
            self.width_seen = True
            n = len(self.stack)
            if (n % 2 == 1) if expected is None else n > expected:
                del self.stack[0]

    def run(self, b: bytes, depth: int) -> None:
        at, s = 0, self.stack
        while at < len(b) and not self.done and self.steps < MAX_STEPS:
            self.steps += 1
            c = b[at]
            at += 1
            if c == 28:
                s.append(int.from_bytes(b[at : at + 2], "big", signed=True))
                at += 2
            elif c >= 32:
                if c <= 246:
                    s.append(c - 139)
                elif c == 255:
                    s.append(int.from_bytes(b[at : at + 4], "big", signed=True) / 65536)
                    at += 4
                else:
                    low = b[at] if at < len(b) else 0
                    s.append((c - 247) * 256 + low + 108 if c <= 250 else -(c - 251) * 256 - low - 108)
                    at += 1
            elif c in (10, 29):
                subrs = self.subrs if c == 10 else self.font.globals
                n = len(subrs)
                k = int(s.pop()) + (107 if n < 1240 else 1131 if n < 33900 else 32768) if s else -1
                if 0 <= k < n and depth < MAX_CALLS:
                    self.run(subrs[k], depth + 1)
            elif c == 11:
                return
            elif c in (19, 20):
                self.width(None)
                self.hints += len(s) // 2
                s.clear()
                at += -(-self.hints // 8)
            elif c == 12:
                e = b[at] if at < len(b) else 255
                at += 1
                self.escape(e)
            else:
                self.operator(c)

    def operator(self, c: int) -> None:
        s = self.stack
        if c in (1, 3, 18, 23):
            self.width(None)
            self.hints += len(s) // 2
        elif c == 14:
            self.width(4 if len(s) >= 4 else 0)
            self.done = True
        elif c == 21:
            self.width(2)
            if len(s) >= 2:
                self.move(s[-2], s[-1])
        elif c in (4, 22):
            self.width(1)
            if s:
                self.move(*((s[-1], 0) if c == 22 else (0, s[-1])))
        elif c in (5, 25):
            n = len(s) - 6 if c == 25 else len(s)
            for i in range(0, n - 1, 2):
                self.line(s[i], s[i + 1])
            if c == 25 and len(s) >= 6:
                self.curve(*s[-6:])
        elif c in (6, 7):
            for i, v in enumerate(s):
                self.line(*((v, 0) if (i % 2 == 0) == (c == 6) else (0, v)))
        elif c in (8, 24):
            for i in range(0, len(s) - 5, 6):
                self.curve(*s[i : i + 6])
            if c == 24 and len(s) >= 2:
                self.line(*s[-2:])
        elif c in (26, 27):
            extra = s.pop(0) if len(s) % 4 else 0.0
            for i in range(0, len(s) - 3, 4):
                a, p, q, z = s[i : i + 4]
                self.curve(*((extra, a, p, q, 0, z) if c == 26 else (a, extra, p, q, z, 0)))
                extra = 0.0
        elif c in (30, 31):
            flat = c == 31
            for i in range(0, len(s) - 3, 4):
                a, p, q, z = s[i : i + 4]
                last = s[i + 4] if len(s) - i == 5 else 0.0
                self.curve(*((a, 0, p, q, last, z) if flat else (0, a, p, q, z, last)))
                flat = not flat
        s.clear()

    def escape(self, e: int) -> None:
        s = self.stack
        if e in (34, 35, 36, 37):
            if e == 35 and len(s) >= 12:
                self.curve(*s[:6])
                self.curve(*s[6:12])
            elif e == 34 and len(s) >= 7:
                a, b, c, d, f, g, h = s[:7]
                self.curve(a, 0, b, c, d, 0)
                self.curve(f, 0, g, -c, h, 0)
            elif e == 36 and len(s) >= 9:
                a, b, c, d, f, g, h, i, j = s[:9]
                self.curve(a, b, c, d, f, 0)
                self.curve(g, 0, h, i, j, -(b + d + i))
            elif e == 37 and len(s) >= 11:
                dx, dy = sum(s[0:10:2]), sum(s[1:10:2])
                last = (s[10], -dy) if abs(dx) > abs(dy) else (-dx, s[10])
                self.curve(*s[:6])
                self.curve(*s[6:10], *last)
            s.clear()
            return
        one = {9: abs, 14: lambda a: -a, 26: lambda a: math.sqrt(max(a, 0.0)), 5: lambda a: float(not a)}
        two = {10: lambda a, b: a + b, 11: lambda a, b: a - b, 12: lambda a, b: a / b if b else 0.0, 24: lambda a, b: a * b, 3: lambda a, b: float(bool(a and b)), 4: lambda a, b: float(bool(a or b)), 15: lambda a, b: float(a == b)}
        try:
            if e in one:
                s.append(one[e](s.pop()))
            elif e in two:
                b, a = s.pop(), s.pop()
                s.append(two[e](a, b))
            elif e == 18:
                s.pop()
            elif e == 20:
                i, v = s.pop(), s.pop()
                self.store[int(i)] = v
            elif e == 21:
                s.append(self.store.get(int(s.pop()), 0.0))
            elif e == 22:
                v2, v1, b, a = s.pop(), s.pop(), s.pop(), s.pop()
                s.append(a if v1 <= v2 else b)
            elif e == 23:
                s.append(0.5)
            elif e == 27:
                s.append(s[-1])
            elif e == 28:
                s[-1], s[-2] = s[-2], s[-1]
            elif e == 29:
                i = max(0, int(s.pop()))
                s.append(s[-1 - i])
            elif e == 30:
                j, n = int(s.pop()), int(s.pop())
                if 0 < n <= len(s):
                    part = s[-n:]
                    j %= n
                    s[-n:] = part[n - j :] + part[: n - j]
        except IndexError:
            s.clear()
