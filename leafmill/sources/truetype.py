"""TrueType files: tables, character maps, outlines, advances, and subsets that keep glyph numbers."""

from __future__ import annotations

import struct

from leafmill.operators.text import mul


class FontFault(ValueError):
    """Bytes that aren't a usable font."""


def _u16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2], "big") if 0 <= at <= len(b) - 2 else 0


def _i16(b: bytes, at: int) -> int:
    v = _u16(b, at)
    return v - 65536 if v & 32768 else v


def _u32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "big") if 0 <= at <= len(b) - 4 else 0


def num_fonts(data: bytes) -> int:
    return _u32(data, 8) if data[:4] == b"ttcf" else 1


def directory(data: bytes, index: int = 0) -> dict[str, bytes]:
    """Tables of a font file or of one member of a collection; those that lie outside the file are left out."""
    at = 0
    if data[:4] == b"ttcf":
        if index >= num_fonts(data):
            raise FontFault("no such member")
        at = _u32(data, 12 + 4 * index)
    if data[at : at + 4] not in (b"\0\1\0\0", b"true", b"OTTO"):
        raise FontFault("not a font file")
    out = {}
    for i in range(_u16(data, at + 4)):
        e = at + 12 + 16 * i
        start, size = _u32(data, e + 8), _u32(data, e + 12)
        if start + size <= len(data):
            out[data[e : e + 4].decode("latin-1")] = data[start : start + size]
    return out


class TrueType:
    def __init__(self, data: bytes, index: int = 0):
        self.tables = t = directory(data, index)
        head, maxp, hhea = t.get("head", b""), t.get("maxp", b""), t.get("hhea", b"")
        if len(head) < 54 or len(maxp) < 6:
            raise FontFault("head or maxp is missing")
        self.units = _u16(head, 18) or 1000
        self.count, self.long = _u16(maxp, 4), _i16(head, 50) != 0
        self.ascent, self.descent = _i16(hhea, 4), _i16(hhea, 6)
        self.n_metrics = _u16(hhea, 34)
        self.maps = self._maps()
        self.cmap = self._chosen()

    def advance(self, gid: int) -> int:
        hmtx = self.tables.get("hmtx", b"")
        return _u16(hmtx, 4 * min(gid, max(0, self.n_metrics - 1)))

    def _maps(self) -> dict[tuple[int, int], dict[int, int]]:
        b, out = self.tables.get("cmap", b""), {}
        for i in range(_u16(b, 2)):
            e = 4 + 8 * i
            at = _u32(b, e + 4)
            got = _read_map(b, at)
            if got is not None:
                out[_u16(b, e), _u16(b, e + 2), _u16(b, at)] = got
        return out

    def _chosen(self) -> dict[int, int]:
        """Full Unicode maps first, then those of the basic plane, then any."""
        order = sorted(self.maps, key=lambda k: (k[2] != 12, k[2] != 4, k[:2] != (3, 10), k[0] != 0 if k[2] == 12 else k[:2] != (3, 1), k[0] != 0, k))
        return self.maps[order[0]] if order else {}

    def glyph(self, gid: int) -> bytes:
        loca, glyf = self.tables.get("loca", b""), self.tables.get("glyf", b"")
        if not 0 <= gid < self.count:
            return b""
        a, b = (_u32(loca, 4 * gid), _u32(loca, 4 * gid + 4)) if self.long else (2 * _u16(loca, 2 * gid), 2 * _u16(loca, 2 * gid + 2))
        return glyf[a:b] if a < b <= len(glyf) else b""

    def contours(self, gid: int, depth: int = 0) -> list[list[tuple[float, float, bool]]]:
        """Contours of (x, y, on the curve); parts of a composite are placed, to a depth of five."""
        b = self.glyph(gid)
        if len(b) < 10:
            return []
        n = _i16(b, 0)
        if n >= 0:
            return _simple(b, n)
        if depth > 5:
            return []
        out = []
        for flags, part, m in _parts(b):
            out += [[(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5], on) for x, y, on in c] for c in self.contours(part, depth + 1)]
        return out

    def draw(self, gid: int, path, m) -> None:
        """Add a glyph's outline, scaled to one em and then by m, to a path."""
        k = 1 / self.units
        m = mul((k, 0, 0, k, 0, 0), m)
        for c in self.contours(gid):
            pts = [(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5], on) for x, y, on in c]
            if not pts:
                continue
            start = next((i for i, p in enumerate(pts) if p[2]), None)
            if start is None:
                mid = ((pts[0][0] + pts[-1][0]) / 2, (pts[0][1] + pts[-1][1]) / 2, True)
                pts, start = [mid, *pts], 0
            pts = pts[start:] + pts[:start] + [pts[start]]
            path.move(*pts[0][:2])
            here, off = pts[0], None
            for p in pts[1:]:
                if p[2]:
                    _quad(path, here, off, p) if off else path.line(*p[:2])
                    here, off = p, None
                else:
                    if off:
                        mid = ((off[0] + p[0]) / 2, (off[1] + p[1]) / 2, True)
                        _quad(path, here, off, mid)
                        here = mid
                    off = p
            path.close()


def _quad(path, a, c, b) -> None:
    path.curve((a[0] + (c[0] - a[0]) * 2 / 3, a[1] + (c[1] - a[1]) * 2 / 3), (b[0] + (c[0] - b[0]) * 2 / 3, b[1] + (c[1] - b[1]) * 2 / 3), b[:2])


def _read_map(b: bytes, at: int) -> dict[int, int] | None:
    kind, out = _u16(b, at), {}
    if kind == 0:
        return {c: g for c, g in enumerate(b[at + 6 : at + 262]) if g}
    if kind == 6:
        return {_u16(b, at + 6) + i: _u16(b, at + 10 + 2 * i) for i in range(_u16(b, at + 8))}
    if kind == 12:
        for i in range(min(_u32(b, at + 12), len(b) // 12)):
            lo, hi, g = (_u32(b, at + 16 + 12 * i + 4 * k) for k in range(3))
            out.update({c: g + c - lo for c in range(lo, min(hi, lo + 65535) + 1)})
        return out
    if kind != 4:
        return None
    n = _u16(b, at + 6) // 2
    for i in range(n):
        hi, lo = _u16(b, at + 14 + 2 * i), _u16(b, at + 16 + 2 * n + 2 * i)
        add, where = _u16(b, at + 16 + 4 * n + 2 * i), at + 16 + 6 * n + 2 * i
        step = _u16(b, where)
        for c in range(lo, hi + 1) if lo <= hi else ():
            g = (c + add) & 65535 if not step else _u16(b, where + step + 2 * (c - lo))
            g = (g + add) & 65535 if step and g else g
            if g and c != 65535:
                out[c] = g
    return out


def _simple(b: bytes, n: int) -> list:
    ends = [_u16(b, 10 + 2 * i) for i in range(n)]
    total = ends[-1] + 1 if ends else 0
    at, flags = 12 + 2 * n + _u16(b, 10 + 2 * n), []
    while len(flags) < total and at < len(b):
        f = b[at]
        at += 1
        flags.append(f)
        if f & 8 and at < len(b):
            flags += [f] * b[at]
            at += 1
    flags = flags[:total]
    axes = []
    for short, same in ((2, 16), (4, 32)):
        v, out = 0, []
        for f in flags:
            if f & short:
                v += (b[at] if at < len(b) else 0) * (1 if f & same else -1)
                at += 1
            elif not f & same:
                v += _i16(b, at)
                at += 2
            out.append(v)
        axes.append(out)
    pts = [(x, y, bool(f & 1)) for x, y, f in zip(*axes, flags)]
    return [pts[a:e + 1] for a, e in zip([0, *[e + 1 for e in ends]], ends)]


def _parts(b: bytes):
    """(flags, glyph, matrix) of the parts of a composite."""
    at, more = 10, True
    while more and at + 4 <= len(b):
        flags, part = _u16(b, at), _u16(b, at + 2)
        at += 4
        if flags & 1:
            x, y = _i16(b, at), _i16(b, at + 2)
            at += 4
        else:
            x, y = struct.unpack("bb", b[at : at + 2]) if at + 2 <= len(b) else (0, 0)
            at += 2
        a, s, t, d = 1.0, 0.0, 0.0, 1.0
        f = lambda k: _i16(b, at + 2 * k) / 16384
        if flags & 8:
            a = d = f(0)
            at += 2
        elif flags & 64:
            a, d = f(0), f(1)
            at += 4
        elif flags & 128:
            a, s, t, d = f(0), f(1), f(2), f(3)
            at += 8
        yield flags, part, (a, s, t, d, float(x) if flags & 2 else 0.0, float(y) if flags & 2 else 0.0)
        more = bool(flags & 32)


def checksum(b: bytes) -> int:
    b = b + b"\0" * (-len(b) % 4)
    return sum(struct.unpack(f">{len(b) // 4}I", b)) & 0xFFFFFFFF


def closure(font: TrueType, gids: set[int]) -> set[int]:
    """Glyphs with the parts that their composites need, and glyph 0."""
    out, todo = set(), [0, *gids]
    while todo:
        g = todo.pop()
        if g in out:
            continue
        out.add(g)
        b = font.glyph(g)
        if len(b) >= 10 and _i16(b, 0) < 0:
            todo += [p for _, p, _ in _parts(b)]
    return out


def subset(font: TrueType, gids: set[int]) -> bytes:
    """A font file with the outlines of these glyphs alone; glyph numbers stay."""
    keep, parts, place = closure(font, gids), [], [0]
    for g in range(font.count):
        b = font.glyph(g) if g in keep else b""
        parts.append(b + b"\0" * (-len(b) % 4))
        place.append(place[-1] + len(parts[-1]))
    tables = {k: font.tables[k] for k in ("cvt ", "fpgm", "head", "hhea", "hmtx", "maxp", "prep") if k in font.tables}
    tables["glyf"], tables["loca"] = b"".join(parts), struct.pack(f">{len(place)}I", *place)
    head = bytearray(tables["head"])
    head[8:12], head[50:52] = b"\0\0\0\0", b"\0\1"
    tables["head"] = bytes(head)
    n = len(tables)
    power = 1 << (n.bit_length() - 1)
    out = struct.pack(">IHHHH", 0x10000, n, power * 16, power.bit_length() - 1, n * 16 - power * 16)
    at, body, head_at = 12 + 16 * n, b"", 0
    for tag in sorted(tables):
        b = tables[tag]
        head_at = at + len(body) if tag == "head" else head_at
        out += struct.pack(">4sIII", tag.encode(), checksum(b), at + len(body), len(b))
        body += b + b"\0" * (-len(b) % 4)
    whole = bytearray(out + body)
    whole[head_at + 8 : head_at + 12] = struct.pack(">I", (0xB1B0AFBA - checksum(bytes(whole))) & 0xFFFFFFFF)
    return bytes(whole)
