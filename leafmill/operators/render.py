"""Pages to pixels: graphics state, painting, images, shadings, patterns, forms, annotations; tiles of any size."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

from leafmill.operators.colorspaces import Function, Space, _nums
from leafmill.operators.content import parse_content
from leafmill.operators.raster import Path, blend_rgb, coverage, dashed, stroke
from leafmill.operators.text import _matrix, _num, mul
from leafmill.sources.codecs import FilterFault, chain
from leafmill.sources.document import Document
from leafmill.sources.syntax import Name, Ref, Stream

#: Guards: side and area of a page in pixels, pixels of an image, side of a pattern tile, nested forms.
MAX_SIDE, MAX_AREA, MAX_IMAGE, MAX_TILE, MAX_DEPTH = 10_000, 100_000_000, 1 << 26, 2048, 16
UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def png(pixels: np.ndarray) -> bytes:
    """RGBA rows as a PNG file with stored data."""
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 0)) + part(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Pixels of a PNG that `png` wrote."""
    w, h = struct.unpack(">II", data[16:24])
    at, raw = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        raw += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(raw), np.uint8).reshape(h, w * 4 + 1)[:, 1:].reshape(h, w, 4)


class State:
    def __init__(self):
        self.ctm, self.clip = UNIT, None
        self.spaces = {"f": Space(_EMPTY), "s": Space(_EMPTY)}
        self.paint: dict = {"f": np.zeros(3), "s": np.zeros(3)}  # an array of rgb, or a pattern
        self.alpha = {"f": 1.0, "s": 1.0}
        self.width, self.cap, self.join, self.miter, self.dash, self.phase, self.mode = 1.0, 0, 0, 10.0, [], 0.0, "Normal"
        self.font, self.size, self.chars, self.words, self.scale, self.leading, self.rise, self.how = None, 0.0, 0.0, 0.0, 100.0, 0.0, 0.0, 0

    def copy(self):
        new = State.__new__(State)
        new.__dict__.update(self.__dict__)
        new.spaces, new.paint, new.alpha = dict(self.spaces), dict(self.paint), dict(self.alpha)
        return new


_EMPTY = Document({}, {})


def invert(m):
    det = m[0] * m[3] - m[1] * m[2]
    if abs(det) < 1e-12 or not math.isfinite(det):
        return None
    a, b, c, d = m[3] / det, -m[1] / det, -m[2] / det, m[0] / det
    return (a, b, c, d, -(m[4] * a + m[5] * c), -(m[4] * b + m[5] * d))


class Renderer:
    """Draws operations onto a float canvas (height, width, 4) of premultiplied-free RGBA in 0 .. 1."""

    def __init__(self, doc: Document, width: int, height: int, scans: int = 4, white: bool = True, fonts=None):
        self.doc, self.w, self.h, self.scans = doc, width, height, scans
        self.px = np.ones((height, width, 4), np.float32) if white else np.zeros((height, width, 4), np.float32)
        self.fonts = {} if fonts is None else fonts

    # --- pixels

    def composite(self, cover: np.ndarray, color: np.ndarray, alpha: float, gs: State, box=None) -> None:
        """Blend a colour (one, or one for each pixel of the box) under a coverage of 0 .. 1."""
        y0, y1, x0, x1 = box or (0, self.h, 0, self.w)
        a = cover.astype(np.float32) * np.float32(alpha)
        if gs.clip is not None:
            a = a * gs.clip[y0:y1, x0:x1]
        rows = np.flatnonzero(a.any(1))
        if not len(rows):
            return
        t, b = rows[0], rows[-1] + 1
        a, part = a[t:b, :, None], self.px[y0 + t : y0 + b, x0:x1]
        src = np.broadcast_to(np.asarray(color, np.float32), (y1 - y0, x1 - x0, 3))[t:b]
        back, ba = part[..., :3], part[..., 3:]
        if gs.mode != "Normal":
            src = (1 - ba) * src + ba * blend_rgb(back, src, gs.mode)
        out = a + ba * (1 - a)
        with np.errstate(divide="ignore", invalid="ignore"):
            part[..., :3] = np.where(out > 0, (src * a + back * ba * (1 - a)) / np.where(out > 0, out, 1), back)
        part[..., 3:] = out

    def fill(self, polygons, gs: State, even_odd=False, side="f") -> None:
        if not polygons:
            return
        self.paint_mask(coverage(polygons, self.w, self.h, even_odd, self.scans) / np.float32(255), gs, side)

    def paint_mask(self, mask: np.ndarray, gs: State, side: str) -> None:
        paint = gs.paint[side]
        if isinstance(paint, np.ndarray):
            self.composite(mask, paint, gs.alpha[side], gs)
        elif paint is not None:
            color, cover = paint(self, gs)
            if color is not None:
                self.composite(mask * cover, color, gs.alpha[side], gs)

    def outline(self, path: Path, gs: State) -> list:
        m = gs.ctm
        scale = math.sqrt(abs(m[0] * m[3] - m[1] * m[2]))
        width = max(gs.width * scale, 1.0)
        out = []
        for points, closed in path.polylines():
            pieces = [(p, False) for p in dashed(points, closed, [v * scale for v in gs.dash], gs.phase * scale)] if any(v > 0 for v in gs.dash) else [(points, closed)]
            for p, c in pieces:
                out += stroke(p, c, width, gs.cap, gs.join, gs.miter)
        return out

    # --- interpreter

    def run(self, data: bytes, resources: dict, gs: State, depth: int = 0) -> None:
        if depth > MAX_DEPTH:
            return
        doc, saved, path, pending = self.doc, [], Path(), None
        tm = line = UNIT
        at = (0.0, 0.0)

        def dev(x, y):
            m = gs.ctm
            return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]

        def finish(fill=None, line_too=False):
            nonlocal path, pending
            polys = [p for p, _ in path.polylines()]
            if fill is not None:
                self.fill(polys, gs, fill == "eo")
            if line_too:
                self.fill(self.outline(path, gs), gs, False, "s")
            if pending is not None:
                mask = coverage(polys, self.w, self.h, pending == "eo", self.scans) / np.float32(255)
                gs.clip = mask if gs.clip is None else gs.clip * mask
            path, pending = Path(), None

        for name, args in parse_content(data):
            n = [_num(args, i) for i in range(6)]
            try:
                if name == "q":
                    saved.append(gs.copy())
                elif name == "Q":
                    gs = saved.pop() if saved else gs
                elif name == "cm":
                    m = _matrix(args)
                    gs.ctm = mul(m, gs.ctm) if m else gs.ctm
                elif name in ("m", "l"):
                    if n[1] is not None:
                        at = (n[0], n[1])
                        (path.move if name == "m" else path.line)(*dev(*at))
                elif name in ("c", "v", "y"):
                    if name == "c" and n[5] is not None:
                        p = [(n[0], n[1]), (n[2], n[3]), (n[4], n[5])]
                    elif name != "c" and n[3] is not None:
                        p = [at, (n[0], n[1]), (n[2], n[3])] if name == "v" else [(n[0], n[1]), (n[2], n[3]), (n[2], n[3])]
                    else:
                        continue
                    path.curve(*[dev(*q) for q in p])
                    at = p[2]
                elif name == "re":
                    if n[3] is not None:
                        x, y, w, h = n[:4]
                        path.move(*dev(x, y))
                        for q in ((x + w, y), (x + w, y + h), (x, y + h)):
                            path.line(*dev(*q))
                        path.close()
                        at = (x, y)
                elif name == "h":
                    path.close()
                elif name in _PAINT:
                    fill, line_too, close = _PAINT[name]
                    if close:
                        path.close()
                    finish(fill, line_too)
                elif name in ("W", "W*"):
                    pending = "eo" if name == "W*" else "nz"
                elif name in _LINE:
                    if n[0] is not None:
                        setattr(gs, _LINE[name], n[0] if name in "wM" else int(n[0]))
                elif name == "d":
                    gs.dash, gs.phase = [float(v) for v in args[0] if isinstance(v, (int, float))] if args and isinstance(args[0], list) else [], n[1] or 0.0
                elif name == "gs":
                    self.ext_state(doc.value(doc.value(resources, "ExtGState", dict) or {}, args[0], dict) or {}, gs)
                elif name in _DEVICE:
                    side, space = _DEVICE[name]
                    gs.spaces[side] = Space(doc, Name(space))
                    gs.paint[side] = gs.spaces[side].rgb([v or 0.0 for v in n[: gs.spaces[side].n]])
                elif name in ("cs", "CS"):
                    side = "f" if name == "cs" else "s"
                    gs.spaces[side] = Space(doc, args[0], resources)
                    gs.paint[side] = gs.spaces[side].rgb(gs.spaces[side].start()) if gs.spaces[side].kind != "Pattern" else None
                elif name in ("sc", "scn", "SC", "SCN"):
                    side = "f" if name[0] == "s" else "s"
                    nums = [float(v) for v in args if isinstance(v, (int, float))]
                    if args and isinstance(args[-1], Name):
                        gs.paint[side] = self.pattern(doc.value(resources, "Pattern", dict) or {}, args[-1], nums, gs, side, depth)
                    else:
                        gs.paint[side] = gs.spaces[side].rgb(nums)
                elif name == "sh":
                    shading = doc.value(doc.value(resources, "Shading", dict) or {}, args[0])
                    color, cover = self.shade(shading, gs.ctm, False)
                    if color is not None:
                        self.composite(cover, color, gs.alpha["f"], gs)
                elif name == "Do":
                    x = doc.value(doc.value(resources, "XObject", dict) or {}, args[0], Stream)
                    if x is not None and doc.value(x, "Subtype") == "Form":
                        self.form(x, resources, gs, depth)
                    elif x is not None and doc.value(x, "Subtype") == "Image":
                        self.image(x, resources, gs)
                elif name == "BI":
                    self.image(Stream(args[0], args[1]), resources, gs)
                elif name == "BT":
                    tm = line = UNIT
                elif name == "Tf":
                    from leafmill.operators.glyphs import render_font

                    key = doc.value(resources, "Font", dict) or {}
                    gs.font, gs.size = render_font(self, key.get(args[0])), n[1] if n[1] is not None else gs.size
                elif name in _TEXT:
                    if n[0] is not None:
                        setattr(gs, _TEXT[name], int(n[0]) if name == "Tr" else n[0])
                elif name in ("Td", "TD"):
                    if name == "TD":
                        gs.leading = -(n[1] or 0.0)
                    tm = line = mul((1, 0, 0, 1, n[0] or 0.0, n[1] or 0.0), line)
                elif name == "Tm":
                    tm = line = _matrix(args) or tm
                elif name == "T*":
                    tm = line = mul((1, 0, 0, 1, 0, -gs.leading), line)
                elif name in ("Tj", "'", '"', "TJ"):
                    if name == '"':
                        gs.words, gs.chars = n[0] or 0.0, n[1] or 0.0
                    if name in "'\"":
                        tm = line = mul((1, 0, 0, 1, 0, -gs.leading), line)
                    tm = self.show(args[0] if name == "TJ" and isinstance(args[0], list) else args[-1:], gs, tm)
            except (FilterFault, IndexError, TypeError, ValueError, KeyError, ZeroDivisionError, OverflowError):
                continue

    def show(self, items: list, gs: State, tm) -> tuple:
        for item in items:
            if isinstance(item, (int, float)) and not isinstance(item, bool):
                tm = mul((1, 0, 0, 1, -item / 1000 * gs.size * gs.scale / 100, 0), tm)
                continue
            if not isinstance(item, bytes) or gs.font is None:
                continue
            for code in gs.font.metrics.codes(item):
                w = gs.font.metrics.width(code)
                if gs.how not in (3, 7):
                    m = mul((gs.size * gs.scale / 100, 0, 0, gs.size, 0, gs.rise), mul(tm, gs.ctm))
                    path = gs.font.outline(code, m)
                    if path is not None:
                        if gs.how in (0, 2, 4, 6):
                            self.fill([p for p, _ in path.polylines()], gs)
                        if gs.how in (1, 2, 5, 6):
                            self.fill(self.outline(path, gs), gs, False, "s")
                adv = ((w if w is not None else 500.0) / 1000 * gs.size + gs.chars + (gs.words if code == 32 and not gs.font.metrics.two_byte else 0.0)) * gs.scale / 100
                tm = mul((1, 0, 0, 1, adv, 0), tm)
        return tm

    def ext_state(self, d: dict, gs: State) -> None:
        get = self.doc.get
        for key, field in (("LW", "width"), ("LC", "cap"), ("LJ", "join"), ("ML", "miter")):
            v = get(d.get(key))
            if isinstance(v, (int, float)):
                setattr(gs, field, int(v) if field in ("cap", "join") else float(v))
        dash = get(d.get("D"))
        if isinstance(dash, list) and len(dash) == 2:
            gs.dash, gs.phase = _nums(self.doc, dash[0]), float(get(dash[1]) or 0)
        for key, side in (("ca", "f"), ("CA", "s")):
            v = get(d.get(key))
            if isinstance(v, (int, float)):
                gs.alpha[side] = min(1.0, max(0.0, float(v)))
        mode = get(d.get("BM"))
        mode = get(mode[0]) if isinstance(mode, list) and mode else mode
        if isinstance(mode, Name):
            gs.mode = "Normal" if mode == "Compatible" else str(mode)

    def form(self, x: Stream, resources: dict, gs: State, depth: int) -> None:
        """A form in its own state; a transparency group is drawn aside and composited as one."""
        doc, inner = self.doc, gs.copy()
        m = _matrix([doc.get(v) for v in doc.value(x, "Matrix", list) or []])
        inner.ctm = mul(m, gs.ctm) if m else gs.ctm
        self.clip_box(doc.value(x, "BBox"), inner)
        own = doc.value(x, "Resources", dict) or resources
        group = doc.value(x, "Group", dict)
        if not group or doc.value(group, "S") != "Transparency":
            self.run(doc.decoded(x), own, inner, depth + 1)
            return
        aside = Renderer(doc, self.w, self.h, self.scans, False, self.fonts)
        inner.alpha, inner.mode = {"f": 1.0, "s": 1.0}, "Normal"
        aside.run(doc.decoded(x), own, inner, depth + 1)
        self.composite(aside.px[..., 3], aside.px[..., :3], gs.alpha["f"], gs)

    def clip_box(self, box, gs: State) -> None:
        b = _nums(self.doc, box)
        if len(b) != 4:
            return
        path = Path()
        m = gs.ctm
        for x, y in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])):
            (path.line if path.now else path.move)(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5])
        mask = coverage([p for p, _ in path.polylines()], self.w, self.h, False, self.scans) / np.float32(255)
        gs.clip = mask if gs.clip is None else gs.clip * mask

    # --- images

    def pixels(self, s: Stream, resources: dict):
        """(h, w, 3) colours of 0 .. 1 or None for a stencil, and (h, w) alpha."""
        doc, d = self.doc, s.dict
        w, h = int(doc.get(d.get("Width")) or 0), int(doc.get(d.get("Height")) or 0)
        if w <= 0 or h <= 0 or w * h > MAX_IMAGE:
            raise FilterFault("image size")
        names = [f for f, _ in chain(d, doc.get)]
        if "JBIG2Decode" in names or "JPXDecode" in names:
            raise FilterFault("not drawn")
        decode = _nums(doc, d.get("Decode"))
        if doc.get(d.get("ImageMask")) is True:
            raw = doc.decoded(s)
            row = -(-w // 8)
            bits = np.unpackbits(np.frombuffer(raw[: row * h].ljust(row * h, b"\xff"), np.uint8).reshape(h, row), axis=1)[:, :w]
            return None, (bits if decode[:1] == [1.0] else 1 - bits).astype(np.float32)
        space, bits = Space(doc, d.get("ColorSpace", Name("DeviceGray")), resources), int(doc.get(d.get("BitsPerComponent")) or 8)
        if names and names[-1] in ("DCTDecode", "DCT"):
            from leafmill.sources.jpeg import decode_jpeg

            arr = decode_jpeg(doc.decoded(s, ("DCTDecode", "DCT"))).astype(np.float64)
            h, w, n = arr.shape
            if space.n != n:
                space = Space(doc, Name({1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[n]))
            bits = 8
        else:
            arr = samples(doc.decoded(s), w, h, space.n, bits)
        low = list(zip(decode[::2], decode[1::2])) if len(decode) >= 2 * space.n else space.ranges(bits)
        top = 2**bits - 1
        rgb = space.rgb([low[k][0] + arr[..., k] * (low[k][1] - low[k][0]) / top for k in range(space.n)])
        alpha = np.ones((h, w), np.float32)
        mask = doc.value(d, "SMask", Stream)
        if mask is not None:
            gray, _ = self.pixels(mask, resources)
            yy, xx = np.arange(h) * gray.shape[0] // h, np.arange(w) * gray.shape[1] // w
            alpha = gray[yy][:, xx, 0].astype(np.float32)
        return rgb, alpha

    def image(self, s: Stream, resources: dict, gs: State) -> None:
        rgb, alpha = self.pixels(s, resources)
        h, w = alpha.shape
        back = invert(gs.ctm)
        if back is None:
            return
        m = gs.ctm
        xs, ys = [m[4], m[0] + m[4], m[2] + m[4], m[0] + m[2] + m[4]], [m[5], m[1] + m[5], m[3] + m[5], m[1] + m[3] + m[5]]
        x0, x1 = max(0, math.floor(min(xs))), min(self.w, math.ceil(max(xs)))
        y0, y1 = max(0, math.floor(min(ys))), min(self.h, math.ceil(max(ys)))
        if x0 >= x1 or y0 >= y1:
            return
        px, py = np.meshgrid(np.arange(x0, x1) + 0.5, np.arange(y0, y1) + 0.5)
        u, v = back[0] * px + back[2] * py + back[4], back[1] * px + back[3] * py + back[5]
        inside = (u >= 0) & (u < 1) & (v >= 0) & (v < 1)
        fx, fy = u * w, (1 - v) * h
        if self.scans == 1 or rgb is None:
            ix, iy = np.clip(fx.astype(int), 0, w - 1), np.clip(fy.astype(int), 0, h - 1)
            a = alpha[iy, ix] * inside
            color = None if rgb is None else rgb[iy, ix]
        else:
            gx, gy = np.clip(fx - 0.5, 0, w - 1), np.clip(fy - 0.5, 0, h - 1)
            ix, iy = gx.astype(int), gy.astype(int)
            jx, jy = np.minimum(ix + 1, w - 1), np.minimum(iy + 1, h - 1)
            tx, ty = gx - ix, gy - iy
            mix = lambda z, t: z[iy, ix] * (1 - t[0]) * (1 - t[1]) + z[iy, jx] * t[0] * (1 - t[1]) + z[jy, ix] * (1 - t[0]) * t[1] + z[jy, jx] * t[0] * t[1]
            color, a = mix(rgb, (tx[..., None], ty[..., None])), mix(alpha, (tx, ty)) * inside
        if color is None:
            full = np.zeros((self.h, self.w), np.float32)
            full[y0:y1, x0:x1] = a
            self.paint_mask(full, gs, "f")
        else:
            self.composite(a, color, gs.alpha["f"], gs, (y0, y1, x0, x1))

    # --- shadings and patterns

    def shade(self, s, ctm, as_pattern: bool):
        """(colours, cover) of an axial or radial shading over the canvas."""
        doc = self.doc
        d = s.dict if isinstance(s, Stream) else s if isinstance(s, dict) else {}
        kind, back = doc.get(d.get("ShadingType")), invert(ctm)
        if kind not in (2, 3) or back is None:
            return None, None
        space, f = Space(doc, d.get("ColorSpace")), Function(doc, d.get("Function"))
        px, py = np.meshgrid(np.arange(self.w) + 0.5, np.arange(self.h) + 0.5)
        x, y = back[0] * px + back[2] * py + back[4], back[1] * px + back[3] * py + back[5]
        c, (t0, t1) = _nums(doc, d.get("Coords")), (_nums(doc, d.get("Domain")) or [0.0, 1.0])[:2]
        extend = [doc.get(v) is True for v in doc.get(d.get("Extend")) or [False, False]]
        if kind == 2:
            dx, dy = c[2] - c[0], c[3] - c[1]
            size = dx * dx + dy * dy
            t = ((x - c[0]) * dx + (y - c[1]) * dy) / size if size else np.zeros_like(x)
            there = ((t >= 0) | extend[0]) & ((t <= 1) | extend[1])
        else:
            t, there = _radial(c, x, y, extend)
        cover = there.astype(np.float32)
        color = space.rgb(f([t0 + np.clip(t, 0, 1) * (t1 - t0)]))
        background = _nums(doc, d.get("Background"))
        if background and not as_pattern or background and as_pattern:
            color = np.where(there[..., None], color, space.rgb(background))
            cover = np.ones_like(cover)
        box = _nums(doc, d.get("BBox"))
        if len(box) == 4:
            cover = cover * ((x >= min(box[0], box[2])) & (x <= max(box[0], box[2])) & (y >= min(box[1], box[3])) & (y <= max(box[1], box[3])))
        return color, cover

    def pattern(self, patterns: dict, name, nums: list, gs: State, side: str, depth: int):
        """A function that gives (colours, cover) of the canvas for a pattern."""
        doc = self.doc
        p = doc.value(patterns, name)
        d = p.dict if isinstance(p, Stream) else p
        if not isinstance(d, dict):
            return None
        m = _matrix([doc.get(v) for v in doc.value(d, "Matrix", list) or []]) or UNIT
        base = mul(m, self.base)
        if doc.value(d, "PatternType") == 2:
            return lambda r, g: r.shade(doc.get(d.get("Shading")), base, True)
        if not isinstance(p, Stream):
            return None
        under = gs.spaces[side].under
        tint = under.rgb(nums) if doc.value(d, "PaintType") == 2 and under is not None else None
        return lambda r, g: r.tile(p, base, tint, depth)

    def tile(self, p: Stream, base, tint, depth: int):
        """One cell of a tiling pattern is drawn on white and repeated; gaps between cells stay open."""
        doc, d = self.doc, p.dict
        box, sx, sy = _nums(doc, d.get("BBox")), abs(float(doc.get(d.get("XStep")) or 0)), abs(float(doc.get(d.get("YStep")) or 0))
        back = invert(base)
        if len(box) != 4 or not sx or not sy or back is None:
            return None, None
        kx, ky = math.hypot(base[0], base[1]), math.hypot(base[2], base[3])
        bw, bh = box[2] - box[0], box[3] - box[1]
        w, h = math.ceil(bw * kx), math.ceil(bh * ky)
        if not (0 < w <= MAX_TILE and 0 < h <= MAX_TILE):
            return None, None
        cell = Renderer(doc, w, h, self.scans, True, self.fonts)
        cell.base = (w / bw, 0.0, 0.0, h / bh, -box[0] * w / bw, -box[1] * h / bh)
        gs = State()
        gs.ctm = cell.base
        if tint is not None:
            gs.paint = {"f": tint, "s": tint}
        cell.run(doc.decoded(p), doc.value(p, "Resources", dict) or {}, gs, depth + 1)
        px, py = np.meshgrid(np.arange(self.w) + 0.5, np.arange(self.h) + 0.5)
        x = np.mod(back[0] * px + back[2] * py + back[4] - box[0], sx)
        y = np.mod(back[1] * px + back[3] * py + back[5] - box[1], sy)
        there = (x < bw) & (y < bh)
        ix, iy = np.clip((x * w / bw).astype(int), 0, w - 1), np.clip((y * h / bh).astype(int), 0, h - 1)
        return cell.px[iy, ix, :3], (there * cell.px[iy, ix, 3]).astype(np.float32)

    base = UNIT

    # --- annotations

    def annotation(self, ref) -> None:
        """Normal appearance of an annotation, its box mapped onto the rectangle."""
        doc = self.doc
        a = doc.get(ref)
        if not isinstance(a, dict) or doc.value(a, "Subtype") == "Popup" or (doc.value(a, "F", int) or 0) & 34:
            return
        look = doc.value(doc.value(a, "AP", dict) or {}, "N")
        if isinstance(look, dict):
            state = doc.value(a, "AS", Name)
            look = doc.value(look, state) if state in look else next((v for v in map(doc.get, look.values()) if isinstance(v, Stream)), None)
        rect, box = doc.rect(a.get("Rect")), _nums(doc, doc.value(look, "BBox")) if isinstance(look, Stream) else []
        if rect is None or len(box) != 4:
            return
        m = _matrix([doc.get(v) for v in doc.value(look, "Matrix", list) or []]) or UNIT
        pts = [(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]) for x in (box[0], box[2]) for y in (box[1], box[3])]
        x0, x1, y0, y1 = min(p[0] for p in pts), max(p[0] for p in pts), min(p[1] for p in pts), max(p[1] for p in pts)
        sx, sy = ((rect[2] - rect[0]) / (x1 - x0) if x1 > x0 else 1.0), ((rect[3] - rect[1]) / (y1 - y0) if y1 > y0 else 1.0)
        gs = State()
        gs.ctm = mul((sx, 0, 0, sy, rect[0] - x0 * sx, rect[1] - y0 * sy), self.base)
        self.form(look, {}, gs, 0)


_PAINT = {"S": (None, True, False), "s": (None, True, True), "f": ("nz", False, False), "F": ("nz", False, False), "f*": ("eo", False, False), "B": ("nz", True, False), "B*": ("eo", True, False), "b": ("nz", True, True), "b*": ("eo", True, True), "n": (None, False, False)}
_LINE = {"w": "width", "J": "cap", "j": "join", "M": "miter"}
_TEXT = {"Tc": "chars", "Tw": "words", "Tz": "scale", "TL": "leading", "Ts": "rise", "Tr": "how"}
_DEVICE = {"g": ("f", "DeviceGray"), "G": ("s", "DeviceGray"), "rg": ("f", "DeviceRGB"), "RG": ("s", "DeviceRGB"), "k": ("f", "DeviceCMYK"), "K": ("s", "DeviceCMYK")}


def samples(raw: bytes, w: int, h: int, n: int, bits: int) -> np.ndarray:
    """(h, w, n) samples of 1, 2, 4, 8 or 16 bits; missing bytes are 0."""
    row = -(-w * n * bits // 8)
    b = np.frombuffer(raw[: row * h].ljust(row * h, b"\0"), np.uint8).reshape(h, row)
    if bits == 8:
        out = b
    elif bits == 16:
        out = b.reshape(h, -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    elif bits in (1, 2, 4):
        out = np.unpackbits(b, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits - 1, -1, -1))
    else:
        raise FilterFault(f"{bits} bits a component")
    return out[:, : w * n].reshape(h, w, n)


def _radial(c: list, x, y, extend):
    """Largest parameter whose circle passes through each point and has a radius of 0 or more."""
    x0, y0, r0, x1, y1, r1 = c[:6]
    dx, dy, dr = x1 - x0, y1 - y0, r1 - r0
    a = dx * dx + dy * dy - dr * dr
    b = (x - x0) * dx + (y - y0) * dy + r0 * dr
    q = (x - x0) ** 2 + (y - y0) ** 2 - r0 * r0
    with np.errstate(divide="ignore", invalid="ignore"):
        if abs(a) < 1e-12:
            roots = [q / (2 * b)]
        else:
            root = np.sqrt(b * b - a * q)
            roots = sorted([(b + root) / a, (b - root) / a], key=lambda v: -np.nanmax(np.where(np.isfinite(v), v, -np.inf), initial=-np.inf))
            roots = [np.fmax(roots[0], roots[1]), np.fmin(roots[0], roots[1])]
        t, there = np.zeros_like(x), np.zeros(x.shape, bool)
        for s in roots:
            ok = np.isfinite(s) & (r0 + s * dr >= 0) & ((s >= 0) | extend[0]) & ((s <= 1) | extend[1]) & ~there
            t, there = np.where(ok, s, t), there | ok
    return t, there


def render_page(doc: Document, page: Ref, scale: float = 1.0, region: tuple | None = None, fast: bool = False, annotations: bool = True) -> np.ndarray:
    """RGBA pixels of a page, or of a region (x, y, width, height) in pixels of the whole page.

    A region is drawn as the page is, shifted. Content that can't be read leaves a white page.
    """
    scale = scale if math.isfinite(scale) and scale > 0 else 1.0
    x0, y0, x1, y1 = doc.media_box(page)
    x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    turn = doc.rotation(page)
    pw, ph = doc.size(page)
    if region is None:
        scale = min(scale, MAX_SIDE / max(pw, ph), math.sqrt(MAX_AREA / (pw * ph)))
    full_w, full_h = max(1, math.ceil(pw * scale - 1e-9)), max(1, math.ceil(ph * scale - 1e-9))
    s = scale
    m = {0: (s, 0, 0, -s, -x0 * s, y1 * s), 90: (0, s, s, 0, -y0 * s, -x0 * s), 180: (-s, 0, 0, s, x1 * s, -y0 * s), 270: (0, -s, -s, 0, y1 * s, x1 * s)}[turn]
    w, h = full_w, full_h
    if region is not None:
        rx, ry, w, h = region
        if not all(map(math.isfinite, region)) or w <= 0 or h <= 0 or w > MAX_SIDE or h > MAX_SIDE:
            raise ValueError("region")
        m = mul(m, (1, 0, 0, 1, -rx, -ry))
        w, h = int(w), int(h)
    r = Renderer(doc, w, h, 1 if fast else 4)
    r.base = m
    gs = State()
    gs.ctm = m
    try:
        r.run(doc.content(page), doc.resources(page), gs)
    except (FilterFault, ValueError):
        pass
    if annotations:
        for a in doc.value(page, "Annots", list) or []:
            try:
                r.annotation(a)
            except (FilterFault, ValueError, TypeError, KeyError, IndexError):
                continue
    return np.clip(r.px * 255 + 0.5, 0, 255).astype(np.uint8)
