"""Page text, positioned spans and literal search with highlight boxes."""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa

from leafmill.operators.content import parse_content
from leafmill.operators.fonts import Font, FontBook
from leafmill.sources.codecs import FilterFault
from leafmill.sources.document import Document
from leafmill.sources.syntax import Ref, Stream

#: Depth of nested forms; line and gap rules of search, in font sizes.
FORM_DEPTH, LINE_SLACK, GAP = 8, 0.5, 0.3


def _num(args: list, i: int, default=None):
    v = args[i] if i < len(args) else None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else default


def _form(doc: Document, resources: dict, args: list):
    """(bytes, resources, dictionary) of a form that Do paints."""
    s = doc.value(doc.value(resources, "XObject", dict) or {}, args[0]) if args and isinstance(args[0], str) else None
    if not isinstance(s, Stream) or s.dict.get("Subtype") != "Form":
        return None
    try:
        return doc.decoded(s), doc.value(s, "Resources", dict) or resources, s.dict
    except FilterFault:
        return None


class _Plain:
    """Text in reading order of the stream, with line ends and spaces where positions ask for them."""

    def __init__(self, doc: Document):
        self.doc, self.out, self.last = doc, [], ""

    def put(self, text: str) -> None:
        if text:
            self.out.append(text)
            self.last = text[-1]

    def newline(self) -> None:
        if self.last and self.last != "\n":
            self.put("\n")

    def space(self) -> None:
        if self.last and not self.last.isspace():
            self.put(" ")

    def run(self, data: bytes, resources: dict, depth: int = 0) -> None:
        if depth > FORM_DEPTH:
            return
        fonts, font, size = FontBook(self.doc, resources), Font(), 12.0
        base, waiting = None, False
        moves: list = []  # since the last position: strings with their font and size, and plain distances

        def show(raw: bytes):
            self.put(font.string(raw))
            moves.append((font, raw, size))

        def used() -> float | None:
            """How far the text has moved on; None behind a width that isn't known."""
            total = 0.0
            for m in moves:
                if isinstance(m, tuple):
                    units = m[0].advance(m[1])
                    if units is None:
                        return None
                    total += units / 1000 * m[2]
                else:
                    total -= m
            return total

        for name, args in parse_content(data):
            if name in ("Tj", "'", '"', "TJ"):
                if name in "'\"":
                    waiting = True
                    moves.clear()
                if waiting:
                    self.newline()
                    waiting = False
                if name != "TJ":
                    raw = next((a for a in reversed(args) if isinstance(a, bytes)), None)
                    if raw is not None:
                        show(raw)
                    continue
                for item in args[0] if args and isinstance(args[0], list) else []:
                    if isinstance(item, bytes):
                        show(item)
                    elif isinstance(item, (int, float)) and not isinstance(item, bool):
                        if item < -180:
                            self.space()
                        moves.append(item / 1000 * size)
            elif name in ("Td", "TD"):
                tx, ty = _num(args, 0, 0.0), _num(args, 1, 0.0)
                if ty:
                    waiting = True
                elif (tx > 0) if (far := used()) is None else (tx - far > max(0.2 * size, 0.5)):
                    self.space()
                moves.clear()
            elif name == "T*":
                waiting = True
                moves.clear()
            elif name == "Tm":
                f = _num(args, 5)
                if f is not None:
                    waiting = waiting or base is not None and abs(f - base) > 0.5
                    base = f
                moves.clear()
            elif name == "Tf":
                if args and isinstance(args[0], str):
                    font = fonts[args[0]]
                s = _num(args, 1)
                size = s if s and s > 0 else size
            elif name == "BT":
                base = None
                moves.clear()
            elif name == "ET":
                waiting = False
                self.newline()
            elif name == "Do" and (form := _form(self.doc, resources, args)):
                self.run(form[0], form[1], depth + 1)


def page_text(doc: Document, page: Ref) -> str:
    p = _Plain(doc)
    p.run(doc.content(page), doc.resources(page))
    return "".join(p.out).rstrip("\n")


Box = tuple[float, float, float, float]


class Glyphs:
    """Glyphs of a span as columns: their texts, and the left and right edges of upright boxes of one height."""

    __slots__ = ("texts", "left", "right", "low", "high")

    def __init__(self, texts: str | list[str], a: np.ndarray, z: np.ndarray, low: float, high: float):
        keep = np.isfinite(a) & np.isfinite(z)
        if not keep.all():
            texts = [t for t, k in zip(texts, keep.tolist()) if k]
            a, z = a[keep], z[keep]
        self.texts, self.left, self.right, self.low, self.high = texts, np.where(a <= z, a, z), np.where(a <= z, z, a), low, high

    def __len__(self):
        return len(self.left)

    def rows(self) -> list[tuple[str, Box]]:
        return [(t, (a, self.low, z, self.high)) for t, a, z in zip(self.texts, self.left.tolist(), self.right.tolist())]

    @staticmethod
    def arrow(column: list, kind: pa.DataType) -> pa.Array:
        """A list column of the glyphs of many spans; entries can be plain rows or None."""
        parts = [g if isinstance(g, Glyphs) else _Rows(g or []) for g in column]
        sizes = [len(p) for p in parts]
        if all(isinstance(p.texts, str) for p in parts):  # one character a glyph
            raw = np.frombuffer("".join([p.texts for p in parts]).encode("utf-8", "surrogatepass"), np.uint8)
            begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)).astype(np.int32)
            texts = pa.StringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(raw))
        else:
            texts = pa.array([t for p in parts for t in p.texts], pa.string())
        joined = lambda arrays: pa.array(np.concatenate([np.zeros(0), *arrays]))
        tall = lambda edge: joined([np.broadcast_to(np.asarray(getattr(p, edge), np.float64), n) for p, n in zip(parts, sizes)])
        inner = kind.value_type
        box = pa.StructArray.from_arrays([tall("left"), tall("low"), tall("right"), tall("high")], fields=list(inner.field("bbox").type))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([texts, box], fields=list(inner)), type=kind, mask=pa.array([g is None for g in column]))


class _Rows:
    """Plain glyph rows, as columns."""

    def __init__(self, rows: list[tuple[str, Box]]):
        self.texts = [t for t, _ in rows] if rows else ""
        self.left, self.low, self.right, self.high = np.array([b for _, b in rows], np.float64).reshape(-1, 4).T

    def __len__(self):
        return len(self.left)


class Span:
    """Text in one piece, its box, its size. Glyphs are held as columns where their boxes are upright."""

    __slots__ = ("text", "box", "size", "held")

    def __init__(self, text: str, box: Box, size: float, held: Glyphs | list[tuple[str, Box]]):
        self.text, self.box, self.size, self.held = text, box, size, held

    @property
    def glyphs(self) -> list[tuple[str, Box]]:
        return self.held.rows() if isinstance(self.held, Glyphs) else self.held


def mul(m, n):
    """The matrix that applies m, then n."""
    a, b, c, d, e, f = m
    A, B, C, D, E, F = n
    return (a * A + b * C, a * B + b * D, c * A + d * C, c * B + d * D, e * A + f * C + E, e * B + f * D + F)


def _box(m, x0, y0, x1, y1) -> Box | None:
    xs = [m[0] * x + m[2] * y + m[4] for x in (x0, x1) for y in (y0, y1)]
    ys = [m[1] * x + m[3] * y + m[5] for x in (x0, x1) for y in (y0, y1)]
    out = (min(xs), min(ys), max(xs), max(ys))
    return out if all(map(math.isfinite, out)) else None


def _matrix(args: list):
    v = [_num(args, i) for i in range(6)]
    return tuple(v) if all(x is not None and math.isfinite(x) for x in v) else None


_UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class _State:
    __slots__ = ("ctm", "font", "size", "chars", "words", "scale", "leading", "rise")

    def __init__(self):
        self.ctm, self.font, self.size, self.chars, self.words = _UNIT, Font(), 0.0, 0.0, 0.0
        self.scale, self.leading, self.rise = 100.0, 0.0, 0.0

    def copy(self):
        new = _State.__new__(_State)
        for k in self.__slots__:
            setattr(new, k, getattr(self, k))
        return new


_SETTERS = {"Tc": "chars", "Tw": "words", "Tz": "scale", "TL": "leading", "Ts": "rise"}


def _spans(doc: Document, data: bytes, resources: dict, gs: _State, out: list[Span], depth: int = 0) -> None:
    if depth > FORM_DEPTH:
        return
    fonts, saved, tm, line = FontBook(doc, resources), [], _UNIT, _UNIT

    def emit(items: list):
        nonlocal tm
        tx, text, parts, places = 0.0, [], [], []
        plain = not gs.font.two_byte and gs.font.unicode is None
        for item in items:
            if isinstance(item, bytes) and plain:
                far = np.empty(len(item) + 1)
                far[0] = tx
                far[1:] = gs.font.steps(gs.size, gs.chars, gs.words, gs.scale)[np.frombuffer(item, np.uint8)]
                np.add.accumulate(far, out=far)
                tx = float(far[-1])
                text.append(gs.font.string(item))
                places.append(far)
            elif isinstance(item, bytes):
                for code in gs.font.codes(item):
                    w = gs.font.width(code)
                    adv = (w if w is not None else 500.0) / 1000 * gs.size + gs.chars + (gs.words if code == 32 and not gs.font.two_byte else 0.0)
                    t, x0 = gs.font.text(code), tx
                    tx += adv * gs.scale / 100
                    text.append(t)
                    parts.append((t, min(x0, tx), max(x0, tx)))
            elif isinstance(item, (int, float)) and not isinstance(item, bool):
                tx -= item / 1000 * gs.size * gs.scale / 100
        whole = "".join(text)
        if whole:
            m = mul(tm, gs.ctm)
            y0, y1 = gs.font.descent * gs.size + gs.rise, gs.font.ascent * gs.size + gs.rise
            box = _box(m, min(0.0, tx), y0, max(0.0, tx), y1)
            if box:
                v = math.hypot(m[2], m[3])
                if plain:
                    a, z = np.concatenate([p[:-1] for p in places]), np.concatenate([p[1:] for p in places])
                    a, z = np.minimum(a, z), np.maximum(a, z)
                    if not m[1] == 0 == m[2]:
                        parts = list(zip(whole, a.tolist(), z.tolist()))
                if m[1] == 0 == m[2]:  # upright text: one height for all, and each edge by itself
                    low, high, k, e = box[1], box[3], m[0], m[4]
                if m[1] == 0 == m[2] and plain:
                    glyphs = Glyphs(whole, k * a + e, k * z + e, low, high)
                elif m[1] == 0 == m[2]:
                    edges = [(t, k * a + e, k * z + e) for t, a, z in parts]
                    glyphs = [(t, (a, low, z, high) if a <= z else (z, low, a, high)) for t, a, z in edges if math.isfinite(a) and math.isfinite(z)]
                else:
                    glyphs = [(t, b) for t, a, z in parts if (b := _box(m, a, y0, z, y1))]
                out.append(Span(whole, box, gs.size * v if math.isfinite(v) and v > 0 else gs.size, glyphs))
        tm = mul((1, 0, 0, 1, tx, 0), tm)

    def move(x, y):
        nonlocal tm, line
        tm = line = mul((1, 0, 0, 1, x, y), line)

    for name, args in parse_content(data):
        if name == "q":
            saved.append(gs.copy())
        elif name == "Q":
            if saved:
                gs = saved.pop()
        elif name == "cm":
            m = _matrix(args)
            gs.ctm = mul(m, gs.ctm) if m else gs.ctm
        elif name == "BT":
            tm = line = _UNIT
        elif name == "Tf":
            if args and isinstance(args[0], str):
                gs.font = fonts[args[0]]
            gs.size = _num(args, 1, gs.size)
        elif name in _SETTERS:
            setattr(gs, _SETTERS[name], _num(args, 0, getattr(gs, _SETTERS[name])))
        elif name in ("Td", "TD"):
            x, y = _num(args, 0, 0.0), _num(args, 1, 0.0)
            if name == "TD":
                gs.leading = -y
            move(x, y)
        elif name == "Tm":
            m = _matrix(args)
            tm = line = m if m else tm
        elif name == "T*":
            move(0.0, -gs.leading)
        elif name == "Tj":
            emit([a for a in args if isinstance(a, bytes)][-1:])
        elif name in ("'", '"'):
            if name == '"':
                gs.words, gs.chars = _num(args, 0, gs.words), _num(args, 1, gs.chars)
            move(0.0, -gs.leading)
            emit([a for a in args if isinstance(a, bytes)][-1:])
        elif name == "TJ":
            emit(args[0] if args and isinstance(args[0], list) else [])
        elif name == "Do" and (form := _form(doc, resources, args)):
            inner = gs.copy()
            m = _matrix([doc.get(x) for x in doc.value(form[2], "Matrix", list) or []])
            inner.ctm = mul(m, gs.ctm) if m else gs.ctm
            _spans(doc, form[0], form[1], inner, out, depth + 1)


def page_spans(doc: Document, page: Ref) -> list[Span]:
    out: list[Span] = []
    with np.errstate(all="ignore"):
        _spans(doc, doc.content(page), doc.resources(page), _State(), out)
    return out


def fold_char(c: str, ignore_case: bool) -> str:
    return " " if c.isspace() else c.lower()[:1] if ignore_case else c


def fold_text(text: str, ignore_case: bool) -> str:
    """fold_char of every character."""
    if text.isprintable():  # no white space but blanks
        if not ignore_case:
            return text
        low = text.lower()
        if len(low) == len(text) and "Σ" not in text:  # no character became two, none depends on its place
            return low
    return "".join([fold_char(c, ignore_case) for c in text])


def search_spans(spans: list[Span], query: str, ignore_case: bool = False) -> list[list[Box]]:
    """Boxes, one for each line touched, of every non-overlapping occurrence, left to right.

    Spans on one line are joined, with a space where the gap is wide; a new line counts as a space. A match of
    such spaces alone is no hit, though the search goes on behind it.
    """
    needle = "".join(fold_char(c, ignore_case) for c in query)
    if not needle:
        return []
    # what joining adds is spaces only: without the needle's other characters in a row there is no hit to lay out
    inner = "".join(needle.split())
    texts = [s.held.texts if isinstance(s.held, Glyphs) else [t for t, _ in s.held] for s in spans]
    texts = [t if isinstance(t, str) else "".join(t) for t in texts]
    if inner and inner not in "".join(fold_text("".join(texts), ignore_case).split()):
        return []
    text: list[str] = []
    begins: list[int] = []  # where in the text each piece begins, and its line
    pieces: list[tuple[Span | None, int]] = []
    line, before, size_now = 0, None, 0

    def add(t: str, s: Span | None):
        nonlocal size_now
        text.append(t)
        begins.append(size_now)
        pieces.append((s, line))
        size_now += len(t)

    for s, own in zip(spans, texts):
        if before is not None:
            size = max(before.size, s.size)
            if not (math.isfinite(size) and size > 0):
                size = max(before.box[3] - before.box[1], s.box[3] - s.box[1], 1e-6)
            if abs(before.box[1] + before.box[3] - s.box[1] - s.box[3]) / 2 <= LINE_SLACK * size:
                wide = s.box[0] - before.box[2] > GAP * size
            else:
                line, wide = line + 1, True
            if wide:
                add(" ", None)
        if own:
            add(fold_text(own, ignore_case), s)
        before = s

    def boxes_of(s: Span, begin: int, end: int) -> list[Box]:
        """Of each of these characters the box of its glyph."""
        g = s.held
        if isinstance(g, Glyphs) and isinstance(g.texts, str):
            return [(a, g.low, z, g.high) for a, z in zip(g.left[begin:end].tolist(), g.right[begin:end].tolist())]
        return [box for t, box in s.glyphs for _ in t][begin:end]

    hay, out, at = "".join(text), [], 0
    while (at := hay.find(needle, at)) >= 0:
        boxes: dict[int, Box] = {}
        end, i = at + len(needle), bisect_right(begins, at) - 1
        while i < len(begins) and begins[i] < end:
            s, k = pieces[i]
            for box in boxes_of(s, max(0, at - begins[i]), end - begins[i]) if s else []:
                b = boxes.get(k, box)
                boxes[k] = (min(b[0], box[0]), min(b[1], box[1]), max(b[2], box[2]), max(b[3], box[3]))
            i += 1
        if boxes:
            out.append(list(boxes.values()))
        at += len(needle)
    return out
