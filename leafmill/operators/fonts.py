"""Font dictionaries as text extraction needs them: codes, their text, their widths, the line box."""

from __future__ import annotations

import functools

import numpy as np

from leafmill.functions.text import width_table
from leafmill.sources.codecs import FilterFault
from leafmill.sources.document import Document, winansi
from leafmill.sources.syntax import Keyword, Name, Stream, SyntaxFault, tokens

_STANDARD = ("Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique", "Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique", "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic")


def cmap(data: bytes) -> dict[int, str]:
    """code -> text of a ToUnicode CMap; later entries replace earlier ones."""
    out: dict[int, str] = {}
    held: list = []
    box: list | None = None
    mode = ""

    def text(raw: bytes, add: int = 0) -> str:
        if len(raw) < 2:
            return chr((raw[0] if raw else 0) + add)
        units = [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw) - 1, 2)]
        units[-1] = (units[-1] + add) & 0xFFFF
        return b"".join(u.to_bytes(2, "big") for u in units).decode("utf-16-be", "replace")

    try:
        for kind, value, _, _ in tokens(data):
            if kind == "word":
                if value in ("beginbfchar", "beginbfrange"):
                    mode, held = value[5:], []
                elif value in ("endbfchar", "endbfrange"):
                    mode = ""
                continue
            if not mode:
                continue
            if kind == "open":
                box = []
            elif kind == "close":
                held.append(box or [])
                box = None
            elif box is not None:
                box.append(value)
            else:
                held.append(value)
            if mode == "bfchar" and len(held) == 2:
                code, to = held
                held = []
                if isinstance(code, bytes) and isinstance(to, bytes):
                    out[int.from_bytes(code, "big")] = text(to)
            elif mode == "bfrange" and len(held) == 3 and box is None:
                lo, hi, to = held
                held = []
                if not isinstance(lo, bytes) or not isinstance(hi, bytes):
                    continue
                lo, hi = int.from_bytes(lo, "big"), int.from_bytes(hi, "big")
                for i, code in enumerate(range(lo, min(hi, lo + 65535) + 1)):
                    if isinstance(to, bytes):
                        out[code] = text(to, i)
                    elif i < len(to) and isinstance(to[i], bytes):
                        out[code] = text(to[i])
    except SyntaxFault:
        pass
    return out


@functools.cache
def _standard(base: str) -> dict[int, float]:
    return {c: float(w) for c, w in enumerate(width_table(base), 32)}


_BYTES = [winansi(bytes([c])) for c in range(256)]


class Font:
    """Without a dictionary: one-byte WinAnsi codes of unknown width."""

    def __init__(self, doc: Document | None = None, d: dict | None = None):
        self.two_byte, self.unicode, self.widths, self.default = False, None, {}, None
        self.ascent, self.descent = 0.8, -0.2
        self._steps: tuple = (None, None)
        if d is None:
            return
        self.two_byte = doc.value(d, "Subtype") == "Type0"
        s = doc.value(d, "ToUnicode", Stream)
        if s is not None:
            try:
                self.unicode = cmap(doc.decoded(s))
            except FilterFault:
                pass
        parts = doc.value(d, "DescendantFonts", list)
        own = doc.get(parts[0]) if self.two_byte and parts else d
        own = own if isinstance(own, dict) else {}
        self._load_widths(doc, own)
        box = doc.value(own, "FontDescriptor", dict) or {}
        up, down = doc.value(box, "Ascent", (int, float)), doc.value(box, "Descent", (int, float))
        if up is not None and 0 < up / 1000 < 4:
            self.ascent = up / 1000
        if down is not None and -4 < down / 1000 < 0:
            self.descent = down / 1000

    def _load_widths(self, doc: Document, d: dict) -> None:
        num = lambda v: v if isinstance(v, (int, float)) and not isinstance(v, bool) else None
        if self.two_byte:
            v = num(doc.value(d, "DW"))
            self.default = float(v) if v is not None else 1000.0
            items = [doc.get(x) for x in doc.value(d, "W", list) or []]
            i = 0
            while i + 1 < len(items):
                first = items[i]
                if isinstance(items[i + 1], list):
                    for k, w in enumerate(items[i + 1]):
                        w = num(doc.get(w))
                        if w is not None and type(first) is int:
                            self.widths[first + k] = float(w)
                    i += 2
                elif i + 2 < len(items):
                    w = num(items[i + 2])
                    if type(first) is int and type(items[i + 1]) is int and w is not None:
                        self.widths.update(dict.fromkeys(range(first, min(items[i + 1], first + 65535) + 1), float(w)))
                    i += 3
                else:
                    break
            return
        w = doc.value(d, "Widths", list)
        if w is not None:
            first = doc.value(d, "FirstChar", int) or 0
            for k, x in enumerate(w):
                x = num(doc.get(x))
                self.widths[first + k] = float(x) if x is not None else 500.0
            return
        base = str(doc.value(d, "BaseFont") or "")
        base = base[7:] if base[6:7] == "+" else base
        if base in _STANDARD:
            self.widths = _standard(base)
            self.default = 500.0

    def codes(self, raw: bytes) -> list[int]:
        if not self.two_byte:
            return list(raw)
        return [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)]

    def text(self, code: int) -> str:
        if self.unicode is not None and code in self.unicode:
            return self.unicode[code]
        return "�" if self.two_byte else _BYTES[code & 255]

    def string(self, raw: bytes) -> str:
        """Text of a whole string."""
        return winansi(raw) if not self.two_byte and self.unicode is None else "".join(map(self.text, self.codes(raw)))

    def width(self, code: int) -> float | None:
        return self.widths.get(code, self.default)

    def advance(self, raw: bytes) -> float | None:
        """Thousandths of an em of a string; None where a width isn't known."""
        if not self.two_byte and (whole := self._whole):
            return float(sum(map(whole.__getitem__, raw)))
        total = 0.0
        for c in self.codes(raw):
            w = self.width(c)
            if w is None:
                return None
            total += w
        return total


    @functools.cached_property
    def _whole(self) -> list[int] | None:
        """Widths of all bytes where they are whole numbers, so that any order of adding gives the same."""
        every = [self.width(c) for c in range(256)]
        return [int(w) for w in every] if all(w is not None and abs(w) < 2**40 and w == int(w) for w in every) else None

    def steps(self, size: float, chars: float, words: float, scale: float) -> np.ndarray:
        """How far each byte moves on, in text space."""
        key = (size, chars, words, scale)
        if self._steps[0] != key:
            move = lambda c, w: ((w if w is not None else 500.0) / 1000 * size + chars + (words if c == 32 else 0.0)) * scale / 100
            self._steps = (key, np.array([move(c, self.width(c)) for c in range(256)], np.float64))
        return self._steps[1]


class FontBook:
    """Fonts of one resource dictionary, built once."""

    def __init__(self, doc: Document, resources: dict):
        self.doc, self.fonts, self.held = doc, doc.value(resources, "Font", dict) or {}, {}

    def __getitem__(self, name) -> Font:
        if name not in self.held:
            d = self.doc.get(self.fonts.get(name)) if name is not None else None
            self.held[name] = Font(self.doc, d) if isinstance(d, dict) else Font()
        return self.held[name]


__all__ = ["Font", "FontBook", "Keyword", "Name", "cmap"]
