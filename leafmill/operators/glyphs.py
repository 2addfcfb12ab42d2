"""Fonts for drawing: which outline a code has. Fonts that aren't embedded advance without ink."""

from __future__ import annotations

from leafmill.operators.fonts import Font
from leafmill.operators.raster import Path
from leafmill.sources import encodings
from leafmill.sources.cff import Cff
from leafmill.sources.codecs import FilterFault
from leafmill.sources.syntax import Name, Ref, Stream
from leafmill.sources.truetype import FontFault, TrueType

# Names of the glyphs that encodings by /Differences use most, and what they stand for.
NAMES = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*",
    "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8",
    "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]",
    "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“",
    "quotedblright": "”", "bullet": "•", "endash": "–", "emdash": "—", "ellipsis": "…", "fi": "ﬁ", "fl": "ﬂ", "Euro": "€", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oslash": "ø", "Oslash": "Ø",
    "aring": "å", "Aring": "Å", "ccedilla": "ç", "Ccedilla": "Ç", "ntilde": "ñ", "Ntilde": "Ñ", "copyright": "©", "registered": "®", "degree": "°", "section": "§", "paragraph": "¶",
}
_MARKS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "caron": "̌"}


def glyph_text(name: str) -> str | None:
    """Character of a glyph name: known names, letters with a mark, uniXXXX, uXXXXX, single characters."""
    import unicodedata

    if name in NAMES:
        return NAMES[name]
    if len(name) == 1:
        return name
    if len(name) > 1 and name[1:] in _MARKS:
        return unicodedata.normalize("NFC", name[0] + _MARKS[name[1:]])
    for lead, low, high in (("uni", 4, 4), ("u", 4, 6)):
        digits = name.removeprefix(lead)
        if name.startswith(lead) and low <= len(digits) <= high:
            try:
                return chr(int(digits, 16))
            except (ValueError, OverflowError):
                continue
    return None


class RenderFont:
    def __init__(self, doc, d: dict):
        self.metrics = Font(doc, d)
        self.program, self.codes, self.held = None, {}, {}
        parts = doc.value(d, "DescendantFonts", list)
        own = doc.get(parts[0]) if self.metrics.two_byte and parts else d
        box = doc.value(own, "FontDescriptor", dict) or {}
        try:
            for key, make in (("FontFile2", TrueType), ("FontFile3", Cff)):
                s = doc.value(box, key, Stream)
                if s is not None:
                    raw = doc.decoded(s)
                    self.program = TrueType(raw) if raw[:4] in (b"\0\1\0\0", b"true", b"ttcf") else make(raw)
                    break
        except (FontFault, FilterFault, IndexError, KeyError, ValueError):
            self.program = None
        self.map = doc.value(own, "CIDToGIDMap", Stream) if self.metrics.two_byte else None
        self.map = doc.decoded(self.map) if self.map is not None else None
        named, enc = doc.value(d, "Encoding", Name), doc.value(d, "Encoding", dict)
        base = named or (doc.value(enc, "BaseEncoding", Name) if enc else None)
        self.base = encodings.table(str(base or "WinAnsiEncoding"))
        at = 0
        for v in doc.value(enc, "Differences", list) or [] if enc else []:
            v = doc.get(v)
            if isinstance(v, int):
                at = v
            elif isinstance(v, Name):
                self.codes[at] = str(v)
                at += 1

    def gid(self, code: int) -> int:
        p = self.program
        if self.metrics.two_byte:
            if self.map is not None:
                return int.from_bytes(self.map[2 * code : 2 * code + 2], "big")
            return p.gid_of_cid(code) if isinstance(p, Cff) else code
        if isinstance(p, Cff):
            return code if code < len(p.glyphs) else 0
        text = glyph_text(self.codes[code]) if code in self.codes else self.base.get(code)
        for m in (p.cmap, *p.maps.values()):
            for c in (ord(text) if text and len(text) == 1 else -1, code, 0xF000 + code):
                if c in m:
                    return m[c]
        return 0

    def outline(self, code: int, m) -> Path | None:
        if self.program is None:
            return None
        path = Path()
        try:
            self.program.draw(self.gid(code), path, m)
        except (FontFault, IndexError, KeyError, ValueError, RecursionError):
            return None
        return path if path.subs or len(path.now) > 1 else None


def render_font(renderer, v) -> RenderFont | None:
    """The font of a resource entry, built once for each page."""
    key = v if isinstance(v, Ref) else id(v)
    if key not in renderer.fonts:
        d = renderer.doc.get(v)
        renderer.fonts[key] = RenderFont(renderer.doc, d) if isinstance(d, dict) else None
    return renderer.fonts[key]
