"""TrueType fonts inside documents: text by glyph number, and at saving a subset with its five objects."""

from __future__ import annotations

from leafmill.operators.content import Op
from leafmill.sources.codecs import flate_stored
from leafmill.sources.document import Document
from leafmill.sources.files import fnv1a64
from leafmill.sources.syntax import Name, Ref, Str, Stream
from leafmill.sources.truetype import FontFault, TrueType, subset


class EmbeddedFont:
    """A font file of a document; its objects are made when the document is written."""

    def __init__(self, doc: Document, data: bytes, base: str = "Embedded", index: int = 0):
        if data[:4] == b"OTTO":
            raise FontFault("only TrueType outlines can be embedded")
        self.font, self.base, self.used = TrueType(data, index), base, {}
        self.ref = doc.add({Name("Type"): Name("Font"), Name("Subtype"): Name("Type0")})
        self.parts: list[Ref] = []
        doc.embedded.append(self)

    def gid(self, char: str) -> int:
        return self.font.cmap.get(ord(char), 0)

    def width(self, text: str, size: float) -> float:
        """Width in points; line ends count nothing, missing characters as glyph 0."""
        return sum(self.font.advance(self.gid(c)) for c in text if c != "\n") * size / self.font.units

    def add_text(self, doc: Document, page: Ref, text: str, x: float, y: float, size: float = 12.0, leading: float | None = None) -> None:
        fonts = doc.own_resources(page, "Font")
        name = next((k for k, v in fonts.items() if v == self.ref), None) or Name(next(f"E{i}" for i in range(1, len(fonts) + 2) if f"E{i}" not in fonts))
        fonts[name] = self.ref
        ops = [Op("BT", []), Op("Tf", [name, float(size)]), Op("TL", [float(leading if leading is not None else size * 1.2)]), Op("Td", [float(x), float(y)])]
        for i, line in enumerate(text.split("\n")):
            raw = b""
            for c in line:
                g = self.gid(c)
                self.used.setdefault(g, c)
                raw += g.to_bytes(2, "big")
            s = Str(raw)
            s.hexed = True
            ops += [Op("T*", [])] * bool(i) + [Op("Tj", [s])]
        doc.append_content(page, [*ops, Op("ET", [])])

    def to_unicode(self) -> bytes:
        rows = [f"<{g:04X}> <{c.encode('utf-16-be').hex().upper()}>" for g, c in sorted(self.used.items())]
        blocks = [rows[i : i + 100] for i in range(0, len(rows), 100)]
        body = "".join(f"{len(b)} beginbfchar\n" + "\n".join(b) + "\nendbfchar\n" for b in blocks)
        return ("/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CMapType 2 def\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n" + body + "endcmap\nend\nend\n").encode()

    def finish(self, doc: Document) -> None:
        """Write or rewrite the font's objects; the same glyphs give the same bytes."""
        f, k = self.font, 1000 / self.font.units
        small = subset(f, set(self.used))
        h = fnv1a64(",".join(map(str, sorted(self.used))).encode())
        tag = "".join(chr(65 + (h >> 5 * i) % 26) for i in range(6))
        name = Name(f"{tag}+{self.base}")
        while len(self.parts) < 4:
            self.parts.append(doc.add(None))
        cid, desc, program, cmap = self.parts
        doc.objects[program] = Stream({Name("Filter"): Name("FlateDecode"), Name("Length1"): len(small)}, flate_stored(small))
        doc.objects[desc] = {Name("Type"): Name("FontDescriptor"), Name("FontName"): name, Name("Flags"): 4, Name("FontBBox"): [0, f.descent * k, 1000, f.ascent * k], Name("ItalicAngle"): 0, Name("Ascent"): f.ascent * k, Name("Descent"): f.descent * k, Name("CapHeight"): f.ascent * k, Name("StemV"): 80, Name("FontFile2"): program}
        widths = [v for g in sorted(self.used) for v in (g, [f.advance(g) * k])]
        doc.objects[cid] = {Name("Type"): Name("Font"), Name("Subtype"): Name("CIDFontType2"), Name("BaseFont"): name, Name("CIDSystemInfo"): {Name("Registry"): Str(b"Adobe"), Name("Ordering"): Str(b"Identity"), Name("Supplement"): 0}, Name("FontDescriptor"): desc, Name("DW"): 1000, Name("W"): widths, Name("CIDToGIDMap"): Name("Identity")}
        doc.objects[cmap] = Stream({}, self.to_unicode())
        doc.objects[self.ref] = {Name("Type"): Name("Font"), Name("Subtype"): Name("Type0"), Name("BaseFont"): name, Name("Encoding"): Name("Identity-H"), Name("DescendantFonts"): [cid], Name("ToUnicode"): cmap}
