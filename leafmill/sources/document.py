"""A loaded document: navigation, metadata and page editing over its object table."""

from __future__ import annotations

from leafmill.operators.content import Op, write_content
from leafmill.sources.codecs import FilterFault, decode_stream
from leafmill.sources.files import FileFault, load, write_file
from leafmill.sources.syntax import Name, Ref, Str, Stream



def winansi(raw: bytes) -> str:
    return raw.decode("cp1252", "replace")


def to_winansi(text: str) -> bytes:
    """WinAnsi bytes; what it lacks becomes `?`."""
    try:
        return text.encode("cp1252")
    except UnicodeEncodeError:
        return text.encode("cp1252", "replace")


def decode_text(raw: bytes) -> str:
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw[3:].decode("utf-8", "replace") if raw[:3] == b"\xef\xbb\xbf" else winansi(raw)


def encode_text(text: str) -> Str:
    return Str(text.encode("ascii") if text.isascii() else b"\xfe\xff" + text.encode("utf-16-be"))


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


class Document:
    """Objects by reference; every method copes with missing or odd values."""

    def __init__(self, objects: dict | None = None, trailer: dict | None = None, version: str = "1.7"):
        self.version = version
        if objects is None:
            objects = {Ref(1, 0): {Name("Type"): Name("Catalog"), Name("Pages"): Ref(2, 0)}, Ref(2, 0): {Name("Type"): Name("Pages"), Name("Kids"): [], Name("Count"): 0}}
            trailer = {Name("Root"): Ref(1, 0)}
        self.objects, self.trailer = objects, trailer or {}
        self.embedded: list = []
        self._top: tuple = (0,)

    @classmethod
    def read(cls, data: bytes, password: bytes = b"") -> Document:
        version, objects, trailer = load(data, password)
        return cls(objects, trailer, version)

    def write(self) -> bytes:
        for font in self.embedded:
            font.finish(self)
        return write_file(self.objects, self.trailer, self.version)

    # --- objects

    def get(self, v, hops: int = 64):
        """What a value stands for: exact generation, else the lowest of that number; dangling ones are None."""
        while isinstance(v, Ref) and hops:
            hops -= 1
            if v in self.objects:
                v = self.objects[v]
                continue
            low = min((r for r in self.objects if r.num == v.num), default=None)
            v = self.objects[low] if low else None
        return None if isinstance(v, Ref) else v

    def value(self, d, key: str, kind=None):
        """Resolved entry of a dictionary, None where it is missing or of another kind."""
        d = self.get(d)
        d = d.dict if isinstance(d, Stream) else d
        v = self.get(d.get(key)) if isinstance(d, dict) else None
        return v if kind is None or isinstance(v, kind) and not (kind is not bool and isinstance(v, bool)) else None

    def add(self, obj) -> Ref:
        # the highest number is looked for again only after other changes than this one
        if self._top[1:] != (len(self.objects), next(reversed(self.objects), None)):
            self._top = (max((r.num for r in self.objects), default=0),)
        ref = Ref(self._top[0] + 1, 0)
        self.objects[ref] = obj
        self._top = (ref.num, len(self.objects), ref)
        return ref

    @property
    def catalog(self) -> dict:
        return self.value({"r": self.trailer.get("Root")}, "r", dict) or {}

    # --- pages

    def pages(self) -> list[Ref]:
        """Pages in document order. A node is inner if it says /Pages, or has kids and no type; none counts twice."""
        out, seen, stack = [], set(), [(self.catalog.get("Pages"), 0)]
        while stack:
            ref, level = stack.pop()
            if not isinstance(ref, Ref) or ref.num in seen or level > 64:
                continue
            seen.add(ref.num)
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            kind, kids = self.value(node, "Type"), self.value(node, "Kids", list)
            if kind == "Pages" or kind is None and kids is not None:
                stack.extend((k, level + 1) for k in reversed(kids or []))
            else:
                out.append(ref)
        return out

    def page(self, index: int) -> Ref:
        pages = self.pages()
        if not 0 <= index < len(pages):
            raise FileFault("PageOutOfRange", f"page {index} of {len(pages)}")
        return pages[index]

    def inherited(self, page: Ref, key: str):
        node = page
        for _ in range(65):
            v = self.value(node, key)
            if v is not None:
                return v
            node = (self.get(node) or {}).get("Parent") if isinstance(self.get(node), dict) else None
            if node is None:
                return None
        return None

    def media_box(self, page: Ref) -> list[float]:
        box = self.inherited(page, "MediaBox")
        v = [self.get(x) for x in box] if isinstance(box, list) else []
        return [float(x) for x in v] if len(v) == 4 and all(map(_number, v)) else [0.0, 0.0, 612.0, 792.0]

    def rotation(self, page: Ref) -> int:
        r = self.inherited(page, "Rotate")
        return int(r) % 360 // 90 * 90 if _number(r) else 0

    def size(self, page: Ref) -> tuple[float, float]:
        x0, y0, x1, y1 = self.media_box(page)
        w, h = max(abs(x1 - x0), 1.0), max(abs(y1 - y0), 1.0)
        return (h, w) if self.rotation(page) in (90, 270) else (w, h)

    def resources(self, page: Ref) -> dict:
        r = self.inherited(page, "Resources")
        return r if isinstance(r, dict) else {}

    def decoded(self, s: Stream, upto: tuple = ()) -> bytes:
        return decode_stream(s, self.get, upto)

    def content(self, page: Ref) -> bytes:
        """Content bytes; each member of an array is followed by a line end. Members that can't be decoded are left out."""
        c = self.value(page, "Contents")
        if isinstance(c, Stream):
            return self.decoded(c)
        out = []
        for part in c if isinstance(c, list) else []:
            s = self.get(part)
            if isinstance(s, Stream):
                try:
                    out.append(self.decoded(s) + b"\n")
                except FilterFault:
                    continue
        return b"".join(out)

    # --- navigation

    def _tree(self, node, leaf: str, depth: int = 0, seen: set | None = None):
        """Pairs of a name or number tree, in order; limits aren't trusted."""
        seen = set() if seen is None else seen
        if isinstance(node, Ref):
            if node in seen:
                return
            seen.add(node)
        d = self.get(node)
        if not isinstance(d, dict) or depth > 32:
            return
        pairs = self.value(d, leaf, list) or []
        yield from zip((self.get(k) for k in pairs[::2]), pairs[1::2])
        for kid in self.value(d, "Kids", list) or []:
            yield from self._tree(kid, leaf, depth + 1, seen)

    def named_destination(self, key):
        """The old table first, then the name tree."""
        old = self.value(self.catalog, "Dests", dict)
        text = decode_text(key) if isinstance(key, bytes) else str(key)
        if old is not None and text in old:
            return self.get(old[text])
        raw = bytes(key) if isinstance(key, bytes) else text.encode()
        for k, v in self._tree((self.value(self.catalog, "Names", dict) or {}).get("Dests"), "Names"):
            if isinstance(k, bytes) and bytes(k) == raw:
                return self.get(v)
        return None

    def destination(self, v, numbers: dict, hops: int = 4) -> dict | None:
        """page_index, x, y, zoom of a destination: explicit, by name, or wrapped in a dictionary."""
        v = self.get(v)
        if hops < 0 or v is None:
            return None
        if isinstance(v, (bytes, Name)):
            return self.destination(self.named_destination(v), numbers, hops - 1)
        if isinstance(v, dict):
            return self.destination(v.get("D"), numbers, hops - 1)
        if not isinstance(v, list) or not v:
            return None
        page = v[0]
        index = numbers.get(page.num) if isinstance(page, Ref) else page if type(page) is int and page >= 0 else None
        how, a = (str(self.get(v[1])) if len(v) > 1 else ""), [self.get(x) for x in v[2:]]
        num = lambda i: float(a[i]) if i < len(a) and _number(a[i]) else None
        out = {"page_index": index, "x": None, "y": None, "zoom": None}
        if how == "XYZ":
            zoom = num(2)
            out |= {"x": num(0), "y": num(1), "zoom": zoom if zoom and zoom > 0 else None}
        elif how in ("FitH", "FitBH"):
            out["y"] = num(0)
        elif how in ("FitV", "FitBV"):
            out["x"] = num(0)
        elif how == "FitR":
            out |= {"x": num(0), "y": num(3)}
        return out

    def target(self, d: dict, numbers: dict) -> dict | None:
        """Where an outline item or link leads: /Dest first, then a GoTo or URI action."""
        if self.get(d.get("Dest")) is not None:
            dest = self.destination(d["Dest"], numbers)
            return {"kind": "goto", "dest": dest, "uri": None} if dest else None
        action = self.value(d, "A", dict)
        if action is None:
            return None
        kind = self.value(action, "S")
        if kind == "URI":
            uri = self.value(action, "URI", bytes)
            return {"kind": "uri", "dest": None, "uri": decode_text(uri)} if uri is not None else None
        if kind == "GoTo":
            dest = self.destination(action.get("D"), numbers)
            return {"kind": "goto", "dest": dest, "uri": None} if dest else None
        return None

    def page_numbers(self) -> dict[int, int]:
        return {ref.num: i for i, ref in reversed(list(enumerate(self.pages())))}

    def outlines(self) -> list[dict]:
        """Outline items in order with node_path and depth; an item met again ends its chain."""
        numbers, out, seen = self.page_numbers(), [], set()

        def level(first, path):
            ref, k = first, 0
            while isinstance(ref, Ref) and ref not in seen and len(path) < 32:
                seen.add(ref)
                item = self.get(ref)
                if not isinstance(item, dict):
                    return
                title = self.value(item, "Title", bytes)
                out.append({"node_path": [*path, k], "depth": len(path), "title": decode_text(title) if title is not None else "", "target": self.target(item, numbers)})
                level(item.get("First"), [*path, k])
                ref, k = item.get("Next"), k + 1

        level((self.value(self.catalog, "Outlines", dict) or {}).get("First"), [])
        return out

    def links(self, page: Ref, numbers: dict[int, int] | None = None) -> list[dict]:
        """Links of a page; numbers: page_numbers(), where the links of many pages are wanted."""
        numbers, out = self.page_numbers() if numbers is None else numbers, []
        for a in self.value(page, "Annots", list) or []:
            d = self.get(a)
            if not isinstance(d, dict) or self.value(d, "Subtype") != "Link":
                continue
            box, target = self.rect(d.get("Rect")), self.target(d, numbers)
            if box and target:
                out.append({"rect": box, **target})
        return out

    def rect(self, v) -> list[float] | None:
        v = self.get(v)
        c = [self.get(x) for x in v] if isinstance(v, list) else []
        if len(c) != 4 or not all(_number(x) and abs(x) != float("inf") and x == x for x in c):
            return None
        return [float(min(c[0], c[2])), float(min(c[1], c[3])), float(max(c[0], c[2])), float(max(c[1], c[3]))]

    def label_ranges(self) -> list[dict]:
        out = []
        for start, v in self._tree(self.catalog.get("PageLabels"), "Nums"):
            d = self.get(v)
            if type(start) is int and isinstance(d, dict):
                prefix, first, style = self.value(d, "P", bytes), self.value(d, "St", int), self.value(d, "S", Name)
                out.append({"start": start, "style": str(style) if style else None, "prefix": decode_text(prefix) if prefix is not None else None, "first": first if first and first >= 1 else 1})
        return out

    # --- metadata

    def info(self, key: str) -> str | None:
        v = self.value(self.trailer.get("Info"), key, bytes)
        return decode_text(v) if v is not None else None

    def set_info(self, key: str, text: str) -> None:
        info = self.trailer.get("Info")
        if not isinstance(self.get(info), dict):
            info = self.trailer[Name("Info")] = self.add({})
        self.get(info)[Name(key)] = encode_text(text)

    # --- editing

    def add_page(self, width: float = 612.0, height: float = 792.0) -> Ref:
        root = self.catalog["Pages"]
        page = self.add({Name("Type"): Name("Page"), Name("Parent"): root, Name("MediaBox"): [0, 0, float(width), float(height)], Name("Resources"): {}})
        node = self.get(root)
        node.setdefault(Name("Kids"), []).append(page)
        node[Name("Count")] = (node.get("Count") or 0) + 1
        return page

    def remove_page(self, index: int) -> None:
        page = self.page(index)
        parent = self.get(page).get("Parent")
        kids = self.value(parent, "Kids", list) or []
        kids[:] = [k for k in kids if k != page]
        seen = set()
        while isinstance(parent, Ref) and parent not in seen:
            seen.add(parent)
            node = self.get(parent)
            if type(node.get("Count")) is int:
                node[Name("Count")] = max(0, node["Count"] - 1)
            parent = node.get("Parent")
        del self.objects[page]

    def rotate_page(self, index: int, degrees: int) -> None:
        if degrees % 90:
            raise ValueError("a page turns by quarter turns")
        page = self.page(index)
        self.get(page)[Name("Rotate")] = (self.rotation(page) + degrees) % 360

    def append_content(self, page: Ref, ops: list[Op] | bytes) -> None:
        """Add a content stream behind those that a page has."""
        raw = ops if isinstance(ops, bytes) else write_content(ops)
        d = self.get(page)
        old = d.get("Contents")
        held = self.get(old)
        d[Name("Contents")] = [*(held if isinstance(held, list) else [old] if old is not None else []), self.add(Stream({}, raw))]

    def own_resources(self, page: Ref, kind: str) -> dict:
        """The page's own dictionary of one kind of resource, copied from an inherited one."""
        d = self.get(page)
        res = self.value(d, "Resources", dict)
        if res is None:
            res = d[Name("Resources")] = dict(self.resources(page))
        part = self.value(res, kind, dict)
        if part is None:
            part = res[Name(kind)] = {}
        return part

    def font(self, page: Ref, base: str) -> str:
        """Name of a standard font on a page: one that is there already, else the first free F1, F2, .."""
        fonts = self.own_resources(page, "Font")
        for k, v in fonts.items():
            if self.value(v, "BaseFont") == base and self.value(v, "Subtype") == "Type1":
                return k
        name = Name(next(f"F{i}" for i in range(1, len(fonts) + 2) if f"F{i}" not in fonts))
        enc = {} if base in ("Symbol", "ZapfDingbats") else {Name("Encoding"): Name("WinAnsiEncoding")}
        fonts[name] = self.add({Name("Type"): Name("Font"), Name("Subtype"): Name("Type1"), Name("BaseFont"): Name(base), **enc})
        return name

    def add_text(self, page: Ref, text: str, x: float, y: float, size: float = 12.0, font: str = "Helvetica", leading: float | None = None) -> None:
        """Lines of text from (x, y) down; leading is 1.2 of the size unless given."""
        name, lead = self.font(page, font), leading if leading is not None else size * 1.2
        ops = [Op("BT", []), Op("Tf", [Name(name), float(size)]), Op("TL", [float(lead)]), Op("Td", [float(x), float(y)])]
        for i, line in enumerate(text.split("\n")):
            if i:
                ops.append(Op("T*", []))
            ops.append(Op("Tj", [Str(to_winansi(line))]))
        self.append_content(page, [*ops, Op("ET", [])])

    def draw_line(self, page: Ref, x0: float, y0: float, x1: float, y1: float, width: float = 1.0, color=(0.0, 0.0, 0.0)) -> None:
        self.append_content(page, [Op("q", []), Op("w", [float(width)]), Op("RG", list(map(float, color))), Op("m", [float(x0), float(y0)]), Op("l", [float(x1), float(y1)]), Op("S", []), Op("Q", [])])

    def draw_rect(self, page: Ref, x: float, y: float, w: float, h: float, fill=None, stroke=(0.0, 0.0, 0.0), width: float = 1.0) -> None:
        ops = [Op("q", []), Op("w", [float(width)]), Op("RG", list(map(float, stroke)))]
        if fill is not None:
            ops.append(Op("rg", list(map(float, fill))))
        self.append_content(page, [*ops, Op("re", [float(x), float(y), float(w), float(h)]), Op("B" if fill is not None else "S", []), Op("Q", [])])
