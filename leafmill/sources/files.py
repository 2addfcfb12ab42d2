"""PDF files: from bytes to objects, whatever state their cross-reference table is in, and back to bytes."""

from __future__ import annotations

import functools
import re

import numpy as np

from leafmill.sources.codecs import FilterFault, decode_stream, flate_stored
from leafmill.sources.syntax import DELIMITERS, SPACE, Keyword, Name, Ref, Str, Stream, SyntaxFault, parse_indirect, parse_object, tokens

#: Trailer keys that describe the file they stood in, not the document.
STRUCTURAL = ("Size", "Prev", "XRefStm", "Encrypt", "W", "Index", "Filter", "DecodeParms", "Length", "Type")
_ERRORS = (SyntaxFault, FilterFault, ValueError, IndexError, KeyError, TypeError, OverflowError, RecursionError)


class FileFault(ValueError):
    """kind: NotAPdf, BadXref, Encrypted, WrongPassword, PageOutOfRange or TypeMismatch."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def version_of(data: bytes) -> str:
    m = re.search(rb"%PDF-([0-9.]*)", data[:1024])
    if not m or not m[1]:
        raise FileFault("NotAPdf", "no %PDF- header")
    return m[1].decode()


def start_of_xref(data: bytes) -> int:
    at = data.rfind(b"startxref", max(0, len(data) - 2048))
    m = re.compile(rb"startxref[\x00\t\n\f\r ]+([0-9]+)").match(data, at) if at >= 0 else None
    if not m:
        raise FileFault("BadXref", "no startxref")
    return int(m[1])


def classic_section(data: bytes, at: int) -> tuple[dict, dict]:
    """({number: entry}, trailer) of a table; entries are (kind, place, generation or index)."""
    flow = tokens(data, at)
    if next(flow, (0, 0))[1] != "xref":
        raise SyntaxFault("no table")
    found, held = {}, []
    first = left = None
    for kind, value, _, end in flow:
        if kind == "word" and value == "trailer":
            trailer, _ = parse_object(data, end)
            if not isinstance(trailer, dict):
                raise SyntaxFault("the trailer isn't a dictionary")
            return found, trailer
        held.append(value)
        if not left and len(held) == 2:
            first, left = held
            held = []
            if type(first) is not int or type(left) is not int:
                raise SyntaxFault("bad subsection")
        elif left and len(held) == 3:
            place, gen, use = held
            held = []
            found.setdefault(first, ("file", place, gen) if use == "n" else ("free", 0, gen))
            first, left = first + 1, left - 1
    raise SyntaxFault("the table has no trailer")


def stream_section(data: bytes, at: int) -> tuple[dict, dict]:
    """The same of a cross-reference stream."""
    _, _, s, _ = parse_indirect(data, at)
    if not isinstance(s, Stream) or s.dict.get("Type") != "XRef":
        raise SyntaxFault("no cross-reference stream")
    raw, widths = decode_stream(s), s.dict["W"]
    index = s.dict.get("Index") or [0, s.dict.get("Size", 0)]
    row, at, found = sum(widths), 0, {}
    for first, n in zip(index[::2], index[1::2]):
        for num in range(first, first + n):
            if at + row > len(raw) or not row:
                return found, s.dict
            v, p = [], at
            for w in widths[:3]:
                v.append(int.from_bytes(raw[p : p + w], "big"))
                p += w
            at += row
            kind = v[0] if widths[0] else 1
            if kind in (0, 1, 2):
                found.setdefault(num, (("free", "file", "stream")[kind], v[1], v[2]))
    return found, s.dict


def sections(data: bytes) -> list[tuple[dict, dict]]:
    """All sections, newest first; the stream of a hybrid table stands behind its table."""
    out, seen, todo = [], set(), [start_of_xref(data)]
    while todo:
        at = todo.pop(0)
        if at in seen or not 0 <= at < len(data):
            if not out:
                raise FileFault("BadXref", "startxref leads nowhere")
            continue
        seen.add(at)
        try:
            found, trailer = classic_section(data, at)
        except _ERRORS:
            found, trailer = stream_section(data, at)
        out.append((found, trailer))
        more = [trailer[k] for k in ("XRefStm", "Prev") if type(trailer.get(k)) is int]
        if "XRefStm" in trailer and type(trailer["XRefStm"]) is int:
            at2 = more.pop(0)
            if at2 not in seen:
                seen.add(at2)
                try:
                    out.append(stream_section(data, at2))
                except _ERRORS:
                    pass
        todo = [int(m) for m in more] + todo
    return out


def merge(parts: list[tuple[dict, dict]]) -> tuple[dict, dict]:
    """Newest entry of each number (a free one hides older ones), newest value of each trailer key."""
    table, trailer = {}, {}
    for found, own in parts:
        for num, entry in found.items():
            table.setdefault(num, entry)
        for k, v in own.items():
            trailer.setdefault(k, v)
    return table, trailer


_OBJ = re.compile(rb"(?<![0-9])([0-9]{1,10})[\x00\t\n\f\r ]+([0-9]{1,5})[\x00\t\n\f\r ]+obj(?![A-Za-z])")


def rebuild(data: bytes) -> tuple[dict, dict]:
    """A table from the object headers found in the bytes: the last one of a number counts.

    The last trailer dictionary counts, else the root of a cross-reference stream or any catalog. Objects
    inside object streams aren't looked for.
    """
    table = {int(m[1]): ("file", m.start(), int(m[2])) for m in _OBJ.finditer(data)}
    trailer: dict = {}
    for m in re.finditer(rb"trailer", data):
        try:
            t, _ = parse_object(data, m.end())
            if isinstance(t, dict):
                trailer = t
        except _ERRORS:
            continue
    if "Root" not in trailer:
        for num, (_, at, gen) in table.items():
            try:
                _, _, obj, _ = parse_indirect(data, at)
            except _ERRORS:
                continue
            d = obj.dict if isinstance(obj, Stream) else obj
            if isinstance(d, dict) and d.get("Type") == "XRef" and "Root" in d:
                trailer = {**d, **trailer}
            elif isinstance(d, dict) and d.get("Type") == "Catalog" and "Root" not in trailer:
                trailer = {**trailer, "Root": Ref(num, gen)}
    if not table:
        raise FileFault("BadXref", "no object in the file")
    return table, trailer


def load(data: bytes, password: bytes = b"") -> tuple[str, dict[Ref, object], dict]:
    """(version, objects, trailer). A file whose table can't be used is rebuilt from its object headers."""
    version = version_of(data)
    try:
        objects, trailer = _build(data, *merge(sections(data)), password)
        if objects and isinstance(_root(objects, trailer), dict):
            return version, objects, trailer
    except FileFault as e:
        if e.kind in ("Encrypted", "WrongPassword"):
            raise
    except _ERRORS:
        pass
    objects, trailer = _build(data, *rebuild(data), password)
    return version, objects, trailer


def _root(objects: dict, trailer: dict):
    root = trailer.get("Root")
    return objects.get(root) if isinstance(root, Ref) else root


def _build(data: bytes, table: dict, trailer: dict, password: bytes) -> tuple[dict, dict]:
    from leafmill.sources import security

    def length_of(ref: Ref):
        entry = table.get(ref.num)
        if not entry or entry[0] != "file":
            return None
        try:
            return parse_indirect(data, entry[1])[2]
        except _ERRORS:
            return None

    objects: dict[Ref, object] = {}
    for num, (kind, at, gen) in sorted(table.items()):
        if kind != "file" or not 0 <= at < len(data):
            continue
        try:
            n, g, obj, _ = parse_indirect(data, at, length_of)
        except _ERRORS:
            continue
        if n == num:
            objects[Ref(n, g)] = obj
    lock = trailer.get("Encrypt")
    held = lock if isinstance(lock, Ref) else None
    settings = objects.get(held) if held else lock
    if isinstance(settings, dict):
        ids = trailer.get("ID")
        first = ids[0] if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b""
        handler = security.Handler({k: objects.get(v, v) if isinstance(v, Ref) else v for k, v in settings.items()}, first, password)
        objects = {ref: obj if ref == held else handler.open(obj, ref) for ref, obj in objects.items()}
    resolve = lambda x: objects.get(x) if isinstance(x, Ref) else x
    for ref, s in list(objects.items()):
        if not isinstance(s, Stream) or s.dict.get("Type") != "ObjStm":
            continue
        try:
            raw, n, first = decode_stream(s, resolve), resolve(s.dict["N"]), resolve(s.dict["First"])
            head = [v for k, v, _, _ in tokens(raw[:first]) if k == "value"][: 2 * n]
        except _ERRORS:
            continue
        for num, at in zip(head[::2], head[1::2]):
            # only where the table says that the object stands in this very stream
            if table.get(num, ("", 0))[:2] != ("stream", ref.num):
                continue
            try:
                objects[Ref(num, 0)] = parse_object(raw, first + at)[0]
            except _ERRORS:
                continue
    containers = [r for r, o in objects.items() if isinstance(o, Stream) and o.dict.get("Type") in ("ObjStm", "XRef")]
    for r in containers:
        del objects[r]
    return objects, {k: v for k, v in trailer.items() if k not in STRUCTURAL}


def format_real(v: float) -> str:
    if v != v or v in (float("inf"), float("-inf")):
        return "0"
    if v == int(v) and abs(v) < 1e15:
        return str(int(v))
    text = f"{v:.6f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


@functools.lru_cache(4096)
def write_name(n: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in DELIMITERS and c != 35 else b"#%02X" % c for c in n.encode("utf-8", "surrogatepass"))


_SHOWN = bytes(range(32, 127))
_ESCAPE = {40: b"\\(", 41: b"\\)", 92: b"\\\\", 10: b"\\n", 13: b"\\r", 9: b"\\t", 8: b"\\b", 12: b"\\f"}
_TO_ESCAPE = re.compile(rb"[^ -'*-\[\]-~]")
_ESCAPED = {bytes([c]): _ESCAPE.get(c) or b"\\%03o" % c for c in range(256)}


def write_string(s: bytes) -> bytes:
    """Hex where the string came so or is mostly unprintable, else literal with escapes."""
    odd = len(s.translate(None, _SHOWN))
    if getattr(s, "hexed", False) or odd * 2 > len(s):
        return b"<" + s.hex().upper().encode() + b">"
    return b"(" + _TO_ESCAPE.sub(lambda m: _ESCAPED[m[0]], s) + b")"


def write_object(v) -> bytes:
    if v is None:
        return b"null"
    if v is True or v is False:
        return b"true" if v else b"false"
    if isinstance(v, Ref):
        return b"%d %d R" % v
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        return format_real(v).encode()
    if isinstance(v, (Name, Keyword)):
        return write_name(v) if isinstance(v, Name) else v.encode("latin-1")
    if isinstance(v, bytes):
        return write_string(v)
    if isinstance(v, list):
        return b"[" + b" ".join(map(write_object, v)) + b"]"
    if isinstance(v, dict):
        return b"<<" + b" ".join(write_name(k) + b" " + write_object(x) for k, x in v.items()) + b">>"
    if isinstance(v, Stream):
        d = {**v.dict, "Length": len(v.data)}
        return write_object(d) + b"\nstream\n" + v.data + b"\nendstream"
    raise FileFault("TypeMismatch", f"can't write {type(v).__name__}")


_PRIME, _PART = 0x100000001B3, 1 << 14
_S8, _S16, _S32, _S56, _ALL = map(np.uint64, (8, 16, 32, 56, 0x0101010101010101))
_LOW, _BITS = np.uint8(_PRIME & 255), [np.uint8(1 << k) for k in range(8)]
_POWERS = np.multiply.accumulate(np.full(_PART, _PRIME, np.uint64))[::-1].copy()


def fnv1a64(data: bytes, h: int = 0xCBF29CE484222325) -> int:
    """FNV-1a by whole arrays.

    A byte changes the low byte x of the sum alone, so the sum is a polynomial of the prime in these changes.
    Low bytes follow bit by bit: a bit of the next one is the xor of that bit before, that of the byte, and
    what lower bits carry into it.
    """
    if len(data) < 768:
        for c in data:
            h = (h ^ c) * _PRIME & 0xFFFFFFFFFFFFFFFF
        return h
    for begin in range(0, len(data), _PART):
        c = np.frombuffer(data, np.uint8, min(_PART, len(data) - begin), begin)
        n, short = len(c), -len(c) % 8
        c = np.concatenate([c, np.zeros(short, np.uint8)]) if short else c
        x, step = np.zeros_like(c), np.empty_like(c)  # x: the low byte after the xor, as far as its bits are known
        words = step.view("<u8")
        for bit in _BITS:
            np.multiply(x[:-1], _LOW, out=step[1:])  # what lower bits carry into this one of the next byte
            step[0] = h & 255
            step ^= c
            step &= bit
            words ^= words << _S8  # xors of all bytes before: within words, then of the words' last bytes
            words ^= words << _S16
            words ^= words << _S32
            words[1:] ^= np.bitwise_xor.accumulate(words[:-1] >> _S56) * _ALL
            x |= step
        change = x.astype(np.int64)
        change -= x ^ c
        total = int(np.dot(change[:n].view(np.uint64), _POWERS[_PART - n :]))
        h = (h * pow(_PRIME, n, 1 << 64) + total) & 0xFFFFFFFFFFFFFFFF
    return h


def write_file(objects: dict[Ref, object], trailer: dict, version: str = "1.7") -> bytes:
    """A complete file: header, objects by number, one classic table, trailer with an /ID made of the body.

    Writing what was read from such a file gives the same bytes.
    """
    out, places = [b"%%PDF-%s\n%%\xe2\xe3\xcf\xd3\n" % version.encode()], {}
    size = len(out[0])
    for ref in sorted(objects):
        body = b"%d %d obj\n" % ref + write_object(objects[ref]) + b"\nendobj\n"
        places[ref.num] = (size, ref.gen)
        out.append(body)
        size += len(body)
    body = b"".join(out)
    lines, run = [], []
    for num in [0, *sorted(places)]:
        if run and num != run[-1] + 1:
            lines.append((run[0], len(run)))
            run = []
        run.append(num)
    lines.append((run[0], len(run)))
    table = [b"xref\n"]
    for first, n in lines:
        table.append(b"%d %d\n" % (first, n))
        for num in range(first, first + n):
            table.append(b"%010d %05d n \n" % places[num] if num else b"0000000000 65535 f \n")
    a = fnv1a64(body)
    mark = Str(a.to_bytes(8, "big") + fnv1a64(body, a).to_bytes(8, "big"))
    mark.hexed = True
    tail = {**{k: v for k, v in trailer.items() if k not in STRUCTURAL and k != "ID"}, "Size": max(places, default=0) + 1, "ID": [mark, mark]}
    return body + b"".join(table) + b"trailer\n" + write_object(tail) + b"\nstartxref\n%d\n%%%%EOF\n" % len(body)


__all__ = ["FileFault", "flate_stored", "load", "write_file", "SPACE"]
