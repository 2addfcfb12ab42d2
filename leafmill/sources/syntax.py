"""PDF syntax: one regular expression finds tokens, a stack machine makes objects of them.

Objects are plain Python values: None, bool, int, float, Name, Str (bytes), list, dict, Ref and Stream.
Malformed input raises SyntaxFault; callers skip and go on, so that no file can fail a task.
"""

from __future__ import annotations

import re
from typing import NamedTuple

SPACE = b"\0\t\n\f\r "
DELIMITERS = b"()<>[]{}/%"
_I64 = 1 << 63


class SyntaxFault(ValueError):
    """Bytes that aren't PDF syntax."""


class Name(str):
    """A name, without its slash."""

    __slots__ = ()


class Str(bytes):
    """A string's bytes; `hexed` remembers how it was written."""

    hexed = False


class Ref(NamedTuple):
    num: int
    gen: int


class Keyword(str):
    """A bare word: an operator, obj, stream, R and so on."""

    __slots__ = ()


class Stream:
    """A dictionary and its encoded bytes."""

    __slots__ = ("dict", "data")

    def __init__(self, d: dict, data: bytes):
        self.dict, self.data = d, data

    def __eq__(self, other):
        return isinstance(other, Stream) and (self.dict, self.data) == (other.dict, other.data)

    def __repr__(self):
        return f"Stream({self.dict!r}, {len(self.data)} bytes)"


_TOKEN = re.compile(
    rb"(?P<blank>(?:[\x00\t\n\f\r ]+|%[^\r\n]*)+)"
    rb"|(?P<number>[+-]?[0-9.][0-9.]*|[+-]+[0-9.]+)(?=[\x00\t\n\f\r ()<>\[\]{}/%]|$)?"
    rb"|/(?P<name>[^\x00\t\n\f\r ()<>\[\]{}/%]*)"
    rb"|(?P<open><<|\[|\{)|(?P<close>>>|\]|\})"
    rb"|<(?P<hex>[^>]*)>?"
    rb"|(?P<string>\()"
    rb"|(?P<word>[^\x00\t\n\f\r ()<>\[\]{}/%]+)",
    re.S,
)
_NAME_HEX = re.compile(rb"#([0-9A-Fa-f]{2})")
_STRING_PART = re.compile(rb"[()\\\r]")
_PLAIN_STRING = re.compile(rb"([^()\\\r]*+(?:\\[^\r][^()\\\r]*+)*+)\)", re.S)
_BACKSLASH = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_OPEN, _CLOSE = {b"<<": "dict", b"[": "list", b"{": "list"}, {b">>": "dict", b"]": "list", b"}": "list"}


def number(raw: bytes) -> int | float:
    """`.5`, `4.`, `-.7` and `+3` are numbers; a whole number beyond 64 bits becomes a real; `1.2.3` isn't one."""
    text = raw.decode()
    if "." not in text:
        try:
            v = int(text)
        except ValueError:
            raise SyntaxFault(f"bad number {text!r}") from None
        return v if -_I64 <= v < _I64 else float(v)
    try:
        return float(text)
    except ValueError:
        raise SyntaxFault(f"bad number {text!r}") from None


def name(raw: bytes) -> Name:
    return Name(_NAME_HEX.sub(lambda m: bytes([int(m[1], 16)]), raw).decode("utf-8", "replace"))


def hex_string(raw: bytes) -> Str:
    digits = raw.translate(None, SPACE)
    if len(digits) % 2:
        digits += b"0"
    try:
        out = Str(bytes.fromhex(digits.decode("ascii")))
    except ValueError:
        raise SyntaxFault("bad hex string") from None
    out.hexed = True
    return out


def _unescape(m: re.Match) -> bytes:
    e = m[1]
    return bytes([int(e, 8) & 255]) if 48 <= e[0] <= 55 else b"" if e == b"\n" else _ESCAPES.get(e, e)


def literal_string(data: bytes, at: int) -> tuple[Str, int]:
    """String whose opening bracket stands before `at`; the end of the data closes an open one."""
    if m := _PLAIN_STRING.match(data, at):  # without inner brackets and carriage returns
        body = m[1]
        return Str(_BACKSLASH.sub(_unescape, body) if b"\\" in body else body), m.end()
    out, depth = bytearray(), 1
    while True:
        m = _STRING_PART.search(data, at)
        if not m:
            out += data[at:]
            return Str(bytes(out)), len(data)
        out += data[at : m.start()]
        at, c = m.end(), m[0]
        if c == b"(":
            depth += 1
            out += c
        elif c == b")":
            depth -= 1
            if not depth:
                return Str(bytes(out)), at
            out += c
        elif c == b"\r":  # any line end reads as one line feed
            out += b"\n"
            at += data[at : at + 1] == b"\n"
        else:
            e = data[at : at + 1]
            if e in _ESCAPES:
                out += _ESCAPES[e]
                at += 1
            elif e == b"\r" or e == b"\n":
                at += 2 if data[at : at + 2] == b"\r\n" else 1
            elif o := re.compile(rb"[0-7]{1,3}").match(data, at):
                out.append(int(o[0], 8) & 255)
                at = o.end()
            else:
                out += e
                at += 1


def tokens(data: bytes, at: int = 0):
    """(kind, value, start, end) from `at` on; kinds: value, open, close, word."""
    while at < len(data):
        m = _TOKEN.match(data, at)
        if not m:
            at += 1
            continue
        kind, start, at = m.lastgroup, at, m.end()
        if kind == "blank":
            continue
        if kind == "number":
            yield "value", number(m["number"]), start, at
        elif kind == "name":
            yield "value", name(m["name"]), start, at
        elif kind == "hex":
            yield "value", hex_string(m["hex"]), start, at
        elif kind == "string":
            value, at = literal_string(data, at)
            yield "value", value, start, at
        elif kind == "word":
            w = m["word"]
            if w == b"true" or w == b"false":
                yield "value", w == b"true", start, at
            elif w == b"null":
                yield "value", None, start, at
            else:
                yield "word", Keyword(w.decode("latin-1")), start, at
        else:
            yield kind, m[0], start, at


class _Open(list):
    """A container that isn't closed yet."""

    kind = "list"


def _finish(box: _Open, kind: str):
    if box.kind != kind:
        raise SyntaxFault("unlike brackets")
    if kind == "list":
        return list(box)
    out, i = {}, 0
    while i < len(box):
        if not isinstance(box[i], Name):
            raise SyntaxFault("a key isn't a name")
        out[box[i]] = box[i + 1] if i + 1 < len(box) else None
        i += 2
    return out


def parse_object(data: bytes, at: int = 0, depth_limit: int = 256) -> tuple[object, int]:
    """(object, end) at `at`; `n g R` becomes a Ref. A bare word is a fault."""
    stack: list[_Open] = []
    done: list = []
    for kind, value, start, end in tokens(data, at):
        into = stack[-1] if stack else done
        if kind == "value":
            into.append(value)
        elif kind == "open":
            if len(stack) >= depth_limit:
                raise SyntaxFault("nested too deeply")
            box = _Open()
            box.kind = _OPEN[value]
            stack.append(box)
            continue
        elif kind == "close":
            if not stack:
                raise SyntaxFault("nothing to close")
            box = stack.pop()
            (stack[-1] if stack else done).append(_finish(box, _CLOSE[value]))
        elif value == "R" and len(into) >= 2 and all(type(v) is int and v >= 0 for v in into[-2:]):
            into[-2:] = [Ref(into[-2], into[-1])]
        else:
            raise SyntaxFault(f"unexpected word {value!r}")
        if not stack and done:
            if type(done[-1]) is int and len(done) == 1 and (m := _REF_TAIL.match(data, end)):
                return Ref(done[0], int(m[1])), m.end()
            return done[0], end
    raise SyntaxFault("the data ends within an object")


_REF_TAIL = re.compile(rb"[\x00\t\n\f\r ]+([0-9]+)[\x00\t\n\f\r ]+R(?=[\x00\t\n\f\r ()<>\[\]{}/%]|$)")
_HEADER = re.compile(rb"[\x00\t\n\f\r ]*([0-9]+)[\x00\t\n\f\r ]+([0-9]+)[\x00\t\n\f\r ]+obj")
_STREAM = re.compile(rb"[\x00\t\n\f\r ]*stream(\r\n|\n|\r)?")
_ENDSTREAM = re.compile(rb"[\x00\t\n\f\r ]{0,4}endstream")


def parse_indirect(data: bytes, at: int, length_of=None) -> tuple[int, int, object, int]:
    """(num, gen, object, end) of an indirect object; a missing endobj is tolerated.

    length_of(ref) gives a referenced stream length or None. /Length counts only where endstream follows;
    else the stream ends before the next endstream, less one line end.
    """
    m = _HEADER.match(data, at)
    if not m:
        raise SyntaxFault("no object header")
    value, end = parse_object(data, m.end())
    if isinstance(value, dict) and (s := _STREAM.match(data, end)):
        begin, size = s.end(), value.get("Length")
        if isinstance(size, Ref):
            size = length_of(size) if length_of else None
        if type(size) is int and 0 <= size <= len(data) - begin and (e := _ENDSTREAM.match(data, begin + size)):
            value, end = Stream(value, data[begin : begin + size]), e.end()
        else:
            stop = data.find(b"endstream", begin)
            if stop < 0:
                raise SyntaxFault("a stream without an end")
            body = data[begin:stop]
            body = body[:-2] if body.endswith(b"\r\n") else body[:-1] if body[-1:] in (b"\n", b"\r") else body
            value, end = Stream(value, body), stop + 9
    return int(m[1]), int(m[2]), value, end
