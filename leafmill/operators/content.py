"""Content streams: operations in order, read from bytes and written back."""

from __future__ import annotations

import re
from typing import NamedTuple

from leafmill.sources.files import write_name, write_object
from leafmill.sources.syntax import SPACE, Name, SyntaxFault, _Open, _OPEN, _CLOSE, _finish, tokens

_SHORT = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "F": "Filter", "DP": "DecodeParms", "D": "Decode", "IM": "ImageMask", "I": "Interpolate"}
_SPACES = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}
_PARTS = {"DeviceGray": 1, "G": 1, "DeviceRGB": 3, "RGB": 3, "DeviceCMYK": 4, "CMYK": 4, "Indexed": 1, "I": 1}
_EI = re.compile(rb"(?<=[\x00\t\n\f\r ])EI(?=[\x00\t\n\f\r ()<>\[\]{}/%]|$)")


class Op(NamedTuple):
    operator: str
    operands: list


def parse_content(data: bytes) -> list[Op]:
    """Operations of a content stream. Bytes that can't be read are skipped and drop the operands before them."""
    out: list[Op] = []
    at, held, stack = 0, [], []
    while at < len(data):
        begin = at
        try:
            for kind, value, start, end in tokens(data, at):
                at = end
                into = stack[-1] if stack else held
                if kind == "value":
                    into.append(value)
                elif kind == "open":
                    box = _Open()
                    box.kind = _OPEN[value]
                    stack.append(box)
                elif kind == "close":
                    if stack:
                        box = stack.pop()
                        (stack[-1] if stack else held).append(_finish(box, _CLOSE[value]))
                    else:
                        held = []
                elif stack:
                    into.append(value)
                elif value == "BI":
                    op, at = _inline_image(data, end)
                    out.append(op)
                    held = []
                    break
                else:
                    out.append(Op(str(value), held))
                    held = []
            else:
                return out
        except SyntaxFault:
            held, stack = [], []
            at = max(at, begin) + 1
    return out


def _inline_image(data: bytes, at: int) -> tuple[Op, int]:
    """BI dictionary ID bytes EI: without a filter the length follows from the dictionary, else EI is looked for."""
    d, key = {}, None
    stack: list[_Open] = []
    for kind, value, start, end in tokens(data, at):
        at = end
        if kind == "word":
            if value == "ID":
                break
            raise SyntaxFault("inline image without data")
        if kind == "open":
            box = _Open()
            box.kind = _OPEN[value]
            stack.append(box)
            continue
        if kind == "close":
            if not stack:
                raise SyntaxFault("nothing to close")
            box = stack.pop()
            value = _finish(box, _CLOSE[value])
        if stack:
            stack[-1].append(value)
        elif key is None:
            if not isinstance(value, Name):
                raise SyntaxFault("a key isn't a name")
            key = Name(_SHORT.get(value, value))
        else:
            d[key] = Name(_SPACES[value]) if key == "ColorSpace" and isinstance(value, Name) and value in _SPACES else value
            key = None
    at += data[at : at + 1] in [bytes([c]) for c in SPACE]
    size = _inline_size(d)
    if size is not None and (m := re.compile(rb"[\x00\t\n\f\r ]*EI").match(data, at + size)):
        return Op("BI", [d, data[at : at + size]]), m.end()
    m = _EI.search(data, at)
    if not m:
        return Op("BI", [d, data[at:]]), len(data)
    return Op("BI", [d, data[at : m.start() - 1]]), m.end()


def _inline_size(d: dict) -> int | None:
    if "Filter" in d:
        return None
    w, h = d.get("Width"), d.get("Height")
    if type(w) is not int or type(h) is not int or w < 0 or h < 0:
        return None
    space = d.get("ColorSpace", Name("DeviceGray"))
    parts = 1 if d.get("ImageMask") is True else _PARTS.get(space[0] if isinstance(space, list) and space else space)
    bits = 1 if d.get("ImageMask") is True else d.get("BitsPerComponent", 8)
    return None if parts is None or type(bits) is not int else -(-w * parts * bits // 8) * h


def write_content(ops: list[Op]) -> bytes:
    out = []
    for op in ops:
        if op.operator == "BI":
            d, raw = op.operands
            out.append(b"BI " + b" ".join(write_name(k) + b" " + write_object(v) for k, v in d.items()) + b" ID " + raw + b"\nEI\n")
        else:
            out.append(b" ".join([*map(write_object, op.operands), op.operator.encode("latin-1")]) + b"\n")
    return b"".join(out)
