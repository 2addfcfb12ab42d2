"""Stream filters: decoders by name, predictors, and the chain that a stream's dictionary describes."""

from __future__ import annotations

import re
import zlib

import numpy as np

from leafmill.sources.syntax import SPACE, Name, Stream


class FilterFault(ValueError):
    """A stream that can't be decoded."""


def flate(data: bytes, parms: dict | None = None) -> bytes:
    """Inflate. Bytes without a valid header are read as a bare deflate stream; the checksum isn't looked at."""
    head = len(data) >= 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0
    if head and data[1] & 32:
        raise FilterFault("preset dictionaries aren't supported")
    d = zlib.decompressobj(-15)
    try:
        return predict(d.decompress(data[2:] if head else data) + d.flush(), parms)
    except zlib.error as e:
        raise FilterFault(str(e)) from None


def flate_stored(data: bytes) -> bytes:
    """A zlib stream of stored blocks."""
    blocks = [data[i : i + 65535] for i in range(0, len(data), 65535)] or [b""]
    body = b"".join(bytes([i == len(blocks) - 1]) + len(b).to_bytes(2, "little") + (len(b) ^ 0xFFFF).to_bytes(2, "little") + b for i, b in enumerate(blocks))
    return b"\x78\x01" + body + zlib.adler32(data).to_bytes(4, "big")


def lzw(data: bytes, parms: dict | None = None) -> bytes:
    """LZW, high bits first; codes grow one entry early unless EarlyChange is 0."""
    early = int((parms or {}).get("EarlyChange", 1) != 0)
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    out, last, width, at, end = [], b"", 9, 0, 8 * len(data)
    d = np.frombuffer(data + b"\0\0", np.uint8).astype(np.uint32)
    seen = d[:-2] << 16 | d[1:-1] << 8 | d[2:]
    while at + width <= end:
        # how many codes have this width follows from the table's size, so they are cut out together
        n = (1 << width) - early - len(table) + (not last) if width < 12 else 4096
        places = at + width * np.arange(min(n, (end - at) // width))
        codes = seen[places >> 3] >> (24 - width - (places & 7)).astype(np.uint32) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        upto = int(stops[0]) if len(stops) else len(codes)
        run, at = codes[:upto], at + width * (upto + bool(len(stops)))
        if len(stops) and (not upto or run.max() < 256):  # single bytes; what they add to the table goes at once
            out.append(run.astype(np.uint8).tobytes())
        else:
            for code in run.tolist():
                if code < len(table):
                    entry = table[code]
                elif code == len(table) and last:
                    entry = last + last[:1]
                else:
                    raise FilterFault(f"LZW code {code} is not known")
                out.append(entry)
                if last and len(table) < 4096:
                    table.append(last + entry[:1])
                last = entry
        if len(stops):
            if codes[upto] == 257:
                break
            del table[258:]
            last, width = b"", 9
            continue
        n = len(table) + early
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    return predict(b"".join(out), parms)


def ascii_hex(data: bytes, parms: dict | None = None) -> bytes:
    """Hex digits up to `>`; a missing last digit is 0."""
    digits = data.split(b">")[0].translate(None, SPACE)
    if re.search(rb"[^0-9A-Fa-f]", digits):
        raise FilterFault("not a hex digit")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii_85(data: bytes, parms: dict | None = None) -> bytes:
    """Base 85 up to `~>`; `z` is four zeros; a single left-over digit is a fault."""
    body = data.translate(None, SPACE)
    body = (body[2:] if body.startswith(b"<~") else body).split(b"~")[0]
    out, group = bytearray(), []
    for c in body:
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += _base85(group)
                group = []
        else:
            raise FilterFault("not a base 85 digit")
    if len(group) == 1:
        raise FilterFault("a single digit is left over")
    if group:
        out += _base85(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _base85(group: list[int]) -> bytes:
    value = 0
    for d in group:
        value = value * 85 + d
    if value >> 32:
        raise FilterFault("base 85 group is too large")
    return value.to_bytes(4, "big")


def run_length(data: bytes, parms: dict | None = None) -> bytes:
    """Runs: up to 127 says so many bytes and one follow, above 128 says the next repeats 257 - n times."""
    out, i = [], 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += n + 2
        else:
            out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
    return b"".join(out)


def predict(data: bytes, parms: dict | None) -> bytes:
    """Undo a predictor: 2 is TIFF's (8 bits a component), 10 and above PNG's, chosen by each row's first byte."""
    kind = int((parms or {}).get("Predictor", 1) or 1)
    if kind < 2:
        return data
    colors, bits, columns = (max(1, int(parms.get(k) or d)) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    step, width = max(1, colors * bits // 8), -(-colors * bits * columns // 8)
    if kind == 2:
        if bits != 8:
            raise FilterFault("TIFF prediction needs 8 bits a component")
        whole = len(data) // width * width
        rows = np.frombuffer(data[:whole], np.uint8).reshape(-1, columns, colors)
        rest = np.frombuffer(data[whole:], np.uint8)
        tail = rest.copy()
        for i in range(colors, len(tail)):
            tail[i] += tail[i - colors]
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes() + tail.tobytes()
    return _png(data, width, step)


def _png(data: bytes, width: int, step: int) -> bytes:
    """PNG prediction undone along slanted lines: a pixel needs those to its left and above, so that all pixels
    whose column and rows since the last independent row add up to the same number are made at once."""
    n, across = -(-len(data) // (width + 1)), -(-width // step)
    lines = np.frombuffer(data.ljust(n * (width + 1), b"\0"), np.uint8).reshape(n, width + 1)
    how = lines[:, 0]
    if n and how.max() > 4:
        raise FilterFault(f"PNG row filter {how[how > 4][0]}")
    raw = np.pad(lines[:, 1:], ((0, 0), (0, across * step - width))).reshape(n, across, step).astype(np.int16)
    rows = np.arange(n)
    free = np.maximum.accumulate(np.where(how < 2, rows, 0))
    begin = rows - free  # rows since the last one that looks at none above
    order = np.argsort(begin, kind="stable")
    sorted_begin = begin[order]
    made = np.zeros((n + 1, across + 1, step), np.int16)  # a pixel stands one row and one column on
    for t in range(int(begin.max(initial=-1)) + across if n else 0):
        r = order[np.searchsorted(sorted_begin, t - across, "right") : np.searchsorted(sorted_begin, t, "right")]
        c, kind = t - begin[r], how[r][:, None]
        left, up, corner = made[r + 1, c], made[r, c + 1], made[r, c]
        p = left + up - corner
        a, b, z = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((a <= b) & (a <= z), left, np.where(b <= z, up, corner))
        made[r + 1, c + 1] = raw[r, c] + np.choose(kind, [np.zeros_like(left), left, up, left + up >> 1, paeth]) & 255
    out = made[1:, 1:].reshape(n, across * step)[:, :width].astype(np.uint8).tobytes()
    return out[: len(data) - n]


def _lazy(module: str):
    def decode(data: bytes, parms: dict | None = None) -> bytes:
        from importlib import import_module

        return import_module(f"leafmill.sources.{module}").decode(data, parms or {})

    return decode


FILTERS = {
    "FlateDecode": flate, "Fl": flate, "LZWDecode": lzw, "LZW": lzw, "ASCIIHexDecode": ascii_hex, "AHx": ascii_hex,
    "ASCII85Decode": ascii_85, "A85": ascii_85, "RunLengthDecode": run_length, "RL": run_length,
    "CCITTFaxDecode": _lazy("ccitt"), "CCF": _lazy("ccitt"), "JBIG2Decode": _lazy("jbig2"),
    "Crypt": lambda data, parms=None: data,
}


def chain(d: dict, resolve=lambda x: x) -> list[tuple[str, dict | None]]:
    """(filter, parameters) in order; one bare dictionary of parameters belongs to the first filter."""
    names, parms = resolve(d.get("Filter", d.get("F"))), resolve(d.get("DecodeParms", d.get("DP")))
    names = [names] if isinstance(names, Name) else [resolve(n) for n in names] if isinstance(names, list) else []
    parms = [parms] if isinstance(parms, dict) else [resolve(p) for p in parms] if isinstance(parms, list) else []
    own = lambda p: {k: resolve(v) for k, v in p.items()} if isinstance(p, dict) else None
    return [(str(n), own(parms[i]) if i < len(parms) else None) for i, n in enumerate(names)]


def decode_stream(s: Stream, resolve=lambda x: x, upto: tuple = ()) -> bytes:
    """Bytes of a stream through all its filters; stops before a filter in `upto`."""
    data = s.data
    for name, parms in chain(s.dict, resolve):
        if name in upto:
            return data
        if name not in FILTERS:
            raise FilterFault(f"filter {name} is not supported")
        data = FILTERS[name](data, parms)
    return data
