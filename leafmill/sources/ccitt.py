"""CCITT fax data of groups 3 and 4: rows of alternating runs, coded alone or against the row above."""

from __future__ import annotations

from leafmill.sources.codecs import FilterFault

MAX_SIDE = 65_536

# Fixed values (ITU-T T.4): run codes for 0 .. 63 of each colour, then for 64, 128 .. 1728.
_WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101
011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011""".split()
_BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100
0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101""".split()
# Runs of 1792, 1856 .. 2560 share their codes.
_LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
_LENGTHS = [*range(64), *range(64, 1729, 64)]
_RUNS = [dict(zip(codes, _LENGTHS)) | dict(zip(_LONG, range(1792, 2561, 64))) for codes in (_WHITE, _BLACK)]
# How the end of a run moves against the row above: passed over, coded as two runs, or moved by -3 .. 3.
_MODES = {"0001": "pass", "001": "two", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}


class _End(Exception):
    """No more rows."""


class _Bits:
    def __init__(self, data: bytes):
        self.text, self.at = "".join(f"{b:08b}" for b in data), 0

    def code(self, table: dict, longest: int):
        for n in range(1, longest + 1):
            v = table.get(self.text[self.at : self.at + n])
            if v is not None and self.at + n <= len(self.text):
                self.at += n
                return v
        return None

    def starts(self, text: str) -> bool:
        return self.text.startswith(text, self.at)

    def run(self, color: int) -> int:
        total = 0
        while True:
            n = self.code(_RUNS[color], 13)
            if n is None:
                raise _End
            total += n
            if n < 64:
                return total

    def skip_eol(self) -> bool:
        """Take an end-of-line code with any fill before it."""
        one = self.text.find("1", self.at)
        if one - self.at >= 11:
            self.at = one + 1
            return True
        return False


def _one_dimension(bits: _Bits, columns: int) -> list[int]:
    """Places where the colour changes."""
    out, at, color = [], 0, 0
    while at < columns:
        at = min(columns, at + bits.run(color))
        out.append(at)
        color ^= 1
    return out


def _two_dimensions(bits: _Bits, above: list[int], columns: int) -> list[int]:
    out, at, color, first = [], 0, 0, True
    while at < columns:
        # the first change above, right of here, to the other colour than the one being painted
        k = next((i for i, x in enumerate(above) if i % 2 == color and (x > at or first and x == 0)), None)
        b1 = above[k] if k is not None else columns
        b2 = above[k + 1] if k is not None and k + 1 < len(above) else columns
        mode = bits.code(_MODES, 7)
        if mode is None:
            raise _End
        if mode == "pass":
            at, first = b2, False
            continue
        if mode == "two":
            for c in (color, color ^ 1):
                at = min(columns, at + bits.run(c))
                out.append(at)
        else:
            at = max(0, min(columns, b1 + mode))
            out.append(at)
            color ^= 1
        first = False
    return out


def decode(data: bytes, parms: dict) -> bytes:
    """Packed rows, one bit a pixel; black is 0 unless BlackIs1."""
    get = lambda k, d: parms.get(k) if isinstance(parms.get(k), (int, float)) else d
    k, columns, rows = get("K", 0), int(get("Columns", 1728)), int(get("Rows", 0))
    aligned, black_one = parms.get("EncodedByteAlign") is True, parms.get("BlackIs1") is True
    if not 0 < columns <= MAX_SIDE or not 0 <= rows <= MAX_SIDE:
        raise FilterFault("fax size")
    bits, above, out = _Bits(data), [], []
    while (not rows or len(out) < rows) and bits.at < len(bits.text):
        if aligned:
            bits.at = -(-bits.at // 8) * 8
        try:
            if k < 0:
                if bits.starts("000000000001"):
                    break
                line = _two_dimensions(bits, above, columns)
            else:
                ends = 0
                while bits.skip_eol():
                    ends += 1
                    flat = not k or bits.text[bits.at : bits.at + 1] == "1"
                    bits.at += bool(k)
                if ends > 1 and out or bits.at >= len(bits.text):
                    break
                line = _one_dimension(bits, columns) if not k or not ends or flat else _two_dimensions(bits, above, columns)
        except _End:
            break
        out.append(line)
        above = line
        if len(out) > MAX_SIDE:
            raise FilterFault("fax size")
    row_bytes, packed = -(-columns // 8), []
    for line in out:
        value, color, at = 0, 0, 0
        for x in [*line, columns]:
            if color and x > at:
                value |= ((1 << (x - at)) - 1) << (row_bytes * 8 - x)
            at, color = max(at, x), color ^ 1
        full = (1 << row_bytes * 8) - 1
        packed.append((value if black_one else full ^ value).to_bytes(row_bytes, "big"))
    blank = (b"\0" if black_one else b"\xff") * row_bytes
    return b"".join(packed) + blank * max(0, rows - len(packed))
