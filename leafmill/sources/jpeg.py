"""JPEG: baseline and progressive Huffman files of 8 bits, to arrays of samples in their colour space's order."""

from __future__ import annotations

import math

import numpy as np

from leafmill.sources.codecs import FilterFault

MAX_PIXELS = 1 << 28


def _zigzag() -> list[int]:
    """Places of the coefficients along the anti-diagonals."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return [8 * y + x for y, x in cells]


ZIGZAG = _zigzag()
_K = np.arange(8)
#: Basis of the inverse cosine transform: rows are samples, columns frequencies.
BASIS = np.cos((2 * _K[:, None] + 1) * _K[None, :] * math.pi / 16) * np.where(_K == 0, math.sqrt(1 / 8), 0.5)[None, :]


class _Bits:
    """Bits of entropy-coded data, stuffing taken out; zeros follow the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, k: int) -> None:
        while self.n < k:
            b = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
            self.held = (self.held << 8 | b) & 0xFFFFFFFF
            self.n += 8

    def get(self, k: int) -> int:
        if not k:
            return 0
        self.need(k)
        self.n -= k
        return self.held >> self.n & ((1 << k) - 1)

    def signed(self, k: int) -> int:
        v = self.get(k)
        return v if not k or v >> (k - 1) else v - (1 << k) + 1


class _Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.map, code, at = {}, 0, 0
        for size, n in enumerate(counts, 1):
            for _ in range(n):
                self.map[size, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1

    def read(self, bits: _Bits) -> int:
        code = 0
        for size in range(1, 17):
            code = code << 1 | bits.get(1)
            v = self.map.get((size, code))
            if v is not None:
                return v
        raise FilterFault("bad JPEG code")


class _Part:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.id, self.h, self.v, self.table, self.pred = ident, h, v, table, 0


class _Decoder:
    def __init__(self, data: bytes):
        self.data, self.tables, self.huff = data, {}, {}
        self.parts, self.restart, self.adobe, self.progressive = [], 0, None, False
        self.eob = 0

    def run(self) -> np.ndarray:
        d, at = self.data, 2
        if d[:2] != b"\xff\xd8":
            raise FilterFault("not a JPEG")
        while at + 4 <= len(d):
            if d[at] != 0xFF:
                at += 1
                continue
            m = d[at + 1]
            at += 2
            if m == 0xD9:
                break
            if m in (0xFF, 0, 1) or 0xD0 <= m <= 0xD8:
                at -= m == 0xFF
                continue
            size = int.from_bytes(d[at : at + 2], "big")
            body = d[at + 2 : at + size]
            at += size
            if m in (0xC0, 0xC1, 0xC2):
                self.frame(body, m == 0xC2)
            elif m == 0xC4:
                while len(body) >= 17:
                    n = sum(body[1:17])
                    self.huff[body[0] >> 4, body[0] & 15] = _Huffman(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif m == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    self.tables[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif m == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif m == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif m == 0xDA:
                at = self.scan(body, at)
            elif 0xC3 <= m <= 0xCF:
                raise FilterFault("this kind of JPEG is not supported")
        if not self.parts:
            raise FilterFault("no JPEG frame")
        return self.picture()

    def frame(self, b: bytes, progressive: bool) -> None:
        if b[0] != 8:
            raise FilterFault("only 8 bits")
        self.h, self.w, self.progressive = int.from_bytes(b[1:3], "big"), int.from_bytes(b[3:5], "big"), progressive
        if not self.h or not self.w or self.h * self.w > MAX_PIXELS:
            raise FilterFault("JPEG size")
        self.parts = [_Part(b[6 + 3 * i], b[7 + 3 * i] >> 4, b[7 + 3 * i] & 15, b[8 + 3 * i]) for i in range(b[5])]
        if not self.parts or any(not 1 <= p.h <= 4 or not 1 <= p.v <= 4 for p in self.parts):
            raise FilterFault("JPEG sampling")
        self.hm, self.vm = max(p.h for p in self.parts), max(p.v for p in self.parts)
        self.mx, self.my = -(-self.w // (8 * self.hm)), -(-self.h // (8 * self.vm))
        for p in self.parts:
            p.coef = np.zeros((self.my * p.v, self.mx * p.h, 64), np.int32)
            p.bw, p.bh = -(-self.w * p.h // (8 * self.hm)), -(-self.h * p.v // (8 * self.vm))

    def scan(self, b: bytes, at: int) -> int:
        d, n = self.data, b[0]
        own = []
        for i in range(n):
            p = next((q for q in self.parts if q.id == b[1 + 2 * i]), None)
            if p is None:
                raise FilterFault("JPEG scan")
            p.dc, p.ac = b[2 + 2 * i] >> 4, b[2 + 2 * i] & 15
            own.append(p)
        lo, hi, high, low = b[1 + 2 * n], b[2 + 2 * n], b[3 + 2 * n] >> 4, b[3 + 2 * n] & 15
        if not self.progressive:
            lo, hi, high, low = 0, 63, 0, 0
        chunks, start, end = [], at, at
        while end + 1 < len(d):
            end = d.find(b"\xff", end)
            if end < 0 or end + 1 >= len(d):
                end = len(d)
                break
            m = d[end + 1]
            if 0xD0 <= m <= 0xD7:
                chunks.append(d[start:end])
                start = end = end + 2
            elif m in (0, 0xFF):
                end += 2 - (m == 0xFF)
            else:
                break
        chunks.append(d[start:end])
        if n == 1:
            p = own[0]
            units = [[(p, i // p.bw, i % p.bw)] for i in range(p.bw * p.bh)]
        else:
            units = [[(p, my * p.v + y, mx * p.h + x) for p in own for y in range(p.v) for x in range(p.h)] for my in range(self.my) for mx in range(self.mx)]
        step = self.restart or len(units)
        for k, raw in enumerate(chunks):
            bits, self.eob = _Bits(raw.replace(b"\xff\0", b"\xff")), 0
            for p in own:
                p.pred = 0
            try:
                for unit in units[k * step : (k + 1) * step]:
                    for p, y, x in unit:
                        self.block(bits, p, p.coef[y, x], lo, hi, high, low)
            except (FilterFault, KeyError):
                break
        return end

    def block(self, bits: _Bits, p: _Part, c: np.ndarray, lo: int, hi: int, high: int, low: int) -> None:
        if not self.progressive or lo == 0:
            if high:
                if bits.get(1):
                    c[0] |= 1 << low
            else:
                p.pred += bits.signed(self.huff[0, p.dc].read(bits))
                c[0] = p.pred << low
            if self.progressive:
                return
            lo = 1
        (self.refine if high else self.first)(bits, p, c, lo, hi, low)

    def first(self, bits, p, c, k, hi, low) -> None:
        if self.eob:
            self.eob -= 1
            return
        huff = self.huff[1, p.ac]
        while k <= hi:
            v = huff.read(bits)
            run, size = v >> 4, v & 15
            if size:
                k += run
                if k > 63:
                    return
                c[ZIGZAG[k]] = bits.signed(size) << low
                k += 1
            elif run == 15:
                k += 16
            else:
                self.eob = (1 << run) - 1 + bits.get(run) if self.progressive else 0
                return

    def refine(self, bits, p, c, k, hi, low) -> None:
        """Correction bits for coefficients that are there already, new ones of size one between them."""
        one, huff = 1 << low, self.huff[1, p.ac]

        def correct(z):
            if bits.get(1) and not abs(int(c[z])) & one:
                c[z] += one if c[z] > 0 else -one

        while k <= hi and not self.eob:
            v = huff.read(bits)
            run, value = v >> 4, 0
            if v & 15:
                value = one if bits.get(1) else -one
            elif run < 15:
                self.eob = (1 << run) + bits.get(run)
                break
            while k <= hi:
                z = ZIGZAG[k]
                k += 1
                if c[z]:
                    correct(z)
                elif run:
                    run -= 1
                else:
                    c[z] = value
                    break
        if self.eob:
            while k <= hi:
                if c[ZIGZAG[k]]:
                    correct(ZIGZAG[k])
                k += 1
            self.eob -= 1

    def picture(self) -> np.ndarray:
        planes = []
        for p in self.parts:
            q = np.ones(64, np.int64)
            q[ZIGZAG] = self.tables.get(p.table, np.ones(64, np.int64))
            blocks = (p.coef * q).reshape(*p.coef.shape[:2], 8, 8).astype(np.float64)
            px = np.einsum("ij,abjk,lk->abil", BASIS, blocks, BASIS, optimize=True) + 128
            h, w = p.coef.shape[:2]
            plane = np.clip(np.floor(px.transpose(0, 2, 1, 3).reshape(h * 8, w * 8) + 0.5), 0, 255)
            plane = plane[: -(-self.h * p.v // self.vm), : -(-self.w * p.h // self.hm)]
            planes.append(_stretch(plane, self.h, self.w, p.v / self.vm, p.h / self.hm))
        return self.colors(np.stack(planes, -1))

    def colors(self, x: np.ndarray) -> np.ndarray:
        n = x.shape[-1]
        if n == 3 and self.adobe != 0 and not (self.adobe is None and bytes(p.id for p in self.parts) == b"RGB"):
            x = _rgb(x)
        elif n == 4:
            if self.adobe == 2:
                x = np.concatenate([_rgb(x[..., :3]), x[..., 3:]], -1)
            if self.adobe is not None:  # such files hold inverted inks
                x = 255 - x
        return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def _rgb(x: np.ndarray) -> np.ndarray:
    y, cb, cr = x[..., 0], x[..., 1] - 128, x[..., 2] - 128
    return np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)


def _stretch(plane: np.ndarray, h: int, w: int, fy: float, fx: float) -> np.ndarray:
    """A plane at full size, with bilinear samples between those of a smaller one."""
    if fy == 1 and fx == 1:
        return plane[:h, :w]
    y = np.clip((np.arange(h) + 0.5) * fy - 0.5, 0, plane.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * fx - 0.5, 0, plane.shape[1] - 1)
    iy, ix = y.astype(int), x.astype(int)
    jy, jx = np.minimum(iy + 1, plane.shape[0] - 1), np.minimum(ix + 1, plane.shape[1] - 1)
    ty, tx = (y - iy)[:, None], (x - ix)[None, :]
    rows = plane[iy] * (1 - ty) + plane[jy] * ty
    return rows[:, ix] * (1 - tx) + rows[:, jx] * tx


def decode_jpeg(data: bytes) -> np.ndarray:
    """(height, width, components) of uint8: grey, RGB or CMYK."""
    try:
        return _Decoder(data).run()
    except (IndexError, KeyError) as e:
        raise FilterFault(f"broken JPEG: {e}") from None
