"""JBIG2 against the coder's published test sequence and a small encoder."""

import numpy as np
import pytest

from leafmill.sources import jbig2 as J
from leafmill.sources.codecs import FilterFault, decode_stream
from leafmill.sources.syntax import Name, Stream


class Encoder:
    """The MQ encoder, to make inputs."""

    def __init__(self):
        self.a, self.c, self.ct, self.out = 0x8000, 0, 12, [0]

    def _byte(self):
        if self.out[-1] == 0xFF or self.c >= 0x8000000 and self._carry():
            self.out.append(self.c >> 20 & 0xFF)
            self.c, self.ct = self.c & 0xFFFFF, 7
        else:
            self.out.append(self.c >> 19 & 0xFF)
            self.c, self.ct = self.c & 0x7FFFF, 8

    def _carry(self):
        self.out[-1] += 1
        self.c &= 0x7FFFFFF
        return self.out[-1] == 0xFF

    def bit(self, cx, i, d):
        state, mps = cx[i] >> 1, cx[i] & 1
        qe, up, down, switch = J._QE[state]
        self.a -= qe
        if d == mps:
            if self.a & 0x8000:
                self.c += qe
                return
            if self.a < qe:
                self.a = qe
            else:
                self.c += qe
            cx[i] = up << 1 | mps
        else:
            if self.a < qe:
                self.c += qe
            else:
                self.a = qe
            cx[i] = down << 1 | mps ^ switch
        while True:
            self.a, self.c, self.ct = self.a << 1, self.c << 1, self.ct - 1
            if not self.ct:
                self._byte()
            if self.a & 0x8000:
                return

    def finish(self):
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self._byte()
        return bytes(self.out[1:]) + b"\xff\xac"


def test_published_sequence():
    coded = bytes.fromhex("84C73BFCE1A14304022000 00410DBB86F4317FFF88FF37471ADB6ADFFFAC")
    want = bytes.fromhex("00020051000000C0035287 2AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF")
    mq, cx = J.Arithmetic(coded), [0]
    bits = "".join(str(mq.bit(cx, 0)) for _ in range(256))
    assert int(bits, 2).to_bytes(32, "big") == want


def _generic(px, template, at):
    enc, cx = Encoder(), [0] * 65536
    near = [at[int(p[1])] if isinstance(p, str) else p for p in J._TEMPLATES[template]]
    h, w = px.shape
    for y in range(h):
        for x in range(w):
            c = 0
            for dx, dy in near:
                c = c << 1 | (int(px[y + dy, x + dx]) if 0 <= y + dy and 0 <= x + dx < w else 0)
            enc.bit(cx, c, int(px[y, x]))
    return enc.finish()


def _segment(number, kind, body):
    return number.to_bytes(4, "big") + bytes([kind, 0, 1]) + len(body).to_bytes(4, "big") + body


def _u4(*v):
    return b"".join(x.to_bytes(4, "big") for x in v)


AT = [(3, -1), (-3, -1), (2, -2), (-2, -2)]


@pytest.mark.parametrize("template", [0, 1, 2, 3])
def test_generic_region(template):
    rng = np.random.default_rng(template)
    px = (np.add.outer(np.arange(20), np.arange(30)) // 5 % 2 ^ (rng.random((20, 30)) < 0.05)).astype(np.uint8)
    at = AT if template == 0 else [(3 if template == 1 else 2, -1)]
    body = _u4(30, 20, 2, 1) + b"\0" + bytes([template << 1]) + b"".join(bytes([a & 255, b & 255]) for a, b in at) + _generic(px, template, at)
    data = _segment(1, 48, _u4(36, 24, 0, 0) + b"\0\0\0") + _segment(2, 38, body)
    got = np.unpackbits(np.frombuffer(decode_stream(Stream({Name("Filter"): Name("JBIG2Decode")}, data)), np.uint8).reshape(24, -1), axis=1)[:, :36]
    want = np.zeros((24, 36), np.uint8)
    want[1:21, 2:32] = px
    assert (got == 1 - want).all()


def test_combinations_and_faults():
    page, part = np.array([[0, 0, 1, 1]], np.uint8), np.array([[0, 1, 0, 1]], np.uint8)
    for how, want in enumerate(([0, 1, 1, 1], [0, 0, 0, 1], [0, 1, 1, 0], [1, 0, 0, 1], [0, 1, 0, 1])):
        p = page.copy()
        J.combine(p, part, 0, 0, how)
        assert p[0].tolist() == want
    with pytest.raises(FilterFault):
        J.decode(b"", {})
    with pytest.raises(FilterFault):
        J.decode(_segment(1, 38, _u4(8, 8, 0, 0) + b"\0\0" + b"\3\xff" * 4), {})
