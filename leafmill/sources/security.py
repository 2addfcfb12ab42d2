"""The standard security handler: file keys of revisions 2 to 6, RC4 and AES, decryption of loaded objects."""

from __future__ import annotations

import ctypes
import hashlib

from leafmill.sources.syntax import Name, Ref, Str, Stream

# Fixed value: the padding string of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def _library():
    """The libcrypto that Python's hashlib stands on, if it has the plain ciphers and gives what they should; else None."""
    for name in ("libcrypto.so.3", "libcrypto.so.1.1"):
        try:
            lib = ctypes.CDLL(name)
            for f in (lib.RC4_set_key, lib.RC4, lib.AES_set_encrypt_key, lib.AES_set_decrypt_key, lib.AES_cbc_encrypt):
                f.restype = ctypes.c_int
            lib.RC4.argtypes = [ctypes.c_char_p, ctypes.c_size_t, ctypes.c_char_p, ctypes.c_char_p]
            lib.AES_cbc_encrypt.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t, ctypes.c_char_p, ctypes.c_char_p, ctypes.c_int]
            block, key = bytes.fromhex("00112233445566778899aabbccddeeff"), bytes(range(16))
            sealed = bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a")
            if _library_rc4(lib, b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and _library_cbc(lib, key, block, bytes(16), True) == sealed and _library_cbc(lib, key, sealed, bytes(16), False) == block:
                return lib
        except (OSError, AttributeError):
            continue
    return None


def _library_rc4(lib, key: bytes, data: bytes) -> bytes:
    state, out = ctypes.create_string_buffer(2048), ctypes.create_string_buffer(len(data) or 1)
    lib.RC4_set_key(state, len(key), key)
    lib.RC4(state, len(data), data, out)
    return out.raw[: len(data)]


def _library_cbc(lib, key: bytes, data: bytes, iv: bytes, seal: bool) -> bytes:
    state, out = ctypes.create_string_buffer(1024), ctypes.create_string_buffer(len(data) or 1)
    (lib.AES_set_encrypt_key if seal else lib.AES_set_decrypt_key)(key, 8 * len(key), state)
    lib.AES_cbc_encrypt(data, out, len(data), state, ctypes.create_string_buffer(iv, 16), int(seal))
    return out.raw[: len(data)]


_LIB = _library()


def rc4(key: bytes, data: bytes) -> bytes:
    return _library_rc4(_LIB, bytes(key), bytes(data)) if _LIB and 1 <= len(key) <= 256 else plain_rc4(key, data)


def plain_rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _gf(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 128 else 0)
        b >>= 1
    return out


def _sbox() -> tuple[list[int], list[int]]:
    """S-box from its rule: the inverse in GF(2^8), then an affine map."""
    box = [0] * 256
    for x in range(256):
        inv = next((y for y in range(256) if _gf(x, y) == 1), 0)
        v = 0x63
        for k in range(5):
            v ^= (inv << k | inv >> 8 - k) & 255
        box[x] = v
    back = [0] * 256
    for x, v in enumerate(box):
        back[v] = x
    return box, back


SBOX, INVERSE = _sbox()
_BY = {m: [_gf(x, m) for x in range(256)] for m in (2, 3, 9, 11, 13, 14)}


class Aes:
    """AES of 128, 192 or 256 bits, one block at a time."""

    def __init__(self, key: bytes):
        n = len(key) // 4
        words, rcon = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
        self.rounds = n + 6
        for i in range(n, 4 * (self.rounds + 1)):
            w = list(words[-1])
            if i % n == 0:
                w = [SBOX[c] for c in w[1:] + w[:1]]
                w[0] ^= rcon
                rcon = _gf(rcon, 2)
            elif n > 6 and i % n == 4:
                w = [SBOX[c] for c in w]
            words.append([a ^ b for a, b in zip(words[i - n], w)])
        self.keys = [sum(words[4 * r : 4 * r + 4], []) for r in range(self.rounds + 1)]

    def encrypt_block(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.keys[0])]
        for r in range(1, self.rounds + 1):
            s = [SBOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if r < self.rounds:
                s = [_BY[2][s[c + k]] ^ _BY[3][s[c + (k + 1) % 4]] ^ s[c + (k + 2) % 4] ^ s[c + (k + 3) % 4] for c in (0, 4, 8, 12) for k in range(4)]
            s = [a ^ b for a, b in zip(s, self.keys[r])]
        return bytes(s)

    def decrypt_block(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.keys[self.rounds])]
        for r in range(self.rounds - 1, -1, -1):
            s = [INVERSE[s[(i - 4 * (i % 4)) % 16]] for i in range(16)]
            s = [a ^ b for a, b in zip(s, self.keys[r])]
            if r:
                s = [_BY[14][s[c + k]] ^ _BY[11][s[c + (k + 1) % 4]] ^ _BY[13][s[c + (k + 2) % 4]] ^ _BY[9][s[c + (k + 3) % 4]] for c in (0, 4, 8, 12) for k in range(4)]
        return bytes(s)


def cbc_decrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    if _LIB and len(key) in (16, 24, 32) and len(iv) == 16:
        return _library_cbc(_LIB, bytes(key), bytes(data[: len(data) // 16 * 16]), bytes(iv), False)
    return plain_cbc_decrypt(key, data, iv)


def cbc_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    if _LIB and len(key) in (16, 24, 32) and len(iv) == 16 and len(data) % 16 == 0:
        return _library_cbc(_LIB, bytes(key), bytes(data), bytes(iv), True)
    return plain_cbc_encrypt(key, data, iv)


def plain_cbc_decrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    aes, out = Aes(key), []
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        out.append(bytes(a ^ b for a, b in zip(aes.decrypt_block(block), iv)))
        iv = block
    return b"".join(out)


def plain_cbc_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    aes, out = Aes(key), []
    for i in range(0, len(data), 16):
        iv = aes.encrypt_block(bytes(a ^ b for a, b in zip(data[i : i + 16], iv)))
        out.append(iv)
    return b"".join(out)


def aes_open(key: bytes, data: bytes) -> bytes:
    """CBC with the IV in front and PKCS padding; data that isn't so stays as it is."""
    if len(data) < 32 or len(data) % 16:
        return b"" if len(data) == 16 else data
    out = cbc_decrypt(key, data[16:], data[:16])
    n = out[-1]
    return out[:-n] if 1 <= n <= 16 and out.endswith(bytes([n]) * n) else data


def aes_seal(key: bytes, data: bytes, iv: bytes) -> bytes:
    n = 16 - len(data) % 16
    return iv + cbc_encrypt(key, data + bytes([n]) * n, iv)


def hash_r6(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    """Revision 6 hash: rounds of AES over repeated input choose the next SHA-2, 64 at least."""
    k, i = hashlib.sha256(password + salt + user).digest(), 0
    while True:
        e = cbc_encrypt(k[:16], (password + k + user) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32 or i >= 1024:
            return k[:32]


class Handler:
    """Key and methods of one file."""

    def __init__(self, d: dict, file_id: bytes, password: bytes = b""):
        from leafmill.sources.files import FileFault

        if d.get("Filter", "Standard") != "Standard":
            raise FileFault("Encrypted", "only the standard handler is supported")
        v, self.r = int(d.get("V") or 0), int(d.get("R") or 0)
        bits = int(d.get("Length") or 40)
        self.size = min(16, max(5, bits // 8)) if v > 1 else 5
        self.meta = d.get("EncryptMetadata") is not False
        self.d, self.id = d, file_id
        if v in (4, 5):
            filters = d.get("CF") or {}

            def method(which):
                f = filters.get(d.get(which, Name("Identity")))
                return {"V2": "rc4", "AESV2": "aes", "AESV3": "aes256", "None": ""}.get(str(f.get("CFM", "None")), "") if isinstance(f, dict) else ""

            self.streams, self.strings = method("StmF"), method("StrF")
            self.size = 16 if v == 4 else 32
        elif v in (1, 2):
            self.streams = self.strings = "rc4"
        else:
            raise FileFault("Encrypted", f"version {v} is not supported")
        self.key = self._open_r6(password) if self.r >= 5 else self._open_r4(password)
        if self.key is None:
            raise FileFault("WrongPassword", "neither the user nor the owner password")

    def _key_r4(self, password: bytes) -> bytes:
        h = hashlib.md5((password + PAD)[:32] + self.d["O"][:32] + (int(self.d.get("P") or 0) & 0xFFFFFFFF).to_bytes(4, "little") + self.id + (b"\xff" * 4 if self.r >= 4 and not self.meta else b"")).digest()
        for _ in range(50 if self.r >= 3 else 0):
            h = hashlib.md5(h[: self.size]).digest()
        return h[: self.size]

    def _fits_r4(self, key: bytes) -> bool:
        if self.r == 2:
            return rc4(key, PAD) == self.d["U"][:32]
        x = rc4(key, hashlib.md5(PAD + self.id).digest())
        for i in range(1, 20):
            x = rc4(bytes(c ^ i for c in key), x)
        return x == self.d["U"][:16]

    def _open_r4(self, password: bytes) -> bytes | None:
        key = self._key_r4(password)
        if self._fits_r4(key):
            return key
        h = hashlib.md5((password + PAD)[:32]).digest()
        for _ in range(50 if self.r >= 3 else 0):
            h = hashlib.md5(h).digest()
        user = self.d["O"][:32]
        for i in range(19 if self.r >= 3 else 0, -1, -1):
            user = rc4(bytes(c ^ i for c in h[: self.size]), user)
        key = self._key_r4(user)
        return key if self._fits_r4(key) else None

    def _open_r6(self, password: bytes) -> bytes | None:
        password, u, o = password[:127], self.d["U"], self.d["O"]
        make = hash_r6 if self.r >= 6 else lambda p, s, x=b"": hashlib.sha256(p + s + x).digest()
        if make(password, u[32:40]) == u[:32]:
            return cbc_decrypt(make(password, u[40:48]), self.d["UE"][:32], bytes(16))
        if make(password, o[32:40], u[:48]) == o[:32]:
            return cbc_decrypt(make(password, o[40:48], u[:48]), self.d["OE"][:32], bytes(16))
        return None

    def object_key(self, ref: Ref, aes: bool) -> bytes:
        raw = self.key + ref.num.to_bytes(4, "little")[:3] + ref.gen.to_bytes(4, "little")[:2] + (b"sAlT" if aes else b"")
        return hashlib.md5(raw).digest()[: min(len(self.key) + 5, 16)]

    def decrypt(self, data: bytes, ref: Ref, how: str) -> bytes:
        if how == "rc4":
            return rc4(self.object_key(ref, False), data)
        if how == "aes":
            return aes_open(self.object_key(ref, True), data)
        return aes_open(self.key, data) if how == "aes256" else data

    def open(self, v, ref: Ref):
        """An object with its strings and stream bytes decrypted; cross-reference streams stay as they are."""
        if isinstance(v, Stream):
            if v.dict.get("Type") == "XRef" or v.dict.get("Type") == "Metadata" and not self.meta:
                return v
            return Stream(self.open(v.dict, ref), self.decrypt(v.data, ref, self.streams))
        if isinstance(v, bytes):
            out = Str(self.decrypt(v, ref, self.strings))
            out.hexed = getattr(v, "hexed", False)
            return out
        if isinstance(v, dict):
            return {k: self.open(x, ref) for k, x in v.items()}
        if isinstance(v, list):
            return [self.open(x, ref) for x in v]
        return v
