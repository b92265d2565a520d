"""Standard security handler, revisions 2 to 4: RC4, and AES-128 in CBC mode."""

from __future__ import annotations

from hashlib import md5

from .objects import PdfError

# Fixed value: the padding of passwords in the file format.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, byte in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = byte ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    """Product in the field of 256 elements that AES uses."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1) ^ (0x11B if a & 128 else 0)
        b >>= 1
    return out


def _sbox() -> list[int]:
    out = [0x63]
    for x in range(1, 256):
        inverse = next(y for y in range(1, 256) if _times(x, y) == 1)
        bits = inverse
        for shift in range(1, 5):
            bits ^= ((inverse << shift) | (inverse >> (8 - shift))) & 255
        out.append(bits ^ 0x63)
    return out


_tables: dict = {}


def _aes_tables():
    if not _tables:
        box = _sbox()
        _tables["box"], _tables["back"] = box, [box.index(i) for i in range(256)]
        _tables["mul"] = {f: [_times(i, f) for i in range(256)] for f in (9, 11, 13, 14)}
    return _tables["box"], _tables["back"], _tables["mul"]


def _round_keys(key: bytes) -> list[bytes]:
    box, words, rcon = _aes_tables()[0], [key[i : i + 4] for i in range(0, 16, 4)], 1
    for i in range(4, 44):
        w = words[-1]
        if i % 4 == 0:
            w = bytes([box[w[1]] ^ rcon, box[w[2]], box[w[3]], box[w[0]]])
            rcon = _times(rcon, 2)
        words.append(bytes(a ^ b for a, b in zip(words[-4], w)))
    return [b"".join(words[i : i + 4]) for i in range(0, 44, 4)]


def aes_cbc(key: bytes, data: bytes) -> bytes:
    """Decrypts; the first block is the initial vector. Bad padding is left in place."""
    _, back, mul = _aes_tables()
    keys, out, before = _round_keys(key), [], data[:16]
    order = [(i - 4 * (i % 4)) % 16 for i in range(16)]
    for at in range(16, len(data) - 15, 16):
        block = data[at : at + 16]
        s = [a ^ b for a, b in zip(block, keys[10])]
        for r in range(9, -1, -1):
            s = [back[s[order[i]]] ^ keys[r][i] for i in range(16)]
            if r:
                s = [x for c in range(0, 16, 4) for x in (
                    mul[14][s[c]] ^ mul[11][s[c + 1]] ^ mul[13][s[c + 2]] ^ mul[9][s[c + 3]], mul[9][s[c]] ^ mul[14][s[c + 1]] ^ mul[11][s[c + 2]] ^ mul[13][s[c + 3]],
                    mul[13][s[c]] ^ mul[9][s[c + 1]] ^ mul[14][s[c + 2]] ^ mul[11][s[c + 3]], mul[11][s[c]] ^ mul[13][s[c + 1]] ^ mul[9][s[c + 2]] ^ mul[14][s[c + 3]])]
        out.append(bytes(a ^ b for a, b in zip(s, before)))
        before = block
    text = b"".join(out)
    if text and 1 <= text[-1] <= 16 and text.endswith(bytes([text[-1]]) * text[-1]):
        return text[: -text[-1]]
    return text


class Decryptor:
    """Opens a document with one of the passwords given, the empty one first."""

    def __init__(self, info: dict, file_id: bytes, passwords: list[bytes]):
        self.revision, version = info.get("R", 0), info.get("V", 0)
        if info.get("Filter") != "Standard" or not 2 <= self.revision <= 4:
            raise PdfError("UnsupportedEncryption", f"revision {self.revision}")
        self.size = info.get("Length", 40) // 8 if self.revision >= 3 else 5
        self.aes = False
        if version == 4:
            own = info.get("CF", {}).get(info.get("StmF", "Identity"), {})
            self.aes, self.size = own.get("CFM") == "AESV2", 16
        for password in passwords:
            self.key = self._key(info, file_id, password)
            if self._opens(info, file_id):
                return
        raise PdfError("Encrypted", "no password opens the document")

    def _key(self, info, file_id, password) -> bytes:
        seed = (password + PAD)[:32] + info["O"][:32] + (info["P"] & 0xFFFFFFFF).to_bytes(4, "little") + file_id
        if self.revision >= 4 and info.get("EncryptMetadata") is False:
            seed += b"\xff" * 4
        key = md5(seed).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            key = md5(key[: self.size]).digest()
        return key[: self.size]

    def _opens(self, info, file_id) -> bool:
        if self.revision == 2:
            return rc4(self.key, PAD) == info["U"][:32]
        text = rc4(self.key, md5(PAD + file_id).digest())
        for i in range(1, 20):
            text = rc4(bytes(b ^ i for b in self.key), text)
        return text == info["U"][:16]

    def decrypt(self, data: bytes, number: int, generation: int) -> bytes:
        seed = self.key + number.to_bytes(4, "little")[:3] + generation.to_bytes(4, "little")[:2] + (b"sAlT" if self.aes else b"")
        key = md5(seed).digest()[: min(16, self.size + 5)]
        return aes_cbc(key, data) if self.aes else rc4(key, data)
