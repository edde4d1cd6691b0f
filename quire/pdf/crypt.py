"""The standard security handler: RC4 and AES, authentication R2 to R6, and keys for writing.

No crypto package is assumed; AES works on tables made from its field rule.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import os
import struct

import numpy as np

from quire.pdf.syntax import Name, PdfError, Ref, Stream

#: Fixed value: the padding string of the standard security handler.
PADDING = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    i = j = 0
    stream = bytearray(len(data))
    for n in range(len(data)):
        i = (i + 1) & 255
        a = s[i]
        j = (j + a) & 255
        s[i], s[j] = b, a = s[j], a
        stream[n] = s[(a + b) & 255]
    return (np.frombuffer(bytes(stream), np.uint8) ^ np.frombuffer(data, np.uint8)).tobytes()


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1) ^ (0x11B if a & 128 else 0)
        b >>= 1
    return out


def _tables():
    power = [1]
    for _ in range(254):
        power.append(_times(power[-1], 3))
    box = [0] * 256
    for x in range(256):
        inverse = 0 if x == 0 else power[(255 - power.index(x)) % 255]
        turned = [((inverse << k) | (inverse >> (8 - k))) & 255 for k in range(5)]
        box[x] = turned[0] ^ turned[1] ^ turned[2] ^ turned[3] ^ turned[4] ^ 0x63
    return np.array(box, np.uint8)


_BOX = _tables()
_UNBOX = np.argsort(_BOX).astype(np.uint8)
_BY = {n: np.array([_times(x, n) for x in range(256)], np.uint8) for n in (2, 3, 9, 11, 13, 14)}
_SHIFT = np.array([(c + r) % 4 * 4 + r for c in range(4) for r in range(4)])
_UNSHIFT = np.argsort(_SHIFT)


def _round_keys(key: bytes) -> np.ndarray:
    n, words, rc = len(key) // 4, [list(key[k : k + 4]) for k in range(0, len(key), 4)], 1
    for k in range(n, 4 * (n + 7)):
        t = list(words[-1])
        if k % n == 0:
            t = [int(_BOX[b]) for b in t[1:] + t[:1]]
            t[0] ^= rc
            rc = _times(rc, 2)
        elif n > 6 and k % n == 4:
            t = [int(_BOX[b]) for b in t]
        words.append([a ^ b for a, b in zip(words[k - n], t)])
    return np.array(words, np.uint8).reshape(-1, 16)


def _encrypt_blocks(keys, blocks):
    x = blocks ^ keys[0]
    for k in range(1, len(keys)):
        x = _BOX[x][:, _SHIFT]
        if k < len(keys) - 1:
            a = x.reshape(-1, 4, 4)
            b, c, d = (np.roll(a, -s, axis=2) for s in (1, 2, 3))
            x = (_BY[2][a] ^ _BY[3][b] ^ c ^ d).reshape(-1, 16)
        x = x ^ keys[k]
    return x


#: A column of the state after substitution and mixing, for each byte in each row.
_MIXED = [[int.from_bytes(bytes(np.roll([_BY[2][_BOX[x]], _BOX[x], _BOX[x], _BY[3][_BOX[x]]], row).tolist())) for x in range(256)] for row in range(4)]
_SUBSTITUTE = _BOX.tolist()


def _key_words(key: bytes) -> list[int]:
    raw = _round_keys(key).tobytes()
    return [int.from_bytes(raw[k : k + 4]) for k in range(0, len(raw), 4)]


def _encrypt_word(words: list[int], block: int) -> int:
    """One block, for chains in which each needs the one before."""
    t0, t1, t2, t3 = _MIXED
    a, b, c, d = ((block >> 96) ^ words[0], (block >> 64 & 0xFFFFFFFF) ^ words[1], (block >> 32 & 0xFFFFFFFF) ^ words[2], (block & 0xFFFFFFFF) ^ words[3])
    last = len(words) - 4
    for k in range(4, last, 4):
        a, b, c, d = (
            t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ words[k],
            t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ words[k + 1],
            t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ words[k + 2],
            t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ words[k + 3],
        )
    s, out = _SUBSTITUTE, 0
    for k, (w, x, y, z) in enumerate(((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c))):
        out = out << 32 | ((s[w >> 24] << 24 | s[x >> 16 & 255] << 16 | s[y >> 8 & 255] << 8 | s[z & 255]) ^ words[last + k])
    return out


def _decrypt_blocks(keys, blocks):
    x = blocks ^ keys[-1]
    for k in range(len(keys) - 2, -1, -1):
        x = _UNBOX[x[:, _UNSHIFT]] ^ keys[k]
        if k:
            a = x.reshape(-1, 4, 4)
            b, c, d = (np.roll(a, -s, axis=2) for s in (1, 2, 3))
            x = (_BY[14][a] ^ _BY[11][b] ^ _BY[13][c] ^ _BY[9][d]).reshape(-1, 16)
    return x


def aes_cbc_decrypt(key: bytes, data: bytes, iv: bytes | None = None, unpad: bool = True) -> bytes:
    """iv: the first 16 bytes of data, if none is given. All blocks are decrypted at once."""
    if iv is None:
        iv, data = data[:16], data[16:]
    data = data[: len(data) // 16 * 16]
    if not data:
        return b""
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    before = np.concatenate([np.frombuffer(iv, np.uint8)[None], blocks[:-1]])
    plain = (_decrypt_blocks(_round_keys(key), blocks) ^ before).tobytes()
    if unpad and 1 <= plain[-1] <= 16:
        plain = plain[: -plain[-1]]
    return plain


def _system_cbc():
    """AES in CBC mode without padding from the system's libcrypto, if there is one that agrees with this module; else None."""
    try:
        lib = ctypes.CDLL(ctypes.util.find_library("crypto") or "")
        pointer, number, raw = ctypes.c_void_p, ctypes.c_int, ctypes.c_char_p
        lib.EVP_CIPHER_CTX_new.restype = pointer
        for bits in (128, 256):
            getattr(lib, f"EVP_aes_{bits}_cbc").restype = pointer
        lib.EVP_EncryptInit_ex.argtypes = [pointer, pointer, pointer, raw, raw]
        lib.EVP_CIPHER_CTX_set_padding.argtypes = [pointer, number]
        lib.EVP_EncryptUpdate.argtypes = [pointer, raw, ctypes.POINTER(number), raw, number]
        lib.EVP_CIPHER_CTX_free.argtypes = [pointer]
    except (OSError, AttributeError):
        return None

    def encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
        context, out, n = lib.EVP_CIPHER_CTX_new(), ctypes.create_string_buffer(len(data) + 16), number(0)
        try:
            cipher = lib.EVP_aes_256_cbc() if len(key) == 32 else lib.EVP_aes_128_cbc()
            lib.EVP_EncryptInit_ex(context, cipher, None, key, iv)
            lib.EVP_CIPHER_CTX_set_padding(context, 0)
            lib.EVP_EncryptUpdate(context, out, ctypes.byref(n), data, len(data))
        finally:
            lib.EVP_CIPHER_CTX_free(context)
        return out.raw[: n.value]

    sample = bytes(range(64))
    if any(encrypt(sample[:n], sample[16:32], sample) != _cbc(sample[:n], sample[16:32], sample) for n in (16, 32)):
        return None
    return encrypt


def _cbc(key: bytes, iv: bytes, data: bytes) -> bytes:
    words, chain, out = _key_words(key), int.from_bytes(iv), []
    for at in range(0, len(data), 16):
        chain = _encrypt_word(words, chain ^ int.from_bytes(data[at : at + 16]))
        out.append(chain.to_bytes(16))
    return b"".join(out)


def aes_cbc_encrypt(key: bytes, data: bytes, iv: bytes | None = None, pad: bool = True) -> bytes:
    """With a drawn iv in front, if none is given."""
    lead = b"" if iv is not None else os.urandom(16)
    if pad:
        n = 16 - len(data) % 16
        data += bytes([n]) * n
    encrypt = _fast if _fast and len(key) in (16, 32) else _cbc
    return lead + encrypt(key, iv if iv is not None else lead, data[: len(data) // 16 * 16])


_fast = _system_cbc()


def aes_ecb(key: bytes, data: bytes, decrypt: bool = False) -> bytes:
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    return (_decrypt_blocks if decrypt else _encrypt_blocks)(_round_keys(key), blocks).tobytes()


def hash_r6(password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    """The hardened hash of revision 6."""
    k, n = hashlib.sha256(password + salt + extra).digest(), 0
    while True:
        e = aes_cbc_encrypt(k[:16], (password + k + extra) * 64, k[16:32], pad=False)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


def _padded(password: bytes) -> bytes:
    return (password + PADDING)[:32]


def _signed(p: int) -> int:
    return p - (1 << 32) if p >= 1 << 31 else p


class Security:
    """What an encryption dictionary says, and after authenticate() the file key."""

    def __init__(self, d: dict, file_id: bytes):
        if d.get("Filter") != "Standard":
            raise PdfError(f"security handler {d.get('Filter')}")
        self.v, self.r = d.get("V", 0), d.get("R", 2)
        self.length = d.get("Length", 40) // 8
        self.o, self.u, self.oe, self.ue = (d.get(k, b"") for k in ("O", "U", "OE", "UE"))
        self.p = _signed(d.get("P", 0) & 0xFFFFFFFF)
        self.metadata = d.get("EncryptMetadata", True) is not False
        self.file_id, self.key, self.owner = file_id, None, False
        self.method = "RC4"
        if self.v == 1:
            self.length = 5
        if self.v in (4, 5):
            cf = (d.get("CF") or {}).get(str(d.get("StmF", "StdCF"))) or {}
            self.method = {"V2": "RC4", "AESV2": "AES", "AESV3": "AES256"}.get(str(cf.get("CFM")), "none")
            self.length = 32 if self.v == 5 else 16

    @property
    def permissions(self) -> int:
        return self.p

    def _key_r234(self, password: bytes) -> bytes:
        h = hashlib.md5(_padded(password) + self.o[:32] + struct.pack("<i", self.p) + self.file_id)
        if self.r >= 4 and not self.metadata:
            h.update(b"\xff\xff\xff\xff")
        k = h.digest()
        if self.r >= 3:
            for _ in range(50):
                k = hashlib.md5(k[: self.length]).digest()
        return k[: self.length]

    def _user_value(self, key: bytes) -> bytes:
        if self.r == 2:
            return rc4(key, PADDING)
        x = hashlib.md5(PADDING + self.file_id).digest()
        for k in range(20):
            x = rc4(bytes(b ^ k for b in key), x)
        return x + bytes(16)

    def _owner_key(self, password: bytes) -> bytes:
        k = hashlib.md5(_padded(password)).digest()
        if self.r >= 3:
            for _ in range(50):
                k = hashlib.md5(k).digest()
        return k[: self.length]

    def _try_user(self, password: bytes) -> bool:
        key = self._key_r234(password)
        n = 32 if self.r == 2 else 16
        if self._user_value(key)[:n] == self.u[:n]:
            self.key = key
            return True
        return False

    def authenticate(self, password: str | bytes = b"") -> bool:
        """Try a password as the user's and then as the owner's."""
        raw = password.encode("utf-8" if self.r >= 5 else "latin-1", "replace") if isinstance(password, str) else password
        if self.r >= 5:
            raw = raw[:127]
            digest = hash_r6 if self.r >= 6 else lambda p, s, x=b"": hashlib.sha256(p + s + x).digest()
            for owner, value, wrapped, extra in ((False, self.u, self.ue, b""), (True, self.o, self.oe, self.u[:48])):
                if digest(raw, value[32:40], extra) == value[:32]:
                    self.key = aes_cbc_decrypt(digest(raw, value[40:48], extra), wrapped[:32], bytes(16), unpad=False)
                    self.owner = owner
                    return True
            return False
        if self._try_user(raw):
            return True
        key, user = self._owner_key(raw), self.o[:32]
        for k in [0] if self.r == 2 else range(19, -1, -1):
            user = rc4(bytes(b ^ k for b in key), user)
        if self._try_user(user):
            self.owner = True
            return True
        return False

    def object_key(self, ref: Ref) -> bytes:
        if self.v >= 5:
            return self.key
        tail = struct.pack("<I", ref.num)[:3] + struct.pack("<I", ref.gen)[:2] + (b"sAlT" if self.method == "AES" else b"")
        return hashlib.md5(self.key + tail).digest()[: min(16, self.length + 5)]

    def _apply(self, ref: Ref, data: bytes, encrypt: bool) -> bytes:
        if self.method == "none":
            return data
        key = self.object_key(ref)
        if self.method == "RC4":
            return rc4(key, data)
        return aes_cbc_encrypt(key, data) if encrypt else aes_cbc_decrypt(key, data)

    def convert(self, x, ref: Ref, encrypt: bool = False):
        """An object's strings and stream data, decrypted (or encrypted). Strings in a stream's dictionary are converted too."""
        if isinstance(x, bytes):
            return self._apply(ref, x, encrypt)
        if isinstance(x, list):
            return [self.convert(v, ref, encrypt) for v in x]
        if isinstance(x, dict):
            return {k: self.convert(v, ref, encrypt) for k, v in x.items()}
        if isinstance(x, Stream):
            kind = x.dict.get("Type")
            plain = kind == "XRef" or (kind == "Metadata" and not self.metadata)
            return Stream({k: self.convert(v, ref, encrypt) for k, v in x.dict.items()}, x.raw if plain else self._apply(ref, x.raw, encrypt))
        return x


def make_security(method: str, user: str, owner: str, permissions: int, file_id: bytes) -> tuple[dict, Security]:
    """An encryption dictionary and its unlocked handler. method: RC4-128, AES-128 or AES-256."""
    p = _signed((permissions | 0xFFFFF0C0) & 0xFFFFFFFC)
    d: dict = {"Filter": Name("Standard"), "P": p}
    if method == "AES-256":
        key, u, o = os.urandom(32), user.encode()[:127], owner.encode()[:127]
        us, os_ = os.urandom(16), os.urandom(16)
        uv = hash_r6(u, us[:8]) + us
        ue = aes_cbc_encrypt(hash_r6(u, us[8:]), key, bytes(16), pad=False)
        ov = hash_r6(o, os_[:8], uv) + os_
        oe = aes_cbc_encrypt(hash_r6(o, os_[8:], uv), key, bytes(16), pad=False)
        perms = struct.pack("<i", p) + b"\xff\xff\xff\xffTadb" + os.urandom(4)
        cf = {"StdCF": {"CFM": Name("AESV3"), "AuthEvent": Name("DocOpen"), "Length": 32}}
        d |= {"V": 5, "R": 6, "Length": 256, "U": uv, "UE": ue, "O": ov, "OE": oe, "Perms": aes_ecb(key, perms), "CF": cf, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
        s = Security(d, file_id)
        s.key = key
        return d, s
    if method not in ("RC4-128", "AES-128"):
        raise PdfError(f"encryption method {method}")
    if method == "RC4-128":
        d |= {"V": 2, "R": 3, "Length": 128}
    else:
        d |= {"V": 4, "R": 4, "Length": 128, "CF": {"StdCF": {"CFM": Name("AESV2"), "AuthEvent": Name("DocOpen"), "Length": 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    s = Security(d | {"O": b"", "U": b""}, file_id)
    key, o = s._owner_key((owner or user).encode("latin-1", "replace")), _padded(user.encode("latin-1", "replace"))
    for k in range(20):
        o = rc4(bytes(b ^ k for b in key), o)
    s.o = d["O"] = o
    s.key = s._key_r234(user.encode("latin-1", "replace"))
    s.u = d["U"] = s._user_value(s.key)
    return d, s
