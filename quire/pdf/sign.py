"""Signatures: reading and checking CMS containers (RSA and ECDSA), certificates and chains; signing with either kind of key; and time stamps (RFC 3161).

No crypto package is assumed; keys are Python integers.
"""

from __future__ import annotations

import hashlib
import hmac
from typing import NamedTuple

from quire.pdf.document import Document
from quire.pdf.structure import signatures
from quire.pdf.syntax import Name, PdfError, Ref, write_object
from quire.pdf.writer import incremental

#: Object identifiers.
SHA = {"1.3.14.3.2.26": "sha1", "2.16.840.1.101.3.4.2.1": "sha256", "2.16.840.1.101.3.4.2.2": "sha384", "2.16.840.1.101.3.4.2.3": "sha512"}
OID = {name: oid for oid, name in SHA.items()} | {
    "data": "1.2.840.113549.1.7.1", "signed": "1.2.840.113549.1.7.2", "content_type": "1.2.840.113549.1.9.3", "digest": "1.2.840.113549.1.9.4", "rsa": "1.2.840.113549.1.1.1",
    "sha256_rsa": "1.2.840.113549.1.1.11", "ec": "1.2.840.10045.2.1", "sha256_ecdsa": "1.2.840.10045.4.3.2", "tst": "1.2.840.113549.1.9.16.1.4", "stamp": "1.2.840.113549.1.9.16.2.14", "CN": "2.5.4.3", "O": "2.5.4.10", "C": "2.5.4.6",
}


#: The curves P-256 and P-384 (prime, b, order, generator).
CURVES = {
    "1.2.840.10045.3.1.7": (
        2**256 - 2**224 + 2**192 + 2**96 - 1, 0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B, 0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551,
        (0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296, 0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5),
    ),
    "1.3.132.0.34": (
        2**384 - 2**128 - 2**96 + 2**32 - 1, 0xB3312FA7E23EE7E4988E056BE3F82D19181D9C6EFE8141120314088F5013875AC656398D8A2ED19D2A85C8EDD3EC2AEF,
        0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFC7634D81F4372DDF581A0DB248B0A77AECEC196ACCC52973,
        (0xAA87CA22BE8B05378EB1C71EF320AD746E1D3B628BA79B9859F741E082542A385502F25DBF55296C3A545E3872760AB7,
         0x3617DE4A96262C6F5D9E98BF9292DC29F8F41DBD289A147CE9DA3113B5F0B8C00A60B1CE1D7E819D7A431D7C90EA0E5F),
    ),
}


class Der(NamedTuple):
    tag: int
    body: bytes
    raw: bytes

    def kids(self) -> list[Der]:
        out, at = [], 0
        while at < len(self.body):
            x, at = read_der(self.body, at)
            out.append(x)
        return out

    def number(self) -> int:
        return int.from_bytes(self.body, signed=True)

    def oid(self) -> str:
        parts, value = [], 0
        for b in self.body:
            value = value << 7 | b & 127
            if not b & 128:
                parts.append(value)
                value = 0
        first = min(parts[0] // 40, 2)
        return ".".join(map(str, [first, parts[0] - 40 * first, *parts[1:]]))

    def text(self) -> str:
        return self.body.decode("utf-16-be" if self.tag == 30 else "utf-8", "replace")


def read_der(data: bytes, at: int = 0) -> tuple[Der, int]:
    try:
        start, tag, size = at, data[at], data[at + 1]
        at += 2
        if size & 128:
            n = size & 127
            size = int.from_bytes(data[at : at + n])
            at += n
    except IndexError:
        raise PdfError("DER data end early") from None
    if at + size > len(data):
        raise PdfError("DER data end early")
    return Der(tag, data[at : at + size], data[start : at + size]), at + size


def der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([128 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)
    return bytes([tag]) + size + body


def der_number(v: int) -> bytes:
    return der(2, v.to_bytes(v.bit_length() // 8 + 1, signed=True))


def der_oid(oid: str) -> bytes:
    a, b, *rest = map(int, oid.split("."))
    out = b""
    for v in (40 * a + b, *rest):
        own = [v & 127]
        while v > 127:
            v >>= 7
            own.insert(0, v & 127 | 128)
        out += bytes(own)
    return der(6, out)


class Certificate(NamedTuple):
    subject: str
    issuer: str
    serial: int
    not_before: str
    not_after: str
    key: tuple | None  # (modulus, exponent), or (curve, point)
    body: bytes
    algorithm: str
    signature: bytes


def _name(x: Der) -> str:
    short = {v: k for k, v in OID.items() if k in ("CN", "O", "C")}
    parts = []
    for group in x.kids():
        for pair in group.kids():
            kind, value = pair.kids()
            parts.append(f"{short.get(kind.oid(), kind.oid())}={value.text()}")
    return ", ".join(parts)


def read_certificate(raw: bytes) -> Certificate:
    body, algorithm, signature = read_der(raw)[0].kids()
    fields = body.kids()
    fields = fields[1:] if fields[0].tag == 0xA0 else fields
    serial, _, issuer, validity, subject, public = fields[:6]
    kind, bits = public.kids()
    key = None
    if kind.kids()[0].oid() == OID["rsa"]:
        n, e = read_der(bits.body[1:])[0].kids()
        key = n.number(), e.number()
    elif kind.kids()[0].oid() == OID["ec"] and kind.kids()[1].tag == 6 and kind.kids()[1].oid() in CURVES and bits.body[1:2] == b"\x04":
        point = bits.body[2:]
        half = len(point) // 2
        key = kind.kids()[1].oid(), (int.from_bytes(point[:half]), int.from_bytes(point[half:]))
    before, after = validity.kids()
    return Certificate(_name(subject), _name(issuer), serial.number(), before.text(), after.text(), key, body.raw, algorithm.kids()[0].oid(), signature.body[1:])


#: The hash of each signature algorithm.
_SIGNED_HASH = {"1.2.840.10045.4.3.2": "sha256", "1.2.840.10045.4.3.3": "sha384", "1.2.840.10045.4.3.4": "sha512", "1.2.840.113549.1.1.5": "sha1", "1.2.840.113549.1.1.11": "sha256", "1.2.840.113549.1.1.12": "sha384", "1.2.840.113549.1.1.13": "sha512"}


def _padded(digest: bytes, name: str, size: int) -> bytes:
    info = der(48, der(48, der_oid(OID[name]), der(5)), der(4, digest))
    return b"\0\1" + b"\xff" * (size - len(info) - 3) + b"\0" + info


def rsa_check(key: tuple[int, int], signature: bytes, digest: bytes, name: str) -> bool:
    n, e = key
    size = (n.bit_length() + 7) // 8
    return len(signature) == size and pow(int.from_bytes(signature), e, n).to_bytes(size) == _padded(digest, name, size)


def rsa_sign(n: int, d: int, digest: bytes, name: str = "sha256") -> bytes:
    size = (n.bit_length() + 7) // 8
    return pow(int.from_bytes(_padded(digest, name, size)), d, n).to_bytes(size)


# --- ECDSA ---


def _add(curve: str, p, q):
    """The sum of two points; None is the one at infinity."""
    prime = CURVES[curve][0]
    if p is None or q is None:
        return q if p is None else p
    if p[0] == q[0]:
        if (p[1] + q[1]) % prime == 0:
            return None
        slope = (3 * p[0] * p[0] - 3) * pow(2 * p[1], -1, prime)
    else:
        slope = (q[1] - p[1]) * pow(q[0] - p[0], -1, prime)
    x = (slope * slope - p[0] - q[0]) % prime
    return x, (slope * (p[0] - x) - p[1]) % prime


def multiply(curve: str, k: int, p):
    out = None
    while k:
        out = _add(curve, out, p) if k & 1 else out
        p, k = _add(curve, p, p), k >> 1
    return out


def on_curve(curve: str, p) -> bool:
    prime, b, _, _ = CURVES[curve]
    return (p[1] * p[1] - p[0] ** 3 + 3 * p[0] - b) % prime == 0


def _leading(digest: bytes, order: int) -> int:
    return int.from_bytes(digest) >> max(0, 8 * len(digest) - order.bit_length())


def ec_check(curve: str, point, signature: bytes, digest: bytes) -> bool:
    _, _, order, base = CURVES[curve]
    try:
        r, s = (x.number() for x in read_der(signature)[0].kids())
    except (PdfError, ValueError):
        return False
    if not (0 < r < order and 0 < s < order and on_curve(curve, point)):
        return False
    w = pow(s, -1, order)
    at = _add(curve, multiply(curve, _leading(digest, order) * w % order, base), multiply(curve, r * w % order, point))
    return at is not None and at[0] % order == r


def ec_sign(curve: str, d: int, digest: bytes, name: str = "sha256") -> bytes:
    """A signature whose secret number follows from key and digest (RFC 6979)."""
    _, _, order, base = CURVES[curve]
    size = (order.bit_length() + 7) // 8
    seed = d.to_bytes(size) + (_leading(digest, order) % order).to_bytes(size)
    mac = lambda key, *data: hmac.new(key, b"".join(data), name).digest()
    v, k = b"\1" * len(mac(b"")), b"\0" * len(mac(b""))
    for lead in (b"\0", b"\1"):
        k = mac(k, v, lead, seed)
        v = mac(k, v)
    while True:
        t = b""
        while len(t) < size:
            v = mac(k, v)
            t += v
        secret = _leading(t[:size], order)
        if 0 < secret < order:
            r = multiply(curve, secret, base)[0] % order
            s = pow(secret, -1, order) * (_leading(digest, order) + r * d) % order
            if r and s:
                return der(48, der_number(r), der_number(s))
        k = mac(k, v, b"\0")
        v = mac(k, v)


def check(key: tuple, signature: bytes, digest: bytes, name: str) -> bool:
    """A signature by either kind of key."""
    return ec_check(*key, signature, digest) if isinstance(key[0], str) else rsa_check(key, signature, digest, name)


def signed_by(n, d: int, digest: bytes) -> bytes:
    """A signature of a SHA-256 digest; n is a modulus, or a curve's identifier."""
    return ec_sign(n, d, digest) if isinstance(n, str) else rsa_sign(n, d, digest)


def _kind(n) -> bytes:
    return der(48, der_oid(OID["sha256_ecdsa"])) if isinstance(n, str) else der(48, der_oid(OID["rsa"]), der(5))


def chain_of(certificates: list[Certificate], signer: Certificate) -> tuple[list[Certificate], bool]:
    """From the signer up to what signed itself, or as far as it goes; and whether every link's signature holds."""
    out, ok = [signer], True
    while out[-1].issuer != out[-1].subject:
        above = next((c for c in certificates if c.subject == out[-1].issuer and c not in out), None)
        if above is None:
            return out, False
        out.append(above)
    for c, above in zip(out, out[1:] + out[-1:]):
        name = _SIGNED_HASH.get(c.algorithm)
        ok = ok and name is not None and above.key is not None and check(above.key, c.signature, hashlib.new(name, c.body).digest(), name)
    return out, ok


def verify_container(cms: bytes, covered: bytes) -> dict:
    """What a CMS container says of some data: digest_ok (needs the signed digest), signature_ok, chain_ok, signer."""
    kind, wrapped = read_der(cms)[0].kids()[:2]
    if kind.oid() != OID["signed"]:
        raise PdfError("not a signature container")
    parts = wrapped.kids()[0].kids()
    certificates = [read_certificate(c.raw) for p in parts if p.tag == 0xA0 for c in p.kids()]
    info = parts[-1].kids()[0].kids()
    issuer_serial = info[1].kids()
    serial = issuer_serial[1].number()
    name = SHA.get(info[2].kids()[0].oid())
    if name is None:
        raise PdfError("unknown digest")
    attributes = next((x for x in info if x.tag == 0xA0), None)
    signature = next(x for x in info if x.tag == 4).body
    digest, digest_ok = hashlib.new(name, covered).digest(), False
    signed = covered
    if attributes is not None:
        for a in attributes.kids():
            key, values = a.kids()
            if key.oid() == OID["digest"]:
                digest_ok = values.kids()[0].body == digest
        signed = der(49, attributes.body)
    signer = next((c for c in certificates if c.serial == serial and _name(issuer_serial[0]) == c.issuer), None)
    signature_ok = signer is not None and signer.key is not None and check(signer.key, signature, hashlib.new(name, signed).digest(), name)
    chain, chain_ok = chain_of(certificates, signer) if signer else ([], False)
    return {
        "digest_ok": digest_ok if attributes is not None else signature_ok, "signature_ok": signature_ok, "chain_ok": chain_ok,
        "signer": signer.subject if signer else None, "chain": [c.subject for c in chain], "digest_algorithm": name, "stamp": _stamp(info, signature),
    }


def _stamp(info: list[Der], signature: bytes) -> dict | None:
    """What the time stamp among a signature's unsigned attributes says."""
    for a in (a for x in info if x.tag == 0xA1 for a in x.kids()):
        key, values = a.kids()
        if key.oid() == OID["stamp"]:
            try:
                return read_stamp(values.kids()[0].raw, signature)
            except (PdfError, ValueError, IndexError, StopIteration):
                return {"valid": False}
    return None


# --- time stamps ---


def stamp_request(signature: bytes, nonce: int | None = None, name: str = "sha256") -> bytes:
    """A request for a time stamp of some bytes, to be sent to a time stamp authority."""
    imprint = der(48, der(48, der_oid(OID[name]), der(5)), der(4, hashlib.new(name, signature).digest()))
    return der(48, der_number(1), imprint, *([der_number(nonce)] if nonce is not None else []), der(1, b"\xff"))


def stamp_of_response(response: bytes) -> bytes:
    """The token of an authority's answer; an error if it was refused."""
    parts = read_der(response)[0].kids()
    status = parts[0].kids()[0].number() if parts and parts[0].kids() else -1
    if status not in (0, 1) or len(parts) < 2:
        raise PdfError(f"the time stamp was refused (status {status})")
    return parts[1].raw


def read_stamp(token: bytes, signature: bytes) -> dict:
    """time, authority, and whether the token holds and is of these bytes."""
    kind, wrapped = read_der(token)[0].kids()[:2]
    if kind.oid() != OID["signed"]:
        raise PdfError("not a time stamp")
    content = next(p for p in wrapped.kids()[0].kids() if p.tag == 48 and p.kids() and p.kids()[0].tag == 6 and p.kids()[0].oid() == OID["tst"])
    body = content.kids()[1].kids()[0].body
    fields = read_der(body)[0].kids()
    algorithm, digest = fields[2].kids()
    name = SHA.get(algorithm.kids()[0].oid())
    held = verify_container(token, body)
    same = name is not None and digest.body == hashlib.new(name, signature).digest()
    return {"time": fields[4].text(), "authority": held["signer"], "serial": fields[3].number(), "valid": bool(same and held["digest_ok"] and held["signature_ok"])}


def make_stamp(request: bytes, certificates: list[bytes], n, d: int, time: str, serial: int = 1) -> bytes:
    """An authority's answer to a request; time as YYYYMMDDHHMMSSZ."""
    fields = read_der(request)[0].kids()
    nonce = [f.raw for f in fields[2:] if f.tag == 2]
    body = der(48, der_number(1), der_oid("1.2.3.4"), fields[1].raw, der_number(serial), der(24, time.encode()), *nonce)
    token = make_container(body, certificates, n, d, OID["tst"], True)
    return der(48, der(48, der_number(0)), token)


def verify(doc: Document) -> list[dict]:
    """All signatures of a document, checked. valid: its digest and signature hold and the file does not go on after it."""
    out = []
    for s in signatures(doc):
        r = s["byte_range"]
        covered = b"".join(doc.data[a : a + n] for a, n in zip(r[::2], r[1::2]))
        try:
            raw = doc.resolve(doc.resolve(Ref(s["ref"]))["Contents"])
            found = verify_container(raw, covered)
        except (PdfError, ValueError, IndexError, StopIteration) as e:
            found = {"error": str(e) or "unreadable", "digest_ok": False, "signature_ok": False, "chain_ok": False, "signer": None}
        out.append(s | found | {"valid": bool(found["digest_ok"] and found["signature_ok"] and not s["modified_after"])})
    return out


def make_container(covered: bytes, certificates: list[bytes], n, d: int, kind: str = OID["data"], attached: bool = False, stamp=None) -> bytes:
    """A container over some data (detached, or with them), by the first certificate's key. stamp: a function from the signature to a time stamp token."""
    own = read_certificate(certificates[0])
    issuer = next(x for x in read_der(own.body)[0].kids()[-6:] if x.tag == 48 and _is_name(x, own.issuer)).raw
    sha = der(48, der_oid(OID["sha256"]), der(5))
    attributes = der(48, der_oid(OID["content_type"]), der(49, der_oid(kind))) + der(48, der_oid(OID["digest"]), der(49, der(4, hashlib.sha256(covered).digest())))
    signature = signed_by(n, d, hashlib.sha256(der(49, attributes)).digest())
    stamped = [der(0xA1, der(48, der_oid(OID["stamp"]), der(49, stamp(signature))))] if stamp else []
    info = der(48, der_number(1), der(48, issuer, der_number(own.serial)), sha, der(0xA0, attributes), _kind(n), der(4, signature), *stamped)
    inner = der(48, der_oid(kind), *([der(0xA0, der(4, covered))] if attached else []))
    body = der(48, der_number(3 if attached else 1), der(49, sha), inner, der(0xA0, *certificates), der(49, info))
    return der(48, der_oid(OID["signed"]), der(0xA0, body))


def _is_name(x: Der, name: str) -> bool:
    try:
        return _name(x) == name
    except (PdfError, ValueError, IndexError):
        return False


def self_signed(name: str, n, e: int, d: int, serial: int = 1) -> bytes:
    """A certificate that signs itself. For a curve's identifier as n, e is not used and d is the secret number."""
    who = der(48, der(49, der(48, der_oid(OID["CN"]), der(12, name.encode()))))
    if isinstance(n, str):
        size = (CURVES[n][0].bit_length() + 7) // 8
        point = multiply(n, d, CURVES[n][3])
        kind = _kind(n)
        public = der(48, der(48, der_oid(OID["ec"]), der_oid(n)), der(3, b"\0\x04" + point[0].to_bytes(size) + point[1].to_bytes(size)))
    else:
        kind = der(48, der_oid(OID["sha256_rsa"]), der(5))
        public = der(48, der(48, der_oid(OID["rsa"]), der(5)), der(3, b"\0" + der(48, der_number(n), der_number(e))))
    body = der(48, der(0xA0, der_number(2)), der_number(serial), kind, who, der(48, der(23, b"250101000000Z"), der(23, b"350101000000Z")), who, public)
    return der(48, body, kind, der(3, b"\0" + signed_by(n, d, hashlib.sha256(body).digest())))


def sign(data: bytes, certificates: list[bytes], n, d: int, reason: str = "", room: int = 8192, stamp=None) -> bytes:
    """The document with a signature appended; the old bytes stay. n: the modulus, or the curve's identifier; stamp: see make_container."""
    doc = Document(data)
    number = max((r.num for r in doc.refs()), default=0) + 1
    marker = [0, 1111111111, 2222222222, 3333333333]
    value = {"Type": Name("Sig"), "Filter": Name("Adobe.PPKLite"), "SubFilter": Name("adbe.pkcs7.detached"), "ByteRange": marker, "Contents": b"\xff" * room, "Reason": reason}
    field = {"FT": Name("Sig"), "T": b"Signature1", "V": Ref(number)}
    catalog = dict(doc.catalog)
    form = dict(doc.get(catalog, "AcroForm", dict) or {})
    form["Fields"], form["SigFlags"] = [*(doc.get(form, "Fields", list) or []), Ref(number + 1)], 3
    root = doc.trailer["Root"]
    out = incremental(data, doc, {number: value, number + 1: field, root.num: catalog | {"AcroForm": form}})
    start = out.index(b"<" + b"ff" * room + b">")
    end = start + 2 * room + 2
    ranges = [0, start, end, len(out) - end]
    old = write_object(marker)
    new = write_object(ranges)
    out = out.replace(old, new + b" " * (len(old) - len(new)), 1)
    cms = make_container(out[:start] + out[end:], certificates, n, d, stamp=stamp)
    if len(cms) > room:
        raise PdfError("no room for the signature")
    return out[:start] + b"<" + cms.hex().encode() + b"00" * (room - len(cms)) + b">" + out[end:]
