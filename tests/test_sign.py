"""Signing and checking with a small RSA key of its own."""

from __future__ import annotations

import hashlib

import pytest

from quire.pdf import sign, writer
from quire.pdf.document import Document
from quire.pdf.syntax import PdfError


def prime(start: int) -> int:
    n = start | 1
    while any(pow(a, n - 1, n) != 1 for a in (2, 3, 5, 7, 11, 13)):
        n += 2
    return n


P, Q = prime(3**323), prime(5**220)
N, E = P * Q, 65537
D = pow(E, -1, (P - 1) * (Q - 1))


def test_sign_and_verify():
    data = writer.lines_to_pdf([["signed page"]], "T")
    cert = sign.self_signed("Tester", N, E, D)
    done = sign.sign(data, [cert], N, D, "because")
    assert done.startswith(data)
    (s,) = sign.verify(Document(done))
    assert s["valid"] and s["digest_ok"] and s["signature_ok"] and s["chain_ok"] and s["signer"] == "CN=Tester" and s["reason"] == "because"
    changed = done.replace(b"because", b"becausE")
    (s,) = sign.verify(Document(changed))
    assert not s["valid"] and not s["digest_ok"] and s["signature_ok"]
    doc = Document(done)
    later = writer.incremental(done, doc, {doc.trailer["Info"].num: {"Title": b"new"}})
    (s,) = sign.verify(Document(later))
    assert s["digest_ok"] and s["modified_after"] and not s["valid"]
    assert sign.verify(Document(data)) == []


def test_certificates_and_der():
    c = sign.read_certificate(sign.self_signed("Name é", N, E, D, 77))
    assert (c.subject, c.issuer, c.serial, c.key) == ("CN=Name é", "CN=Name é", 77, (N, E))
    other = c._replace(issuer="CN=Nobody")
    assert sign.chain_of([c], other) == ([other], False) and sign.chain_of([c], c)[1] and not sign.chain_of([c], c._replace(signature=bytes(len(c.signature))))[1]
    assert sign.read_der(sign.der_oid("1.2.840.113549.1.7.2"))[0].oid() == "1.2.840.113549.1.7.2" and sign.read_der(sign.der_number(-129))[0].number() == -129
    with pytest.raises(PdfError):
        sign.read_der(b"\x30\x05a")
    with pytest.raises(PdfError):
        sign.verify_container(sign.der(48, sign.der_oid("1.2.3"), sign.der(0xA0)), b"")


@pytest.mark.parametrize("curve", sorted(sign.CURVES))
def test_curves(curve):
    _, _, order, base = sign.CURVES[curve]
    assert sign.on_curve(curve, base) and sign.multiply(curve, order, base) is None and sign.multiply(curve, order - 1, base)[0] == base[0]
    secret = 3**100
    point, digest = sign.multiply(curve, secret, base), hashlib.sha256(b"told").digest()
    done = sign.ec_sign(curve, secret, digest)
    assert sign.ec_check(curve, point, done, digest) and done == sign.ec_sign(curve, secret, digest)
    assert not sign.ec_check(curve, point, done, hashlib.sha256(b"tolt").digest()) and not sign.ec_check(curve, base, done, digest) and not sign.ec_check(curve, point, b"0", digest)


def test_the_published_signature():
    """RFC 6979, A.2.5: P-256, SHA-256, message "sample"."""
    secret = 0xC9AFA9D845BA75166B5C215767B1D6934E50C3DB36E89B127B8A622B120F6721
    done = sign.read_der(sign.ec_sign("1.2.840.10045.3.1.7", secret, hashlib.sha256(b"sample").digest()))[0].kids()
    assert done[0].number() == 0xEFD48B2AACB6A8FD1140DD9CD45E81D69D2C877B56AAF991C34D0EA84EAF3716
    assert done[1].number() == 0xF7CB1C942D657C41D436C7A1B6E29F65F3E900DBB9AFF4064DC4AB2F843ACDA8


def test_sign_with_a_curve():
    curve, secret = "1.2.840.10045.3.1.7", 7**80
    done = sign.sign(writer.lines_to_pdf([["x"]]), [sign.self_signed("Curved", curve, 0, secret)], curve, secret)
    (s,) = sign.verify(Document(done))
    assert s["valid"] and s["chain_ok"] and s["signer"] == "CN=Curved" and s["stamp"] is None


def test_time_stamps():
    cert, authority = sign.self_signed("Tester", N, E, D), sign.self_signed("Clock", N, E, D, 9)

    def ask(signature, time="20250102030405Z"):
        return sign.stamp_of_response(sign.make_stamp(sign.stamp_request(signature, 12345), [authority], N, D, time))

    (s,) = sign.verify(Document(sign.sign(writer.lines_to_pdf([["x"]]), [cert], N, D, stamp=ask)))
    assert s["valid"] and s["stamp"] == {"time": "20250102030405Z", "authority": "CN=Clock", "serial": 1, "valid": True}
    (s,) = sign.verify(Document(sign.sign(writer.lines_to_pdf([["x"]]), [cert], N, D, stamp=lambda sig: ask(b"of other bytes"))))
    assert s["valid"] and not s["stamp"]["valid"]
    with pytest.raises(PdfError, match="refused"):
        sign.stamp_of_response(sign.der(48, sign.der(48, sign.der_number(2))))
