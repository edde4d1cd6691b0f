"""Data Matrix symbols, read back by their own rules."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import datamatrix


def test_the_published_example():
    assert datamatrix.words_of(b"123456") == [142, 164, 186] and datamatrix.error_words([142, 164, 186], 5) == [114, 25, 5, 88, 102]
    symbol = datamatrix.data_matrix("123456")
    assert len(symbol) == 10 and symbol[0] == "1010101010" and symbol[-1] == "1" * 10 and all(r[0] == "1" for r in symbol)
    assert [r[-1] for r in symbol] == list("0101010101")


@pytest.mark.parametrize("n", sorted({s[0] - 2 * s[3] for s in datamatrix.SIZES}))
def test_every_module_has_its_place(n):
    found = [p for row in datamatrix.places(n) for p in row if p]
    words = n * n // 8
    assert len(found) == len(set(found)) == 8 * words and {w for w, _ in found} == set(range(words))


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=200))
def test_round_trip(data):
    symbol = datamatrix.data_matrix(data)
    side, capacity, errors, regions, blocks = next(s for s in datamatrix.SIZES if s[0] == len(symbol))
    inner = side // regions - 2
    words = [0] * (capacity + errors)
    for y, row in enumerate(datamatrix.places(inner * regions)):
        for x, own in enumerate(row):
            if own:
                bit = symbol[y // inner * (inner + 2) + y % inner + 1][x // inner * (inner + 2) + x % inner + 1]
                words[own[0]] |= int(bit) << (8 - own[1])
    for b in range(blocks):
        assert datamatrix.error_words(words[b:capacity:blocks], errors // blocks) == words[capacity + b :: blocks]
    out, upper = b"", False
    for w in words[:capacity]:
        if upper:
            out, upper = out + bytes([w + 127]), False
        elif w == 235:
            upper = True
        elif w == 129:
            break
        elif w <= 128:
            out += bytes([w - 1])
        else:
            out += b"%02d" % (w - 130)
    assert out == data


def test_too_long():
    with pytest.raises(ValueError):
        datamatrix.data_matrix(b"a" * 1559)
