"""Facsimile coding, groups 3 and 4: rows of black and white runs."""

from __future__ import annotations

import numpy as np

from quire.pdf.syntax import PdfError

#: Codes of runs 0 to 63, then of 64, 128 ... 1728, of white and of black; and of 1792 to 2560 of either.
WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 "
    "0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 "
    "00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 "
    "01011010 01011011 01001010 01001011 00110010 00110011 00110100 "
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 "
    "011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
).split()
BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 "
    "00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 "
    "000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 "
    "000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 "
    "000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111 "
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 "
    "0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 "
    "0000001011010 0000001011011 0000001100100 0000001100101"
).split()
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
#: Modes of two-dimensional rows.
MODES = {"1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3, "0001": "pass", "001": "runs"}
EOL = "000000000001"


def _lengths() -> list[int]:
    return [*range(64), *range(64, 1729, 64)]


_RUNS = [dict(zip(codes + LONG, _lengths() + list(range(1792, 2561, 64)))) for codes in (WHITE, BLACK)]


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = f"{int.from_bytes(data):0{8 * len(data)}b}" if data else "", 0

    def code(self, table: dict):
        for n in range(1, 14):
            found = table.get(self.bits[self.at : self.at + n])
            if found is not None:
                self.at += n
                return found
        raise PdfError("bad facsimile code")

    def run(self, color: int) -> int:
        total = 0
        while True:
            n = self.code(_RUNS[color])
            total += n
            if n < 64:
                return total

    def end_of_line(self) -> bool:
        """Pass over fill and the mark of a line's end, if it stands here."""
        k = self.at
        while self.bits[k : k + 1] == "0":
            k += 1
        if k - self.at >= 11 and k < len(self.bits):
            self.at = k + 1
            return True
        return False


def _row_1d(bits: _Bits, columns: int) -> list[int]:
    changes, at, color = [], 0, 0
    while at < columns:
        at += bits.run(color)
        changes.append(min(at, columns))
        color ^= 1
    return changes


def _next_changes(above: list[int], at: int, color: int, columns: int) -> tuple[int, int]:
    """b1 and b2: the first change of the other colour in the row above right of at, and the one after it."""
    for k, x in enumerate(above):
        if x > at and k % 2 == color:
            return x, above[k + 1] if k + 1 < len(above) else columns
    return columns, columns


def _row_2d(bits: _Bits, above: list[int], columns: int) -> list[int]:
    changes, at, color = [], -1, 0
    while at < columns:
        b1, b2 = _next_changes(above, at, color, columns)
        mode = bits.code(MODES)
        if mode == "pass":
            at = b2
        elif mode == "runs":
            start = max(at, 0)
            a1 = start + bits.run(color)
            a2 = a1 + bits.run(color ^ 1)
            changes += [min(a1, columns), min(a2, columns)]
            at = a2
        else:
            at = b1 + mode
            changes.append(max(0, min(at, columns)))
            color ^= 1
    return changes


def fax_decode(data: bytes, params: dict) -> bytes:
    """Rows of packed bits. What can be read before damage is kept."""
    k, columns, rows = params.get("K", 0), params.get("Columns", 1728), params.get("Rows", 0)
    bits, out, above = _Bits(data), [], []
    while bits.at < len(bits.bits) and (not rows or len(out) < rows):
        try:
            if k >= 0:
                ends = 0
                while bits.end_of_line():
                    ends += 1
                    if k > 0:
                        two = bits.bits[bits.at : bits.at + 1] == "0"
                        bits.at += 1
                if ends >= 2 and out or bits.at >= len(bits.bits):
                    break
            elif bits.bits.startswith(EOL, bits.at):
                break
            if params.get("EncodedByteAlign"):
                bits.at += -bits.at % 8
            row = _row_2d(bits, above, columns) if k < 0 or (k > 0 and ends and two) else _row_1d(bits, columns)
        except PdfError:
            break
        pixels = np.zeros(columns + 1, np.uint8)
        np.add.at(pixels, [min(c, columns) for c in row], 1)
        out.append(np.packbits(np.cumsum(pixels[:columns]) & 1))
        above = row
        while len(above) > 1 and above[-1] == above[-2] == columns:
            above = above[:-1]
    blank = np.zeros((columns + 7) // 8, np.uint8)
    out += [blank] * max(0, rows - len(out))
    body = np.concatenate(out) if out else np.zeros(0, np.uint8)
    return (body if params.get("BlackIs1") else ~body).tobytes()


def _run_code(n: int, color: int) -> str:
    codes, out = (WHITE, BLACK)[color], ""
    while n >= 2560:
        out += LONG[-1]
        n -= 2560
    if n >= 1792:
        out += LONG[(n - 1792) // 64]
        n %= 64
    elif n >= 64:
        out += codes[63 + n // 64]
        n %= 64
    return out + codes[n]


def fax_encode(pixels: np.ndarray) -> bytes:
    """Group 4 of rows in which 1 is black."""
    names, out, above = {v: k for k, v in MODES.items()}, [], []
    columns = pixels.shape[1]
    for row in pixels.astype(np.int8):
        change = np.flatnonzero(np.diff(np.concatenate([[0], row]))).tolist()
        at, color = -1, 0
        while at < columns:
            right = [x for x in change if x > at or (at < 0 and x == 0)]
            a1 = right[0] if right else columns
            a2 = right[1] if len(right) > 1 else columns
            b1, b2 = _next_changes(above, at, color, columns)
            if b2 < a1:
                out.append(names["pass"])
                at = b2
            elif abs(a1 - b1) <= 3:
                out.append(names[a1 - b1])
                at, color = a1, color ^ 1
            else:
                out += [names["runs"], _run_code(a1 - max(at, 0), color), _run_code(a2 - a1, color ^ 1)]
                at = a2
        above = change
    text = "".join(out) + EOL * 2
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8)
