"""One-dimensional barcodes as column expressions: strings of 1 (bar) and 0 (space) modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: EAN-13 left odd codes and the parity of the first digit.
EAN_ODD = ["0001101", "0011001", "0010011", "0111101", "0100011", "0110001", "0101111", "0111011", "0110111", "0001011"]
EAN_PARITY = ["OOOOOO", "OOEOEE", "OOEEOE", "OOEEEO", "OEOOEE", "OEEOOE", "OEEEOO", "OEOEOE", "OEOEEO", "OEEOEO"]
#: Code 39 letters, and where each has its wide elements (of nine).
CODE39 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-. *$/+%"


def _flip(code: str) -> str:
    return code.translate(str.maketrans("01", "10"))


def ean13_digits(text: Column) -> Column:
    """Twelve digits and their check digit; null for what is no 12 or 13 digits with a right check digit."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.substring(text, i, F.lit(1)).try_cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: d * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, b: a + b)
    check = ((10 - total % 10) % 10).cast("string")
    full = F.concat(F.substring(text, 1, 12), check)
    return F.when(text.rlike(r"^\d{12}$") | (text.rlike(r"^\d{13}$") & (text == full)), full)


def ean13(text: Column) -> Column:
    """95 modules of an EAN-13 symbol."""
    code = ean13_digits(text)
    odd, right = F.array(*map(F.lit, EAN_ODD)), F.array(*(F.lit(_flip(c)) for c in EAN_ODD))
    even = F.array(*(F.lit(_flip(c)[::-1]) for c in EAN_ODD))
    digit = lambda i: F.substring(code, i, F.lit(1)).cast("int") + 1
    parity = F.element_at(F.array(*map(F.lit, EAN_PARITY)), digit(F.lit(1)))
    left = F.transform(F.sequence(F.lit(2), F.lit(7)), lambda i: F.when(F.substring(parity, i - 1, F.lit(1)) == "O", F.element_at(odd, digit(i))).otherwise(F.element_at(even, digit(i))))
    rest = F.transform(F.sequence(F.lit(8), F.lit(13)), lambda i: F.element_at(right, digit(i)))
    return F.when(code.isNotNull(), F.concat(F.lit("101"), F.array_join(left, ""), F.lit("01010"), F.array_join(rest, ""), F.lit("101")))


def code39_table() -> dict[str, str]:
    """Modules of each letter, from the symbology's rule: two of five bars wide and one of four spaces, or three wide spaces."""
    bars = {1: "10001", 2: "01001", 3: "11000", 4: "00101", 5: "10100", 6: "01100", 7: "00011", 8: "10010", 9: "01010", 0: "00110"}
    out = {}
    groups = [("1234567890", 1), ("ABCDEFGHIJ", 2), ("KLMNOPQRST", 3), ("UVWXYZ-. *", 0)]
    for letters, wide_space in groups:
        for k, letter in enumerate(letters):
            wide_bars = bars[(k + 1) % 10]
            spaces = ["0"] * 4
            spaces[wide_space] = "1"
            out[letter] = _modules(wide_bars, "".join(spaces))
    for letter, narrow in (("$", 3), ("/", 2), ("+", 1), ("%", 0)):
        out[letter] = _modules("00000", "".join("0" if k == narrow else "1" for k in range(4)))
    return out


def _modules(bars: str, spaces: str, wide: int = 3) -> str:
    out = ""
    for k in range(9):
        element = bars[k // 2] if k % 2 == 0 else spaces[k // 2]
        out += ("1" if k % 2 == 0 else "0") * (wide if element == "1" else 1)
    return out


def code39(text: Column) -> Column:
    """Start, the letters and stop, with a narrow space between; null if a letter has no code."""
    table = code39_table()
    letters = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    framed = F.concat(F.lit("*"), F.upper(text), F.lit("*"))
    codes = F.transform(F.split(framed, ""), lambda c: F.element_at(letters, c))
    return F.when(F.upper(text).rlike(r"^[0-9A-Z\-. $/+%]*$"), F.array_join(F.filter(codes, lambda c: c.isNotNull()), "0"))


def code128_values(text: Column) -> Column:
    """Symbol values of code set B with start, check and stop; null if a letter has no code."""
    values = F.transform(F.split(text, ""), lambda c: F.ascii(c) - 32)
    total = F.aggregate(F.transform(values, lambda v, i: v * (i + 1)), F.lit(104), lambda a, b: a + b)
    return F.when(text.rlike(r"^[ -~]+$"), F.concat(F.array(F.lit(104)), values, F.array(total % 103, F.lit(106))))


#: Widths of bars and spaces of the Code 128 symbols, by value; the last is the stop.
CODE128 = (
    "212222 222122 222221 121223 121322 131222 122213 122312 132212 221213 221312 231212 112232 122132 122231 113222 123122 123221 223211 221132 "
    "221231 213212 223112 312131 311222 321122 321221 312212 322112 322211 212123 212321 232121 111323 131123 131321 112313 132113 132311 211313 "
    "231113 231311 112133 112331 132131 113123 113321 133121 313121 211331 231131 213113 213311 213131 311123 311321 331121 312113 312311 332111 "
    "314111 221411 431111 111224 111422 121124 121421 141122 141221 112214 112412 122114 122411 142112 142211 241211 221114 413111 241112 134111 "
    "111242 121142 121241 114212 124112 124211 411212 421112 421211 212141 214121 412121 111143 111341 131141 114113 114311 411113 411311 113141 "
    "114131 311141 411131 211412 211214 211232 2331112"
).split()


def code128(text: Column) -> Column:
    """Modules of a Code 128 symbol (set B)."""
    modules = ["".join(("1", "0")[k % 2] * int(w) for k, w in enumerate(widths)) for widths in CODE128]
    table = F.array(*map(F.lit, modules))
    values = code128_values(text)
    return F.when(values.isNotNull(), F.array_join(F.transform(values, lambda v: F.element_at(table, v + 1)), ""))
