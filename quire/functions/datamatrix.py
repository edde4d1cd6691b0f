"""Data Matrix codes (ECC 200, square, 10 to 144 modules): rows of 0 and 1 modules, by the published symbology."""

from __future__ import annotations

#: Fixed values of each size: modules a side, words of data, words of error correction, regions a side, blocks.
SIZES = [
    (10, 3, 5, 1, 1), (12, 5, 7, 1, 1), (14, 8, 10, 1, 1), (16, 12, 12, 1, 1), (18, 18, 14, 1, 1), (20, 22, 18, 1, 1), (22, 30, 20, 1, 1), (24, 36, 24, 1, 1), (26, 44, 28, 1, 1),
    (32, 62, 36, 2, 1), (36, 86, 42, 2, 1), (40, 114, 48, 2, 1), (44, 144, 56, 2, 1), (48, 174, 68, 2, 1), (52, 204, 84, 2, 2),
    (64, 280, 112, 4, 2), (72, 368, 144, 4, 4), (80, 456, 192, 4, 4), (88, 576, 224, 4, 4), (96, 696, 272, 4, 4), (104, 816, 336, 4, 6),
    (120, 1050, 408, 6, 6), (132, 1304, 496, 6, 8), (144, 1558, 620, 6, 10),
]
_EXP = [1]
for _ in range(254):
    _EXP.append((_EXP[-1] << 1) ^ (0x12D if _EXP[-1] & 128 else 0))
_LOG = {v: k for k, v in enumerate(_EXP)}


def _times(a: int, b: int) -> int:
    return _EXP[(_LOG[a] + _LOG[b]) % 255] if a and b else 0


def error_words(data: list[int], n: int) -> list[int]:
    """Reed-Solomon words of a block."""
    generator = [1]
    for k in range(1, n + 1):
        generator = [a ^ _times(b, _EXP[k]) for a, b in zip(generator + [0], [0] + generator)]
    out = [0] * n
    for word in data:
        lead = word ^ out[0]
        out = [a ^ _times(g, lead) for a, g in zip(out[1:] + [0], generator[1:])]
    return out


def words_of(data: bytes) -> list[int]:
    """Words in ASCII encodation: pairs of digits are one word, bytes from 128 on are two."""
    out, at = [], 0
    while at < len(data):
        pair = data[at : at + 2]
        if len(pair) == 2 and pair.isdigit():
            out.append(130 + int(pair))
            at += 2
            continue
        out += [data[at] + 1] if data[at] < 128 else [235, data[at] - 127]
        at += 1
    return out


def places(n: int) -> list[list[tuple[int, int] | None]]:
    """For an n x n field the (word, bit) of each module, bit 1 the highest; None where nothing falls."""
    field: list[list[tuple[int, int] | None]] = [[None] * n for _ in range(n)]
    word = 0

    def put(cells):
        nonlocal word
        for bit, (r, c) in enumerate(cells, 1):
            if r < 0:
                r, c = r + n, c + 4 - (n + 4) % 8
            if c < 0:
                r, c = r + 4 - (n + 4) % 8, c + n
            field[r][c] = word, bit
        word += 1

    def corner(low: int, top: list[tuple[int, int]]):
        return [(n - low + k, 0) for k in range(low)] + top

    r, c = 4, 0
    while r < n or c < n:
        if (r, c) == (n, 0):
            put([(n - 1, 0), (n - 1, 1), (n - 1, 2), (0, n - 2), (0, n - 1), (1, n - 1), (2, n - 1), (3, n - 1)])
        elif (r, c) == (n - 2, 0) and n % 4:
            put(corner(3, [(0, n - 4), (0, n - 3), (0, n - 2), (0, n - 1), (1, n - 1)]))
        elif (r, c) == (n - 2, 0) and n % 8 == 4:
            put(corner(3, [(0, n - 2), (0, n - 1), (1, n - 1), (2, n - 1), (3, n - 1)]))
        elif (r, c) == (n + 4, 2) and not n % 8:
            put([(n - 1, 0), (n - 1, n - 1), (0, n - 3), (0, n - 2), (0, n - 1), (1, n - 3), (1, n - 2), (1, n - 1)])
        for step, turn in ((-2, (1, 3)), (2, (3, 1))):
            while True:
                if 0 <= r < n and 0 <= c < n and field[r][c] is None:
                    put([(r - 2, c - 2), (r - 2, c - 1), (r - 1, c - 2), (r - 1, c - 1), (r - 1, c), (r, c - 2), (r, c - 1), (r, c)])
                r, c = r + step, c - step
                if not (r >= 0 and c < n if step < 0 else r < n and c >= 0):
                    break
            r, c = r + turn[0], c + turn[1]
    return field


def data_matrix(data: bytes | str) -> list[str]:
    """The modules of the smallest symbol that holds the data; ValueError for what fits none."""
    words = words_of(data.encode("latin-1") if isinstance(data, str) else data)
    size = next((s for s in SIZES if s[1] >= len(words)), None)
    if size is None:
        raise ValueError("too long for a Data Matrix")
    side, capacity, errors, regions, blocks = size
    if len(words) < capacity:
        words.append(129)
    while len(words) < capacity:
        pad = 130 + 149 * (len(words) + 1) % 253
        words.append(pad if pad <= 254 else pad - 254)
    whole = words + [0] * errors
    for b in range(blocks):
        whole[capacity + b :: blocks] = error_words(words[b::blocks], errors // blocks)
    inner = side // regions - 2
    field = places(inner * regions)
    out = [[0] * side for _ in range(side)]
    for y in range(side):
        for x in range(side):
            v, u = y % (inner + 2), x % (inner + 2)
            if u == 0 or v == inner + 1:
                out[y][x] = 1
            elif v == 0:
                out[y][x] = 1 - u % 2
            elif u == inner + 1:
                out[y][x] = v % 2
            else:
                own = field[y // (inner + 2) * inner + v - 1][x // (inner + 2) * inner + u - 1]
                r, c = y // (inner + 2) * inner + v - 1, x // (inner + 2) * inner + u - 1
                out[y][x] = whole[own[0]] >> (8 - own[1]) & 1 if own else int(r - c == 0)
    return ["".join(map(str, row)) for row in out]
