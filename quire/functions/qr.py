"""QR codes (byte mode, versions 1 to 10): rows of 0 and 1 modules, by the published symbology."""

from __future__ import annotations

#: Error correction words of a block and numbers of blocks for versions 1 to 10, by level.
EC_WORDS = {"L": [7, 10, 15, 20, 26, 18, 20, 24, 30, 18], "M": [10, 16, 26, 18, 24, 16, 18, 22, 22, 26], "Q": [13, 22, 18, 26, 18, 24, 18, 22, 20, 24], "H": [17, 28, 22, 16, 22, 28, 26, 26, 24, 28]}
BLOCKS = {"L": [1, 1, 1, 1, 1, 2, 2, 2, 2, 4], "M": [1, 1, 1, 2, 2, 4, 4, 4, 5, 5], "Q": [1, 1, 2, 2, 4, 4, 6, 6, 8, 8], "H": [1, 1, 2, 4, 4, 4, 5, 6, 8, 8]}
LEVEL_BITS = {"L": 1, "M": 0, "Q": 3, "H": 2}

_EXP = [1]
for _ in range(254):
    _EXP.append((_EXP[-1] << 1) ^ (0x11D if _EXP[-1] & 128 else 0))
_LOG = {v: k for k, v in enumerate(_EXP)}


def _times(a: int, b: int) -> int:
    return _EXP[(_LOG[a] + _LOG[b]) % 255] if a and b else 0


def error_words(data: list[int], n: int) -> list[int]:
    """Reed-Solomon words: the remainder of the data by the generator of n roots."""
    generator = [1]
    for k in range(n):
        generator = [a ^ _times(b, _EXP[k]) for a, b in zip(generator + [0], [0] + generator)]
    out = [0] * n
    for byte in data:
        lead = byte ^ out[0]
        out = [a ^ _times(g, lead) for a, g in zip(out[1:] + [0], generator[1:])]
    return out


def _alignment(version: int) -> list[int]:
    if version == 1:
        return []
    count, size = version // 7 + 2, 17 + 4 * version
    step = -(-(size - 13) // (2 * count - 2)) * 2
    return [6] + [size - 7 - k * step for k in range(count - 2, -1, -1)]


def _raw_words(version: int) -> int:
    bits = (16 * version + 128) * version + 64
    if version > 1:
        n = version // 7 + 2
        bits -= (25 * n - 10) * n - 55
        bits -= 36 if version > 6 else 0
    return bits // 8


def _remainder(value: int, generator: int, bits: int) -> int:
    rest = value << bits
    for k in range(rest.bit_length() - 1, bits - 1, -1):
        if rest >> k & 1:
            rest ^= generator << (k - bits)
    return rest


_MASKS = [
    lambda r, c: (r + c) % 2 == 0, lambda r, c: r % 2 == 0, lambda r, c: c % 3 == 0, lambda r, c: (r + c) % 3 == 0,
    lambda r, c: (r // 2 + c // 3) % 2 == 0, lambda r, c: r * c % 2 + r * c % 3 == 0, lambda r, c: (r * c % 2 + r * c % 3) % 2 == 0, lambda r, c: ((r + c) % 2 + r * c % 3) % 2 == 0,
]


def _words(data: bytes, version: int, level: str) -> list[int]:
    """Data and error words, interleaved."""
    raw, n, blocks = _raw_words(version), EC_WORDS[level][version - 1], BLOCKS[level][version - 1]
    room = raw - n * blocks
    length = 8 if version < 10 else 16
    bits = f"0100{len(data):0{length}b}" + "".join(f"{b:08b}" for b in data)
    bits += "0" * min(4, 8 * room - len(bits))
    bits += "0" * (-len(bits) % 8)
    words = [int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)]
    words += [(0xEC, 0x11)[k % 2] for k in range(room - len(words))]
    short, longer = room // blocks, room % blocks
    parts, at = [], 0
    for k in range(blocks):
        size = short + (k >= blocks - longer)
        parts.append(words[at : at + size])
        at += size
    errors = [error_words(p, n) for p in parts]
    out = [p[k] for k in range(short + 1) for p in parts if k < len(p)]
    return out + [e[k] for k in range(n) for e in errors]


def qr_code(text: str, level: str = "M") -> list[list[int]]:
    """Modules of the smallest symbol that holds a text; ValueError if none up to version 10 does."""
    data = text.encode()
    for version in range(1, 11):
        room = _raw_words(version) - EC_WORDS[level][version - 1] * BLOCKS[level][version - 1]
        if len(data) + (2 if version < 10 else 3) <= room:
            break
    else:
        raise ValueError("the text is too long")
    size = 17 + 4 * version
    grid = [[-1] * size for _ in range(size)]

    def put(r, c, v):
        if 0 <= r < size and 0 <= c < size:
            grid[r][c] = int(v)

    for r0, c0 in ((3, 3), (3, size - 4), (size - 4, 3)):
        for dr in range(-4, 5):
            for dc in range(-4, 5):
                put(r0 + dr, c0 + dc, max(abs(dr), abs(dc)) not in (2, 4))
    places = _alignment(version)
    for r in places:
        for c in places:
            if (r, c) not in ((6, 6), (6, size - 7), (size - 7, 6)):
                for dr in range(-2, 3):
                    for dc in range(-2, 3):
                        put(r + dr, c + dc, max(abs(dr), abs(dc)) != 1)
    for k in range(8, size - 8):
        put(6, k, k % 2 == 0)
        put(k, 6, k % 2 == 0)
    put(size - 8, 8, 1)
    formats = [(k + (k > 5), 8, k) for k in range(8)] + [(8, 7, 8)] + [(8, 14 - k, k) for k in range(9, 15)]
    formats += [(8, size - 1 - k, k) for k in range(8)] + [(size - 15 + k, 8, k) for k in range(8, 15)]
    for r, c, _ in formats:
        grid[r][c] = max(grid[r][c], 0)
    if version >= 7:
        value = version << 12 | _remainder(version, 0x1F25, 12)
        for k in range(18):
            put(k // 3, size - 11 + k % 3, value >> k & 1)
            put(size - 11 + k % 3, k // 3, value >> k & 1)
    bits = [int(b) for w in _words(data, version, level) for b in f"{w:08b}"]
    free, c = [], size - 1
    while c > 0:
        c -= c == 6
        for k in range(size):
            r = size - 1 - k if ((size - 1 - c) // 2 % 2 == 0 if c > 6 else (size - 2 - c) // 2 % 2 == 0) else k
            free += [(r, x) for x in (c, c - 1) if grid[r][x] < 0]
        c -= 2
    assert len(free) // 8 == _raw_words(version)
    for (r, x), bit in zip(free, bits + [0] * 8):
        grid[r][x] = bit
    cells = set(free)
    best = None
    for number, mask in enumerate(_MASKS):
        own = [[v ^ (mask(r, c) and (r, c) in cells) for c, v in enumerate(row)] for r, row in enumerate(grid)]
        head = LEVEL_BITS[level] << 3 | number
        value = (head << 10 | _remainder(head, 0x537, 10)) ^ 0x5412
        for r, x, k in formats:
            own[r][x] = value >> k & 1
        own[size - 8][8] = 1
        score = _penalty(own)
        if best is None or score < best[0]:
            best = score, own
    return best[1]


def _penalty(grid) -> int:
    size, total = len(grid), 0
    lines = ["".join(map(str, map(int, row))) for row in grid] + ["".join(str(int(row[c])) for row in grid) for c in range(size)]
    import re

    for line in lines:
        total += sum(len(m[0]) - 2 for m in re.finditer(r"0{5,}|1{5,}", line))
        total += 40 * (len(re.findall(r"(?=10111010000)", line)) + len(re.findall(r"(?=00001011101)", line)))
    total += 3 * sum(grid[r][c] == grid[r][c + 1] == grid[r + 1][c] == grid[r + 1][c + 1] for r in range(size - 1) for c in range(size - 1))
    dark = sum(map(sum, grid))
    return total + 10 * int(abs(20 * dark - 10 * size * size) // (size * size))
