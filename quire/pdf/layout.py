"""From glyphs to words, lines, columns and blocks, for one page."""

from __future__ import annotations

#: A word ends at a gap or a rise of more than so much of the last glyph's size; words within so much of a line's first one are of the line.
WORD_GAP, WORD_RISE, LINE_RISE = 0.3, 0.5, 0.5
#: Line starts so near are one; a gap of more than this share of their spread, and this much at least, parts columns; a line without words is so wide.
START_STEP, COLUMN_SHARE, COLUMN_GAP, EMPTY_WIDTH = 5.0, 0.15, 30.0, 100.0
#: A gap of more than so many sizes parts blocks; the size of a line without words.
BLOCK_GAP, EMPTY_SIZE = 2.0, 12.0


def words_of(chars: list[tuple]) -> list[dict]:
    """Words of glyphs (text, x, y, size, font, width): a gap over 0.3 of the size, a rise over 0.5 of it, or a space ends one."""
    out, held = [], None
    for k, (text, x, y, size, _, width) in enumerate(chars):
        if k:
            _, px, py, psize, _, pwidth = chars[k - 1]
            if abs(x - (px + pwidth)) > WORD_GAP * psize or abs(y - py) > WORD_RISE * psize:
                held = None
        if text == " ":
            held = None
            continue
        if held is None:
            held = {"text": "", "x": x, "y": y, "width": 0.0, "font_size": size}
            out.append(held)
        held["text"] += text
        held["width"] = x + width - held["x"]
    for w in out:
        w["text"] = w["text"].strip()
    return [w for w in out if w["text"]]


def lines_of(words: list[dict]) -> list[dict]:
    """Lines from top to bottom; a word more than half its size off the first word of the line starts a new one."""
    groups: list[list[dict]] = []
    for w in sorted(words, key=lambda w: (-w["y"], w["x"])):
        if groups and abs(w["y"] - groups[-1][0]["y"]) <= LINE_RISE * w["font_size"]:
            groups[-1].append(w)
        else:
            groups.append([w])
    out = []
    for g in groups:
        g = sorted(g, key=lambda w: w["x"])
        out.append({"text": " ".join(w["text"] for w in g), "x": g[0]["x"], "y": g[0]["y"], "words": g})
    return out


def _right(line: dict) -> float:
    last = line["words"][-1] if line["words"] else None
    return last["x"] + last["width"] if last else line["x"] + EMPTY_WIDTH


def columns_of(lines: list[dict]) -> list[tuple[float, float]]:
    """Column ranges: clusters of line starts with gaps over 15 % of their spread (30 at least); every column needs two lines."""
    starts: list[float] = []
    for x in sorted(line["x"] for line in lines):
        if not starts or x - starts[-1] >= START_STEP:
            starts.append(x)
    if not starts:
        return []
    gap = max(COLUMN_SHARE * (starts[-1] - starts[0]), COLUMN_GAP)
    clusters = [[starts[0], starts[0]]]
    for x in starts[1:]:
        if x - clusters[-1][1] > gap:
            clusters.append([x, x])
        else:
            clusters[-1][1] = x
    near = lambda low, high: [line for line in lines if low - START_STEP <= line["x"] <= high + START_STEP]
    out = [(low, max([high, *map(_right, near(low, high))])) for low, high in clusters]
    if len(out) > 1 and any(len(near(low, high)) < 2 for low, high in out):
        return [(out[0][0], out[-1][1])]
    return out


def block_text(lines: list[str], mode: str = "reference") -> str:
    """A block's text. A line's hyphen at the end is taken away; mode "joined" also joins its word with the next line."""
    if mode == "joined":
        out = ""
        for k, line in enumerate(lines):
            if k + 1 < len(lines) and line.endswith("-"):
                out += line.rstrip("-")
            else:
                out += line + ("\n" if k + 1 < len(lines) else "")
        return out
    out_lines: list[str] = []
    for k, line in enumerate(lines):
        if k + 1 < len(lines) and line.endswith("-"):
            bare = line.rstrip("-")
            if out_lines:
                out_lines[-1] += " " + bare
            else:
                out_lines.append(bare)
        elif out_lines and out_lines[-1].endswith("-"):
            out_lines[-1] += line
        else:
            out_lines.append(line)
    return "\n".join(out_lines)


def _blocks(lines: list[dict], mode: str) -> list[dict]:
    groups: list[list[dict]] = []
    for k, line in enumerate(lines):
        size = lines[k - 1]["words"][0]["font_size"] if k and lines[k - 1]["words"] else EMPTY_SIZE
        if k and abs(lines[k - 1]["y"] - line["y"]) <= BLOCK_GAP * size:
            groups[-1].append(line)
        else:
            groups.append([line])
    return [{"text": block_text([x["text"] for x in g], mode), "lines": g} for g in groups]


def blocks_of(lines: list[dict], mode: str = "reference") -> list[dict]:
    """Blocks in reading order: column by column, and in a column a gap of over two sizes starts a new one."""
    columns = columns_of(lines)
    if len(columns) <= 1:
        return _blocks(lines, mode)
    held: list[list[dict]] = [[] for _ in columns]
    for line in lines:
        held[min(range(len(columns)), key=lambda k: (abs(line["x"] - sum(columns[k]) / 2), k))].append(line)
    out = []
    for own in held:
        out += _blocks(sorted(own, key=lambda x: -x["y"]), mode)
    return out


def plain_text(blocks: list[dict]) -> str:
    return "\n\n".join(b["text"] for b in blocks)


def reading_order(words: list[dict]) -> list[dict]:
    """Words by lines from the top, each from the left; close heights (half the larger size) are one line."""
    out: list[list[dict]] = []
    for w in sorted(words, key=lambda w: -w["y"]):
        if out and abs(out[-1][0]["y"] - w["y"]) < LINE_RISE * max(out[-1][0]["font_size"], w["font_size"]):
            out[-1].append(w)
        else:
            out.append([w])
    return [w for line in out for w in sorted(line, key=lambda w: w["x"])]
