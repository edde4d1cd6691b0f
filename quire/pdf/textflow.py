"""Text in a box: measuring, wrapping, alignment; and runs of writing direction."""

from __future__ import annotations

import unicodedata

from quire.pdf.fonts import standard_width


def text_width(text: str, size: float = 12, font: str = "Helvetica", char_spacing: float = 0.0, word_spacing: float = 0.0) -> float:
    return sum(standard_width(font, ord(c)) / 1000 * size + char_spacing + (word_spacing if c == " " else 0) for c in text)


def _broken(word: str, width: float, measure) -> list[str]:
    out, held = [], ""
    for c in word:
        if held and measure(held + c) > width + 1e-9:
            out.append(held)
            held = c
        else:
            held += c
    return out + [held]


def wrap_paragraph(text: str, width: float, size: float = 12, font: str = "Helvetica", indent: float = 0.0) -> list[str]:
    """Lines of a paragraph: runs of white space count as one blank, words that are too long are broken, the first line is indented."""
    measure = lambda t: text_width(t, size, font)
    out, held = [], ""
    for word in text.split():
        room = width - (indent if not out else 0)
        longer = f"{held} {word}" if held else word
        if measure(longer) <= room + 1e-9:
            held = longer
            continue
        if held:
            out.append(held)
        pieces = _broken(word, width, measure)
        out += pieces[:-1]
        held = pieces[-1]
    return out + [held] if held or not out else out


def layout_text(text: str, width: float, height: float = float("inf"), size: float = 12, font: str = "Helvetica", align: str = "left", leading: float = 1.2, indent: float = 0.0) -> dict:
    """Lines with their places in a box (from its top left), and what does not fit: lines, overflow, height."""
    lines, rest, y = [], [], size
    for paragraph in text.split("\n"):
        wrapped = wrap_paragraph(paragraph, width, size, font, indent)
        for k, line in enumerate(wrapped):
            if y > height + 1e-9:
                rest.append(line)
                continue
            own, left = text_width(line, size, font), indent if k == 0 else 0.0
            gaps = line.count(" ")
            spread = (width - left - own) / gaps if align == "justify" and gaps and k + 1 < len(wrapped) else 0.0
            x = {"center": (width - own) / 2, "right": width - own}.get(align, left)
            lines.append({"text": line, "x": x, "y": y, "width": own, "word_spacing": spread})
            y += size * leading
    return {"lines": lines, "overflow": rest, "height": len(lines) * size * leading}


def direction_runs(text: str) -> list[tuple[int, int, int]]:
    """(start, end, level) of runs: even levels are written from the left. Marks that embed or override are ordinary here."""
    kinds = [unicodedata.bidirectional(c) or "L" for c in text]
    base = next((1 if k in ("R", "AL") else 0 for k in kinds if k in ("L", "R", "AL")), 0)
    strong = "R" if base else "L"
    last = strong
    own = []
    for k, kind in enumerate(kinds):
        if kind == "NSM":
            kind = own[-1] if own else strong
        if kind in ("L", "R", "AL"):
            last = kind
        if kind == "EN" and last == "AL":
            kind = "AN"
        if kind in ("ES", "CS") and 0 < k < len(kinds) - 1 and kinds[k - 1] == kinds[k + 1] and kinds[k - 1] in ("EN", "AN"):
            kind = own[-1]
        own.append("R" if kind == "AL" else "L" if kind == "EN" and last == "L" else kind)
    settled = {"L", "R", "EN", "AN"}
    for k, kind in enumerate(own):
        if kind not in settled:
            before = next((own[j] for j in range(k - 1, -1, -1)), strong)
            after = next((own[j] for j in range(k + 1, len(own)) if own[j] in settled), strong)
            side = lambda x: "R" if x in ("R", "EN", "AN") else "L"
            own[k] = side(before) if side(before) == side(after) else strong
    level = lambda x: {"L": base + base % 2, "R": 1}.get(x, 2)
    levels = [level(x) for x in own]
    out: list[tuple[int, int, int]] = []
    for k, v in enumerate(levels):
        if out and out[-1][2] == v:
            out[-1] = (out[-1][0], k + 1, v)
        else:
            out.append((k, k + 1, v))
    return out


def visual(text: str) -> str:
    """A line's characters in the order in which they stand."""
    runs = direction_runs(text)
    top = max((r[2] for r in runs), default=0)
    pieces = [(v, text[a:b]) for a, b, v in runs]
    for v in range(top, 0, -1):
        out, k = [], 0
        while k < len(pieces):
            j = k
            while j < len(pieces) and pieces[j][0] >= v:
                j += 1
            out += [(x[0], x[1][::-1]) for x in reversed(pieces[k:j])] if j > k else [pieces[k]]
            k = max(j, k + 1)
        pieces = out
    return "".join(p[1] for p in pieces)
