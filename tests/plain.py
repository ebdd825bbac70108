"""Plain restatements of rules, by which the engine is tested."""

import re

# Characters that end a sentence or a block; starts of blocks; brackets that no space follows; ideographs.
ENDS, OPENERS = "。！？；?!.．)]】」』\"'`", "([{「『【《"
BLOCK = re.compile(r"#{1,6}\s|[-*+]\s|\d+\.\s|>\s|```|\|\s")
IDEOGRAPHS = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2F800, 0x2FA1F)]


def paragraphs(page):
    """Runs of lines that aren't blank."""
    found = [[]]
    for line in (page or "").strip().split("\n"):
        if line.strip():
            found[-1].append(line)
        elif found[-1]:
            found.append([])
    return ["\n".join(lines) for lines in found if lines]


def is_header_rule(line):
    cells = line.strip().removeprefix("|").removesuffix("|").split("|")
    return len(cells) > 1 and all(re.fullmatch(r"\s*:?--+:?\s*", x) for x in cells)


def is_ideograph(c):
    return any(a <= ord(c) <= b for a, b in IDEOGRAPHS)


def met(above, below):
    """The block that two blocks on either side of a page's end make; None if the second is a block of its own."""
    above, last = above.rstrip(), above.rstrip().rpartition("\n")[2]
    mark = last.lstrip()[:1]
    if mark == "|" and last[-1] != "|":
        rows = below.split("\n")
        body = rows[2:] if len(rows) > 2 and is_header_rule(rows[1]) else rows
        return f"{above} |\n" + "\n".join(body).lstrip()
    if mark == "#" or last[-1] in ENDS or BLOCK.match(below.lstrip().partition("\n")[0]):
        return None
    return above + " " * (last[-1] not in OPENERS and not is_ideograph(last[-1]) and not is_ideograph(below[0])) + below


def stitched(pages, compat=False):
    out = []
    for first, *rest in filter(None, map(paragraphs, pages)):
        joined = met(out[-1], first) if out else None
        if joined is None:
            out += [first, *rest]
        else:
            out[-1:] = rest if compat and rest else [joined, *rest]
    return "\n\n".join(out)
