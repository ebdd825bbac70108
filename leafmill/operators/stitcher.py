"""The rules of stitching on Python strings, for workers that take a document's pages one after the other."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from leafmill.functions import text as X

_SPACE = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", X.SPACE)
_IDEOGRAPHS = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", X.IDEOGRAPHS)
_OPENS = re.compile(X.BLOCK_START.replace(X.SPACE, _SPACE).replace(r"\p{Nd}", r"\d"))
_FINISHED = re.compile(X.SENTENCE_END.replace(r"\z", r"\Z"))
_SEPARATOR = re.compile(X.TABLE_SEPARATOR.replace(X.SPACE, _SPACE).replace(r"\z", r"\Z"))
_BLANK = re.compile(rf"\n[{_SPACE}]*\n")


class Stitcher:
    """Takes pages in order and gives finished blocks; the last block stays until it is known what follows.

    The state is the unfinished block as its pieces, and the facts about its last line that decide what may follow."""

    def __init__(self, compat: bool = False):
        self.compat, self.held = compat, []
        self.start = self.line = ""

    def feed(self, page: str) -> Iterator[str]:
        parts = [b for b in (x.strip("\n") for x in _BLANK.split(page.strip(X.SPACES))) if b.strip(X.SPACES)]
        if not parts:
            return
        kind = self.kind(parts[0])
        if kind == "new":
            yield from self.finish()
        else:
            parts = self._extend(kind, parts)
            if parts and not self.compat:
                yield from self.finish()
        if parts:
            yield from parts[:-1]
            self.held, self.line = [parts[-1]], parts[-1].rstrip(X.SPACES).rpartition("\n")[2]
            self.start = self.line.lstrip(X.SPACES)[:1]

    def kind(self, block: str) -> str:
        if not self.held or self.start == "#":
            return "new"
        if self.start == "|" and not self.line.endswith("|"):
            return "table"
        return "new" if _FINISHED.search(self.line) or _OPENS.match(block.partition("\n")[0]) else "text"

    def _extend(self, kind: str, parts: list[str]) -> list[str]:
        """Joins the first block to the held one; what is left of the page."""
        block = parts[0]
        if kind == "table":
            lines = block.split("\n")
            if len(lines) >= 3 and _SEPARATOR.match(lines[1].strip(X.SPACES)):
                block = "\n".join(lines[2:])
            self.held += [" |\n", block.lstrip(X.SPACES)]
            fresh = True
        else:
            tight = self.line[-1:] in X.OPENERS or re.match(f"[{_IDEOGRAPHS}]", self.line[-1:]) or re.match(f"[{_IDEOGRAPHS}]", block[:1])
            self.held += ["" if tight else " ", block]
            fresh = "\n" in block
        self.line = block.rstrip(X.SPACES).rpartition("\n")[2]
        if fresh:
            self.start = self.line.lstrip(X.SPACES)[:1]
        return parts[1:]

    def finish(self) -> Iterator[str]:
        if self.held:
            yield "".join(self.held)
        self.held, self.start, self.line = [], "", ""


def stitch_pages(pages: Iterable[str], compat: bool = False) -> str:
    stitcher = Stitcher(compat)
    return "\n\n".join([*(b for page in pages for b in stitcher.feed(page)), *stitcher.finish()])
