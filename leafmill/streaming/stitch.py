"""Stitching over a stream of pages: blocks come out as soon as no later page can change them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.stitcher import Stitcher

OUT = "doc_id string, position long, block string"
STATE = "next_page int, last_page int, emitted long, held string, pending string"


def stitch_stream(pages: DataFrame, compat: bool = False, idle_ms: int | None = None) -> DataFrame:
    """(doc_id, position, block) from a stream of (doc_id, page_number, markdown, last_page).

    Pages of a document are numbered from 1 and may come in any order; last_page is null, or the number of the last
    page, on any page from which it is known. Pages that come early wait in the state (as a map by number) and are taken in
    order; a page that comes again is ignored. When the last page has been taken the held block is given, and of the state
    only the numbers stay. With `idle_ms`, a document of which no page has come for so long is taken to be over: what is there is
    given in order, later pages are ignored, and after as long again it is forgotten. Blocks of a document in order of position, with blank lines between, are stitch()'s text."""
    given = pages.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_number").cast("int").alias("page_number"), "markdown", F.col("last_page").cast("int").alias("last_page"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        expected, end, emitted, held, waiting = state.get if state.exists else (1, -1, 0, "", "{}")
        over = state.hasTimedOut
        if over and 0 <= end < expected:
            state.remove()
            return
        stitcher, pending = Stitcher(compat), {int(k): v for k, v in json.loads(waiting).items()}
        if held:
            stitcher.held, stitcher.start, stitcher.line = json.loads(held)
        for batch in batches:
            for number, text, last in zip(batch.page_number, batch.markdown, batch.last_page, strict=True):
                if not pd.isna(last):
                    end = int(last)
                if number >= expected:
                    pending.setdefault(int(number), text or "")
        blocks = []
        if over:
            expected, end = max([expected - 1, *pending]) + 1, max([expected - 1, *pending])
            for number in sorted(pending):
                blocks += stitcher.feed(pending[number])
        while expected in pending and not over:
            blocks += stitcher.feed(pending.pop(expected))
            expected += 1
        if 0 <= end < expected:
            blocks += stitcher.finish()
            pending = {}
        rest = json.dumps([["".join(stitcher.held)], stitcher.start, stitcher.line]) if stitcher.held else ""
        state.update((expected, end, emitted + len(blocks), rest, json.dumps(pending)))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"doc_id": [key[0]] * len(blocks), "position": range(emitted, emitted + len(blocks)), "block": blocks})

    return given.groupBy("doc_id").applyInPandasWithState(run, OUT, STATE, "append", "ProcessingTimeTimeout" if idle_ms else "NoTimeout")
