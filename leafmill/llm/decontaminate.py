"""Benchmark decontamination: broadcast hash sets of normalised test n-grams, scanned over all documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leafmill.llm import wordhash as W
from leafmill.llm.tables import column, map_batches, spread

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("text", T.StringType()),
])


#: Words of a window that are longer than this in all are kept as a digest, so a set's size has a bound.
LONGEST = 256


class NgramSet:
    """Windows of benchmark items by hash, with their words to verify hits; a bitmap answers most lookups."""

    def __init__(self, bits: int = 22):
        self.by_hash: dict[int, dict[bytes, dict[str | None, None]]] = {}
        self.sizes: set[int] = set()
        self.windows, self.bits = 0, bits

    def add(self, key: int, size: int, words: bytes, item: str | None) -> None:
        self.sizes.add(size)
        items = self.by_hash.setdefault(key, {}).setdefault(words, {})
        if item not in items:
            items[item] = None
            self.windows += 1

    def sealed(self) -> NgramSet:
        self.keys = np.sort(np.fromiter(self.by_hash, np.uint64, len(self.by_hash)))
        self.bitmap = np.zeros(1 << self.bits, dtype=bool)
        self.bitmap[self.keys >> np.uint64(64 - self.bits)] = True
        return self

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bitmap[hashes >> np.uint64(64 - self.bits)])
        return at[np.isin(hashes[at], self.keys)]


def spelled(data: np.ndarray, words: W.Words, first: int, size: int) -> bytes:
    out = b" ".join(data[words.start[i] : words.end[i]].tobytes() for i in range(first, first + size))
    return out if len(out) <= LONGEST else b"\xff" + hashlib.sha256(out).digest()  # no word has the byte FF


def item_blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[NgramSet]:
    """Sets of `most` windows at most (an item's windows may lie in two); items come to the driver in turn."""
    found = NgramSet()
    for row in benchmark.toLocalIterator():
        if row.text is None:
            continue
        offsets, data = W.column_bytes(pa.array([row.text]), lower=True)
        words = W.words(offsets, data, W.ALNUM)
        size = min(window, len(words.hash))
        for i, key in enumerate(W.windows(words.hash, size).tolist() if size else []):
            found.add(key, size, spelled(data, words, i, size), row.item)
            if found.windows >= most:
                yield found.sealed()
                found = NgramSet()
    yield found.sealed()


def scan(blocks: Iterator[NgramSet], offsets: np.ndarray, data: np.ndarray) -> tuple[W.Words, np.ndarray, dict[int, set[str | None]]]:
    """(words, hit words, items by row) of one block of lower-cased rows."""
    words = W.words(offsets, data, W.ALNUM)
    hit, items, hashes = np.zeros(len(words.doc), dtype=bool), {}, {}
    for grams in blocks:
        for size in sorted(grams.sizes):
            if size not in hashes:
                hashes[size] = W.windows(words.hash, size)
            at = grams.candidates(hashes[size])
            for i in at[words.doc[at] == words.doc[at + size - 1]].tolist():
                if found := grams.by_hash[int(hashes[size][i])].get(spelled(data, words, i, size)):
                    hit[i : i + size] = True
                    items.setdefault(int(words.doc[i]), set()).update(found)
    return words, hit, items


def _in_turn(shared: list[Broadcast]) -> Iterator[NgramSet]:
    """The sets; of several a worker holds one at a time, the others stay in files of the machine."""
    for one in shared:
        yield one.value
        if len(shared) > 1:
            one.__dict__.pop("_value", None)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last exclusive) of each run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _scanner(at: int, shared: list[Broadcast], into: str):
    def rows(texts: pa.Array) -> Iterator[dict]:
        offsets, raw = W.column_bytes(texts)
        for lo, hi in W.blocks(len(texts), offsets, W.MB if len(shared) == 1 else 8 * W.MB):
            begin, part = offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]]
            words, hit, items = scan(_in_turn(shared), begin, W.LOWER[part])
            begins = np.concatenate([[0], np.cumsum(W.row_counts(words.doc, hi - lo))])
            for i in range(hi - lo):
                b, e = int(begins[i]), int(begins[i + 1])
                if i not in items:
                    yield {"n_words": e - b, "n_hit": 0, "items": [], "spans": [], "text": texts[lo + i].as_py() or ""}
                    continue
                spans, kept, done = _runs(hit[b:e]), [], int(begin[i])
                for s, t in spans:
                    kept.append(part[done : words.start[b + s]].tobytes())
                    done = int(words.end[b + t - 1])
                kept.append(part[done : begin[i + 1]].tobytes())
                names = sorted(items[i] - {None}) + [None] * (None in items[i])
                yield {"n_words": e - b, "n_hit": int(hit[b:e].sum()), "items": names, "spans": [{"first": s, "last": t} for s, t in spans], "text": b"".join(kept).decode()}

    kind = pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("text", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(rows(batch.column(at))), type=kind)], names=[*batch.schema.names, into])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", into: str = "found", block_windows: int = 200_000) -> DataFrame:
    r"""Adds the struct column `into`: n_words, n_hit, items (sorted as strings), spans (word positions, last
    exclusive), text (without the spans).

    Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z is lower-cased; a window is `window` consecutive words of
    an item, or a shorter item as a whole; items without words have none. Hits are verified word by word (windows of over
    256 bytes by SHA-256). A null text has no words and its result text is empty; a null item text has no windows; with an empty
    benchmark nothing is hit. Items with a null id count like any other, as one null at the end of `items`. Repeated
    rows and items and other columns do no harm; a column named `into` is replaced.

    No shuffle (but for tables of a few MB, tables.spread()) and one pass over the documents, whatever the benchmark's size: its windows are
    broadcast in blocks of `block_windows` at most (100 MB), and a worker goes through the blocks one at a time, for 8 MB of
    documents each."""
    docs = docs.drop(into)
    items = benchmark.select(column(item).cast("string").alias("item"), column(item_text).cast("string").alias("text"))
    shared = [docs.sparkSession.sparkContext.broadcast(x) for x in item_blocks(items, window, block_windows)]
    schema = T.StructType([*docs.schema.fields, T.StructField(into, FOUND)])
    return spread(docs).transform(map_batches, _scanner(docs.columns.index(text), shared, into), schema)
