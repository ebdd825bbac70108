"""Substring dedup: passages that start earlier in the corpus are removed, by suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import wordhash as W
from leafmill.llm.tables import column, cut, map_batches, row_keys, scratch, spread

#: Words of the n-gram that routes a passage to its shard.
ANCHOR = 6
#: Anchors with more passages than this are routed window by window.
HOT = 1_000


class SuffixAutomaton:
    """Of several sequences; transitions are dicts, built online."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """A copy of q for the suffixes of p + symbol."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            p, q = last, self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
                continue
            last = self._state(self.length[p] + 1, 0, {})
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)

    def matching(self, sequence: list[int]) -> list[int]:
        """For each position the length of the longest match that ends there."""
        state, n, out = 0, 0, []
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if symbol in self.next[state]:
                state, n = self.next[state][symbol], n + 1
            out.append(n)
        return out


def runs(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of runs of neighbouring positions, which are sorted."""
    if not len(positions):
        return positions, positions
    breaks = np.flatnonzero(np.diff(positions) != 1)
    return positions[np.concatenate([[0], breaks + 1])], positions[np.concatenate([breaks, [len(positions) - 1]])]


def smallest_at(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest of every `width` neighbours."""
    n, size = len(values) - width + 1, 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at = values, np.arange(len(values))

    def either(step: int) -> tuple[np.ndarray, np.ndarray]:
        take = low[step:] < low[:-step]
        return np.where(take, low[step:], low[:-step]), np.where(take, at[step:], at[:-step])

    while 2 * size <= width:
        low, at = either(size)
        size *= 2
    if size < width:
        low, at = either(width - size)
    return at[:n]


class Anchored:
    """Words of some rows, their windows, and for each window its anchor: the first smallest n-gram hash in it. Equal
    windows have equal anchors at equal places."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, rows: int, window: int):
        words = W.words(offsets, data, W.NON_SPACE)
        self.hash, self.doc = words.hash, words.doc
        self.counts = W.row_counts(words.doc, rows)
        self.begins = np.concatenate([[0], np.cumsum(self.counts)])
        fits = max(0, len(words.doc) - window + 1)
        self.windows = np.flatnonzero(words.doc[:fits] == words.doc[len(words.doc) - fits :])
        self.grams = W.windows(words.hash, min(ANCHOR, window))
        self.anchor = smallest_at(self.grams, window - min(ANCHOR, window) + 1)[self.windows]

    def local(self, i: int, positions: np.ndarray) -> np.ndarray:
        return positions - self.begins[i]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], type=kind))


def _row_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    offsets, raw = W.column_bytes(column)
    for lo, hi in W.blocks(len(column), offsets):
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]]


KEYED = ("_k1", "_k2", "doc_id", "text")


def _anchors(window: int):
    """(_k1, _k2, doc_id, text) to (_k1, _k2, doc_id, n, class, local, gram, at): runs of window starts that an earlier
    row of the block (or the row itself) has, and the anchors of all other windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            order_by = batch.column(2).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            for lo, hi, offsets, data in _row_blocks(batch.column(3)):
                a = Anchored(offsets, data, hi - lo, window)
                order = np.lexsort((ids[1][lo:hi], ids[0][lo:hi], order_by[lo:hi]))
                rank = np.empty(hi - lo, np.int64)
                rank[order] = np.arange(hi - lo)
                turn = np.argsort(rank[a.doc[a.windows]], kind="stable")
                hashes = W.windows(a.hash, window)[a.windows][turn]
                first = np.zeros(len(turn), dtype=bool)
                first[turn[np.unique(hashes, return_index=True)[1]]] = True
                again, kept = a.windows[~first], a.anchor[first]
                kept = kept[np.concatenate([[True], kept[1:] != kept[:-1]])] if len(kept) else kept
                again_at, kept_at = np.searchsorted(again, a.begins), np.searchsorted(kept, a.begins)
                local, grams, at, digests = [], [], [], []
                for i in range(hi - lo):
                    dup = a.local(i, again[again_at[i] : again_at[i + 1]])
                    local.append(np.stack(runs(dup), axis=1).ravel() if len(dup) else dup)
                    mine = kept[kept_at[i] : kept_at[i + 1]]
                    grams.append(a.grams[mine].view(np.int64))
                    at.append(a.local(i, mine))
                    own = a.hash[a.begins[i] : a.begins[i + 1]]
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) >= window else None)
                for i, j in zip(order[1:].tolist(), order[:-1].tolist(), strict=True):
                    if ids[0][lo + i] == ids[0][lo + j] and ids[1][lo + i] == ids[1][lo + j]:
                        local[i] = local[j]  # a repeated row
                keys = [batch.column(i).slice(lo, hi - lo) for i in range(3)]
                columns = [*keys, pa.array(a.counts, pa.int64()), pa.array(digests, pa.binary()), _lists(local, pa.int64()), _lists(grams, pa.int64()), _lists(at, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["_k1", "_k2", "doc_id", "n", "class", "local", "gram", "at"])

    return run


def _passages(window: int):
    """(_k1, _k2, doc_id, text, at, hot) to (gram, check, hot, _k1, _k2, doc_id, first, words): for each wanted anchor the
    words of all windows it serves, and for hot anchors each of these windows alone, as a 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, hot = (batch.column(i).to_pylist() for i in (4, 5))
            for lo, hi, offsets, data in _row_blocks(batch.column(3)):
                a = Anchored(offsets, data, hi - lo, window)
                kind = np.zeros(len(a.hash) + 1, dtype=np.int8)
                for i in range(hi - lo):
                    for mark, places in ((1, wanted[lo + i]), (2, hot[lo + i])):
                        places = np.array(places, dtype=np.int64)
                        kind[a.begins[i] + places[places < a.counts[i]]] = mark
                normal, single = kind[a.anchor] == 1, a.windows[kind[a.anchor] == 2]
                begin, anchor = a.windows[normal], a.anchor[normal]
                opens = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(begin) != 1)])) if len(begin) else begin
                closes = np.concatenate([opens[1:], [len(begin)]]) - 1 if len(begin) else begin
                size = begin[closes] - begin[opens] + window if len(begin) else begin
                ends = np.concatenate([[0], np.cumsum(size)])
                flat = np.repeat(begin[opens] - ends[:-1], size) + np.arange(ends[-1]) if len(begin) else begin
                first = np.concatenate([begin[opens], single]) if len(begin) else single
                check = W.windows(a.hash, window, seed=0xA0761D6478BD642F)[single] if len(single) else single.astype(np.uint64)
                gram = np.concatenate([a.grams[anchor[opens]] if len(begin) else check[:0], W.windows(a.hash, window)[single] if len(single) else check])
                rows = a.doc[first]
                ends = np.concatenate([ends, np.full(len(single), ends[-1])]).astype(np.int32)
                columns = [
                    pa.array(gram.view(np.int64)), pa.array(np.concatenate([np.zeros(len(opens), np.int64), check.view(np.int64)])),
                    pa.array(np.arange(len(first)) >= len(opens)), *(batch.column(i).slice(lo, hi - lo).take(pa.array(rows)) for i in range(3)),
                    pa.array(first - a.begins[rows]), pa.ListArray.from_arrays(pa.array(ends), pa.array(a.hash[flat].view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "check", "hot", "_k1", "_k2", "doc_id", "first", "words"])

    return run


def _repeats(window: int):
    """(gram, _k1, _k2, doc_id, first, words), sorted so, to (_k1, _k2, first, last): runs of window starts that match the
    automaton of the anchor's earlier passages. A passage that brings something new then joins the automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, reference, automaton, last = None, None, None, None
        for batch in batches:
            grams, firsts = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            ends, flat = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy()
            keys = [batch.column(k).to_numpy() for k in (1, 2)]
            rows, found = [], []
            for i in range(batch.num_rows):
                words = flat[ends[i] : ends[i + 1]].tolist()
                place = (grams[i], keys[0][i], keys[1][i], firsts[i])
                if place == last:  # of a repeated row
                    continue
                last = place
                if grams[i] != gram:
                    gram, reference, automaton = grams[i], words, None
                    continue
                if automaton is None:
                    if words == reference:
                        rows.append(i)
                        found.append((0, len(words) - window))
                        continue
                    automaton = SuffixAutomaton()
                    automaton.add(reference)
                hits = np.flatnonzero(np.array(automaton.matching(words)) >= window) - (window - 1)
                for s, t in zip(*runs(hits), strict=True):
                    rows.append(i)
                    found.append((int(s), int(t)))
                if len(hits) < len(words) - window + 1:
                    automaton.add(words)
            if rows:
                begin = firsts[rows]
                span = np.array(found)
                yield pa.RecordBatch.from_arrays([*(pa.array(k[rows]) for k in keys), pa.array(begin + span[:, 0]), pa.array(begin + span[:, 1])], names=["_k1", "_k2", "first", "last"])

    return run


def _kept(window: int):
    """(_k1, _k2, doc_id, text, spans, whole) to (doc_id, n_words, n_removed, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, whole = (batch.column(i).to_pylist() for i in (3, 4, 5))
            total, removed, rest = [], [], []
            for text, starts, all_of_it in zip(texts, spans, whole, strict=True):
                words = (text or "").encode().split()
                total.append(len(words))
                if all_of_it:
                    words = []
                elif starts:
                    gone = np.zeros(len(words) + 1, dtype=np.int32)
                    for s, t in zip(starts[::2], starts[1::2], strict=True):
                        gone[s] += 1
                        gone[t + window] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
                removed.append(total[-1] - len(words))
                rest.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(rest, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return run


def remove_repeats(docs: DataFrame, window: int = 20, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    r"""One row for each row of docs: doc_id (as long), n_words, n_removed, text (the kept words joined by one space).

    Words are `[^\x20\x09-\x0D]+`. A word goes if a window of `window` words that covers it also starts earlier: under a
    smaller doc_id, or earlier in the same document. Windows are judged on the input. doc_id is an integer; null ids
    come before all others, rows with the same id and different texts are ordered by a hash, and a repeated row
    (same id and text) is the same document, so both get the same result. Null and empty texts have no words. Extra
    columns aren't read.

    A broadcast of automata of the whole corpus to all documents would grow with its square. So the reference is cut
    down and dealt out first, without losing a match:
    1. Documents with the same word sequence become one class; all but its first are removed whole. Windows that
       a block of about 8 MB has twice are settled there.
    2. Every other window has an anchor (the smallest hash of its 6-word n-grams, about one word in 8). Only anchors that
       occur twice can lie in repeated windows; counting them takes one partial aggregation.
    3. The passages around repeated anchors go to the shard of their anchor, in the order of the corpus. Each anchor's
       passages are streamed through the suffix automaton of those before, whose matching statistics give the windows that
       start earlier; what is new is added to it. Anchors with more than `hot` passages are split by window: a partial
       aggregation of 128-bit window hashes gives the earliest place, and a join compares all others with it.
    """
    with scratch() as keep:
        return _remove_repeats(docs, window, text, doc_id, hot, keep)


def _remove_repeats(docs: DataFrame, window: int, text: str, doc_id: str, hot: int, keep: Callable) -> DataFrame:
    keys = row_keys(column(doc_id), column(text))
    keyed = spread(docs.select(*(v.alias(k) for k, v in keys.items()), column(doc_id).cast("long").alias("doc_id"), column(text).alias("text")))
    schema = "_k1 long, _k2 long, doc_id long, n long, class binary, local array<long>, gram array<long>, at array<long>"
    anchored = cut(keyed.transform(map_batches, _anchors(window), schema), "anchors")
    classes = cut(anchored.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "_k1", "_k2")).alias("head")), "classes")
    heads = classes.select(F.col("head._k1").alias("_k1"), F.col("head._k2").alias("_k2"))

    each = anchored.join(heads, ["_k1", "_k2"], "left_semi").select("_k1", F.explode(F.arrays_zip("gram", "at")).alias("x")).select("_k1", "x.gram", "x.at")
    counted = each.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    chosen = each.join(counted, "gram").groupBy("_k1").agg(F.collect_list(F.when(F.col("m") <= hot, F.col("at"))).alias("at"), F.collect_list(F.when(F.col("m") > hot, F.col("at"))).alias("hot"))
    chosen = cut(chosen.join(heads, "_k1"), "chosen")  # _k1 alone may name two documents: then both get the places of both

    passages = cut(
        keyed.join(chosen, ["_k1", "_k2"]).select(*KEYED, "at", "hot")
        .transform(map_batches, _passages(window), "gram long, check long, hot boolean, _k1 long, _k2 long, doc_id long, first long, words array<long>"),
        "passages",
    )
    order = ["gram", "doc_id", "_k1", "_k2", "first"]
    streamed = (
        passages.where("not hot").select("gram", "_k1", "_k2", "doc_id", "first", "words").repartition("gram").sortWithinPartitions(*order)
        .transform(map_batches, _repeats(window), "_k1 long, _k2 long, first long, last long")
    )
    single = passages.where("hot").select("gram", "check", F.struct("doc_id", "_k1", "_k2", "first").alias("place"))
    earliest = single.groupBy("gram", "check").agg(F.min("place").alias("earliest"), F.count("*").alias("m")).where("m > 1")
    split = single.join(earliest, ["gram", "check"]).where("place <> earliest").select("place._k1", "place._k2", F.col("place.first").alias("first"), F.col("place.first").alias("last"))
    spans = cut(streamed.union(split).groupBy("_k1", "_k2").agg(F.flatten(F.collect_set(F.array("first", "last"))).alias("starts")), "spans")

    fate = keep(cut(
        anchored.select("_k1", "_k2", "doc_id", "class", "local").dropDuplicates(["_k1", "_k2"]).join(classes, "class", "left").join(spans, ["_k1", "_k2"], "left")
        .select("_k1", "_k2", F.concat("local", F.coalesce("starts", F.array().cast("array<long>"))).alias("spans"),
                (F.col("class").isNotNull() & ((F.col("head._k1") != F.col("_k1")) | (F.col("head._k2") != F.col("_k2")))).alias("whole"))
        .where("whole or size(spans) > 0"),
        "fate",
    ))
    told = keyed.join(fate, ["_k1", "_k2"], "left").select(*KEYED, "spans", "whole")
    return told.transform(map_batches, _kept(window), "doc_id long, n_words long, n_removed long, text string")
