"""MinHash near-dedup as an inverted join over signature coordinates, with links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import wordhash as W
from leafmill.llm.components import components
from leafmill.llm.tables import column, cut, map_batches, row_keys, scratch, spread, unused

SHINGLE, COORDINATES, MATCHES = 5, 64, 30
#: Documents, and shingles, that one task compares with as many others; larger groups are compared in blocks.
BLOCK_DOCS, BLOCK_SHINGLES, BLOCK_POSTINGS = 500, 2_000_000, 1000
_MULTIPLIERS = W.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, rows: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row of fewer words has its whole sequence as one."""
    words = W.words(offsets, data, W.NON_SPACE)
    counts = W.row_counts(words.doc, rows)
    begins = np.concatenate([[0], np.cumsum(counts)])
    hashes = W.windows(words.hash, SHINGLE)
    out = []
    for i in range(rows):
        b, n = int(begins[i]), int(counts[i])
        out.append(np.unique(hashes[b : b + n - SHINGLE + 1]) if n >= SHINGLE else W.mix(W.windows(words.hash[b : b + n], n) + np.uint64(n)) if n else hashes[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest 32-bit values under COORDINATES multiplicative hashes; sets aren't empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k, a in enumerate(_MULTIPLIERS):
        out[:, k] = np.minimum.reduceat((flat * a) >> np.uint64(32), starts)
    return out


def _each_block(column: pa.Array) -> Iterator[list[np.ndarray]]:
    offsets, raw = W.column_bytes(column, lower=True)
    for lo, hi in W.blocks(len(column), offsets, 2 * W.MB):
        yield shingle_sets(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]], hi - lo)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_k1, _k2, doc_id, text) to (_k1, _k2, doc_id, n, class, signature)."""
    for batch in batches:
        at = 0
        for sets in _each_block(batch.column(3)):
            full = [s for s in sets if len(s)]
            values = signatures(full).view(np.int32) if full else np.zeros((0, COORDINATES), np.int32)
            ends = np.concatenate([[0], np.cumsum([COORDINATES * bool(len(s)) for s in sets])]).astype(np.int32)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))
            keys = [batch.column(i).slice(at, len(sets)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists], names=["_k1", "_k2", "doc_id", "n", "class", "signature"])
            at += len(sets)


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, cells, text) to (class, cells, shingles)."""
    for batch in batches:
        at = 0
        for sets in _each_block(batch.column(2)):
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), batch.column(1).slice(at, len(sets)), lists], names=["class", "cells", "shingles"])
            at += len(sets)


def _grouped(link: Callable, value: str) -> Callable:
    """A function for map_batches over rows (g, class, value) that are sorted by g: link() gets each group once."""

    def edges(classes: list[bytes], lists: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        return [(classes[x], classes[root]) for x, root in link(lists)] if len(classes) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, classes, lists = None, [], []
        for batch in batches:
            found, g = [], batch.column(0).to_pylist()
            names, column = batch.column(1).to_pylist(), batch.column(2)
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i in range(batch.num_rows):
                if g[i] != group:
                    found += edges(classes, lists)
                    group, classes, lists = g[i], [], []
                classes.append(names[i])
                lists.append(flat[ends[i] : ends[i + 1]].copy())
            if found:
                yield _edges(found)
        if found := edges(classes, lists):
            yield _edges(found)

    return run


def match_links(lists: list[np.ndarray]) -> list[tuple[int, int]]:
    """(member, root) for the components of members whose signatures agree in MATCHES coordinates or more. A member
    that has been reached is skipped in all further counts."""
    signs = np.stack(lists)
    rest, found = np.arange(len(signs)), []
    while len(rest):
        root, rest, frontier = rest[0], rest[1:], [rest[0]]
        while frontier and len(rest):
            near = (signs[rest] == signs[frontier.pop()]).sum(axis=1) >= MATCHES
            frontier += rest[near].tolist()
            found += [(x, root) for x in rest[near].tolist()]
            rest = rest[~near]
    return found


def set_links(lists: list[np.ndarray], percent: int = 75) -> list[tuple[int, int]]:
    """(member, root) for the components of sets with 100 * intersection >= percent * union, by exact counts."""
    order = np.argsort([len(x) for x in lists], kind="stable")
    sets = [lists[i] for i in order]
    sizes = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    marked = np.zeros(int(flat.max()) + 1, dtype=np.int32)
    rest, starts, found = np.arange(len(sets)), np.concatenate([[0], np.cumsum(sizes)]), []
    alive = np.ones(len(sets), dtype=bool)
    for root in range(len(sets)):
        if not alive[root]:
            continue
        alive[root], frontier = False, [root]
        while frontier:
            x = frontier.pop()
            if alive[rest].sum() < 0.7 * len(rest):
                rest = rest[alive[rest]]
                flat = np.concatenate([own[i] for i in rest]) if len(rest) else flat[:0]
                starts = np.concatenate([[0], np.cumsum(sizes[rest])])
            here = sizes[rest]
            lo, hi = np.searchsorted(here, percent * sizes[x] / 100, "left"), np.searchsorted(here, sizes[x] * 100 / percent, "right")
            if lo >= hi:
                continue
            marked[own[x]] = 1
            common = np.add.reduceat(marked[flat[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo])
            marked[own[x]] = 0
            near = alive[rest[lo:hi]] & (100 * common >= percent * (here[lo:hi] + sizes[x] - common))
            reached = rest[lo:hi][near]
            alive[reached] = False
            frontier += reached.tolist()
            found += [(int(order[i]), int(order[root])) for i in reached]
    return found


def _cross(near: Callable) -> Callable:
    """A function for map_batches over rows (g, asks, class, root, value), sorted by g: near() gets the values that ask and
    those that don't, and gives for each of the first the positions of the second that it is linked with."""

    def edges(asking: list, others: list) -> set[tuple[bytes, bytes]]:
        if not asking or not others:
            return set()
        roots = [root for _, root, _ in others]
        found = near([x for _, _, x in asking], [x for _, _, x in others])
        return {(name, roots[i]) for (name, _, _), at in zip(asking, found, strict=True) for i in at}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asking, others = None, [], []
        for batch in batches:
            found: set = set()
            g, asks, names, roots = (batch.column(i).to_pylist() for i in range(4))
            flat, ends = batch.column(4).values.to_numpy(zero_copy_only=False), batch.column(4).offsets.to_numpy()
            for i in range(batch.num_rows):
                if g[i] != group:
                    found |= edges(asking, others)
                    group, asking, others = g[i], [], []
                (asking if asks[i] else others).append((names[i], roots[i], flat[ends[i] : ends[i + 1]].copy()))
            if found:
                yield _edges(sorted(found))
        if found := edges(asking, others):
            yield _edges(sorted(found))

    return run


def _edges(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])


def near_signatures(asking: list[np.ndarray], others: list[np.ndarray]) -> Iterator[np.ndarray]:
    signs = np.stack(others)
    for x in asking:
        yield np.flatnonzero((signs == x).sum(axis=1) >= MATCHES)


def near_sets(asking: list[np.ndarray], others: list[np.ndarray], percent: int = 75) -> Iterator[np.ndarray]:
    sizes = np.array([len(x) for x in others])
    starts = np.cumsum(sizes) - sizes
    shingles, flat = np.unique(np.concatenate(others), return_inverse=True)
    marked = np.zeros(len(shingles), dtype=np.int32)
    for x in asking:
        at = np.searchsorted(shingles, x)
        at = at[at < len(shingles)]
        own = at[np.isin(shingles[at], x)]
        marked[own] = 1
        common = np.add.reduceat(marked[flat], starts)
        marked[own] = 0
        yield np.flatnonzero(100 * common >= percent * (sizes + len(x) - common))


def small_side(df: DataFrame, most: int) -> DataFrame:
    """One side of a join: broadcast if it has at most so many rows, else for a sort-merge join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def _link_groups(rows: DataFrame, group: str, value: str, link: Callable, near: Callable, broadcast_rows: int) -> DataFrame:
    """Components (node, root) of the links within each group of rows (group, blocks, class, value).

    Groups of one block are compared whole. Of larger ones the rows of the first block meet those of each other block, which
    joins most of a group that belongs together. Only rows outside the group's largest component so far then ask
    all blocks: pairs within one component need no comparison. Each row goes to few tasks unless a group is
    large and hardly linked; then its blocks meet pair by pair."""
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    dealt = rows.select(F.col(group).alias("group"), "blocks", "class", value, own.alias("block"))
    with_first = F.when(F.col("block") > 0, F.array("block")).when(F.col("blocks") > 1, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    first = dealt.withColumn("g", F.explode(F.transform(with_first, lambda i: F.xxhash64("group", i))))
    edges = _sorted_by_group(first.select("g", "class", value)).transform(map_batches, _grouped(link, value), "a binary, b binary").distinct()
    edges = cut(edges, "links")
    large = dealt.where("blocks > 1")
    if large.isEmpty():
        return components(edges)
    roots = components(edges)
    known = large.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    known = cut(known, "known")
    sizes = known.groupBy("group", "root").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("group").agg(F.max_by("root", F.struct("n", "root")).alias("top"), (F.sum("n") - F.max("n")).alias("left"), F.sum("n").alias("all"))
    tops = cut(tops.where("left > 0"), "tops")  # a row for each group of several blocks
    asked = known.join(small_side(tops, broadcast_rows), "group").withColumn("turns", F.ceil(F.col("left") * F.col("blocks") / F.col("all")).cast("int"))
    turn = F.pmod(F.xxhash64("class", F.lit(7)), F.col("turns")).cast("int")
    pair = lambda t, b: F.xxhash64("group", t, b)
    there = asked.withColumn("g", F.explode(F.transform(F.sequence(F.lit(0), F.col("turns") - 1), lambda t: pair(t, F.col("block"))))).withColumn("asks", F.lit(False))
    asking = asked.where("root <> top").withColumn("g", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: pair(turn, b)))).withColumn("asks", F.lit(True))
    both = there.unionByName(asking).select("g", "asks", "class", "root", value)
    more = _sorted_by_group(both).transform(map_batches, _cross(near), "a binary, b binary").distinct()
    return components(cut(edges.union(more), "links"))


def _sorted_by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions("g")


def _cells(grouped: DataFrame, percent: int, broadcast_rows: int) -> DataFrame:
    """Adds to (class, group, n) the array `cells`, (group, blocks), in which a class is compared.

    Linked sets differ in size by 100 / percent at most. So sizes are put into classes of that ratio and a bit, and a cell has
    the sets of a group that lie in one class of sizes or in the next: every link lies in a cell, and a group whose texts
    have other lengths is never compared as a whole."""
    ratio = math.log(100 / percent * 1.001)
    sized = grouped.withColumn("size", F.floor(F.log(F.col("n")) / ratio).cast("int"))
    counts = sized.groupBy("group", "size").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    above = counts.select("group", (F.col("size") - 1).alias("size"), F.col("docs").alias("more_docs"), F.col("shingles").alias("more"))
    both = counts.join(above, ["group", "size"], "left").na.fill(0, ["more_docs", "more"])
    blocks = F.greatest(F.ceil((F.col("docs") + F.col("more_docs")) / BLOCK_DOCS), F.ceil((F.col("shingles") + F.col("more")) / BLOCK_SHINGLES)).cast("int")
    cell = F.struct(F.xxhash64("group", "size").alias("group"), blocks.alias("blocks"))
    own = cut(both.select("group", "size", cell.alias("own")), "cells")
    under = own.select("group", (F.col("size") + 1).alias("size"), F.col("own").alias("under"))
    found = sized.join(small_side(own, broadcast_rows), ["group", "size"]).join(small_side(under, broadcast_rows), ["group", "size"], "left")
    return found.withColumn("cells", F.array_compact(F.array("own", "under"))).drop("own", "under", "size")


def drop_near_duplicates(docs: DataFrame, percent: int = 75, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = 100_000) -> DataFrame:
    """docs without the rows that near_duplicates() doesn't keep; all columns, of any name, pass through."""
    with scratch() as keep:
        found = near_duplicates(docs, percent, text, doc_id, broadcast_rows, keys=True)
        gone = keep(cut(found.where("not kept").select("_k1", "_k2").distinct(), "gone"))
    mine = row_keys(column(doc_id), column(text), names=tuple(unused(docs.columns, "k1", "k2")))
    theirs = unused([*docs.columns, *mine], "gone1", "gone2")
    gone = small_side(gone.toDF(*theirs), broadcast_rows)
    same = [F.col(name) == F.col(other) for name, other in zip(mine, theirs, strict=True)]
    return docs.withColumns(mine).join(gone, same[0] & same[1], "left_anti").drop(*mine)


def near_duplicates(docs: DataFrame, percent: int = 75, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = 100_000, keys: bool = False) -> DataFrame:
    r"""One row for each row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id), and with `keys` the
    row's key.

    Words are `[^\x20\x09-\x0D]+` after A-Z is lower-cased; a document's set has its distinct 5-word shingles (64-bit
    hashes), or the whole sequence if it has fewer words. Documents are linked if 100 * intersection >= percent *
    union of the full sets; component_id is the smallest doc_id that links reach. Null and empty texts and texts of
    white space have empty sets and stay alone, with their own id. Null ids count as larger than all others. Repeated
    rows are one class. Extra columns aren't read.

    1. Equal sets become one class (partial aggregation, so thousands of copies cost nothing further).
    2. Classes are posted under each (coordinate, value) of 64 MinHash coordinates. A pair with similarity 0.75 agrees in
       48 coordinates on average; pairs that agree in MATCHES (30) or more are retained, which misses a pair at 0.75
       with a probability of about 4e-7. Values that one class has alone can't match; a class with fewer than 30 shared
       values has no partner. Of the others' values, in order of growing frequency, all but the last 29 form
       the prefix: two classes that agree in 30 must share one of those, so frequent values are seldom posted.
    3. Within a posting list collisions are counted over whole signatures; members already reached are skipped, and
       each list gives at most one edge a member. Lists of over 1,000 go in blocks: the first meets each other, then
       only members that this leaves apart meet all.
    4. Each group that these edges connect is compared on full sets, in cells of similar set sizes (_cells()), again with
       skipping and in blocks (500 documents, 2 million shingles), which gives the links that count; their components are the
       result.
    """
    with scratch() as keep:
        return _near_duplicates(docs, percent, text, doc_id, broadcast_rows, keys, keep)


def _near_duplicates(docs: DataFrame, percent: int, text: str, doc_id: str, broadcast_rows: int, keys: bool, keep: Callable) -> DataFrame:
    docs = spread(docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")))
    keyed = docs.select(*(v.alias(k) for k, v in row_keys(F.col("doc_id"), F.col("text")).items()), "doc_id", "text")
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    signed = keep(cut(keyed.transform(map_batches, _signed, f"_k1 long, _k2 long, doc_id {id_type}, n long, class binary, signature array<int>"), "signed"))
    classes = cut(
        signed.where("class is not null").groupBy("class")
        .agg(F.min("doc_id").alias("rep"), F.min(F.struct("_k1", "_k2")).alias("row"), F.first("n").alias("n"), F.first("signature").alias("signature")),
        "classes",
    )

    posted = classes.select("class", F.posexplode("signature").alias("at", "value")).select(
        "class", (F.col("at").cast("long") * F.lit(1 << 32) + F.col("value").cast("long")).alias("token")
    )
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = posted.join(shared, "token").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    prefix = ranked.where(F.size("tokens") >= MATCHES).select("class", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - (MATCHES - 1))).alias("t"))
    prefix = cut(prefix.select("class", F.col("t.token").alias("token")), "prefix")
    lists = prefix.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token", F.ceil(F.col("m") / BLOCK_POSTINGS).cast("int").alias("blocks"))
    members = prefix.join(lists, "token").join(classes.select("class", "signature"), "class")
    with scratch() as keep_links:
        loose = keep_links(cut(_link_groups(members, "token", "signature", match_links, near_signatures, broadcast_rows), "loose"))

    grouped = cut(loose.select(F.col("node").alias("class"), F.col("root").alias("group")).join(classes.select("class", "n", "row", "rep"), "class"), "grouped")
    wanted = cut(_cells(grouped, percent, broadcast_rows).select("class", "cells", F.col("row._k1").alias("_k1"), F.col("row._k2").alias("_k2")), "wanted")
    texts = keyed.select("_k1", "_k2", "text").join(small_side(wanted, broadcast_rows), ["_k1", "_k2"]).select("class", "cells", "text")
    sets = cut(texts.transform(map_batches, _with_sets, "class binary, cells array<struct<group:long,blocks:int>>, shingles array<long>"), "sets")
    dealt = sets.select("class", "shingles", F.explode("cells").alias("cell")).select("class", "shingles", "cell.*")
    with scratch() as keep_links:
        linked = _link_groups(dealt, "group", "shingles", lambda x: set_links(x, percent), lambda x, y: near_sets(x, y, percent), broadcast_rows)
        ends = keep_links(cut(linked, "components")).select(F.col("node").alias("class"), "root")
    smallest = ends.join(classes.select("class", "rep"), "class").groupBy("root").agg(F.min("rep").alias("component"))
    named = classes.select("class", "rep").join(ends.join(smallest, "root").select("class", "component"), "class", "left")
    named = keep(cut(named.select("class", F.coalesce("component", "rep").alias("component")), "named"))  # then a hot class can be split
    found = signed.select("_k1", "_k2", "doc_id", F.col("n").alias("n_shingles"), "class").join(named, "class", "left")
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return found.select(*(["_k1", "_k2"] if keys else []), "doc_id", "n_shingles", own.alias("component_id"), F.expr("doc_id <=> if(class is null, doc_id, component)").alias("kept"))
