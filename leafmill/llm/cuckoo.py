"""Exact dedup through a sharded cuckoo-filter index of live digests."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.tables import column, cut, partitions_for, spread

SLOTS, KICKS = 4, 200


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, two buckets for each digest; `buckets` is a power of two."""

    def __init__(self, buckets: int, table: bytes | None = None):
        self.buckets, self.table = buckets, memoryview(bytearray(table or 2 * SLOTS * buckets)).cast("H")

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") % self.buckets
        return mark, first, self.other(first, mark)

    def other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) % self.buckets

    def _put(self, bucket: int, old: int, new: int) -> bool:
        for i in range(SLOTS * bucket, SLOTS * (bucket + 1)):
            if self.table[i] == old:
                self.table[i] = new
                return True
        return False

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        return mark in self.table[SLOTS * a : SLOTS * (a + 1)].tolist() or mark in self.table[SLOTS * b : SLOTS * (b + 1)].tolist()

    def insert(self, digest: bytes) -> bool:
        """False on overflow: then one fingerprint has lost its place, and the filter must be rebuilt."""
        mark, a, b = self.places(digest)
        if self._put(a, 0, mark) or self._put(b, 0, mark):
            return True
        at = b
        for kick in range(KICKS):
            i = SLOTS * at + (mark + kick) % SLOTS
            mark, self.table[i] = self.table[i], mark
            at = self.other(at, mark)
            if self._put(at, 0, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        return self._put(a, mark, 0) or self._put(b, mark, 0)


class CuckooShard:
    """One shard: the filter, and the live digests in content buckets that verify its hits.

    content[bucket][digest] = [smallest id, live rows]. The filter answers first: a miss is certain, so only hits
    read their content bucket."""

    CONTENT_BUCKETS = 1 << 12

    def __init__(self, expected: int = 0):
        self.content: dict[int, dict[bytes, list]] = {}
        self.live, self.resizes, self.false_hits = 0, 0, 0
        self.filter = CuckooFilter(1 << max(2, (expected // 3).bit_length()))

    @classmethod
    def load(cls, entries: Iterable[tuple], buckets: int, table: bytes) -> CuckooShard:
        shard = cls()
        shard.filter = CuckooFilter(buckets, table)
        for digest, keep, rows in entries:
            shard._bucket(digest)[digest] = [keep, rows]
            shard.live += 1
        return shard

    def _bucket(self, digest: bytes) -> dict[bytes, list]:
        return self.content.setdefault(int.from_bytes(digest[10:12], "little") % self.CONTENT_BUCKETS, {})

    def find(self, digest: bytes) -> list | None:
        if digest not in self.filter:
            return None
        entry = self._bucket(digest).get(digest)
        self.false_hits += entry is None
        return entry

    def add(self, digest: bytes, doc_id: int | None, rows: int = 1) -> list:
        entry = self.find(digest)
        if entry is not None:
            entry[0] = doc_id if entry[0] is None else entry[0] if doc_id is None else min(entry[0], doc_id)
            entry[1] += rows
            return entry
        self._bucket(digest)[digest] = entry = [doc_id, rows]
        self.live += 1
        if not self.filter.insert(digest):
            self.resize()
        return entry

    def remove(self, digest: bytes, rows: int = 1) -> bool:
        """Takes rows off a live digest; the last one takes the digest out of content and filter."""
        entry = self.find(digest)
        if entry is None:
            return False
        entry[1] -= rows
        if entry[1] <= 0:
            del self._bucket(digest)[digest]
            self.filter.delete(digest)
            self.live -= 1
        return True

    def resize(self) -> None:
        """Doubles the filter until all stored keys fit."""
        buckets = self.filter.buckets
        while True:
            buckets *= 2
            self.resizes += 1
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(d) for bucket in self.content.values() for d in bucket):
                return

    def entries(self) -> list[tuple[bytes, int | None, int]]:
        return [(d, *e) for bucket in self.content.values() for d, e in bucket.items()]


INDEX = "shard int, shards int, digest binary, keep_id long, rows long, n_buckets long, filter binary"


def _changed(old: pd.DataFrame, changes: pd.DataFrame, shards: int) -> pd.DataFrame:
    none = lambda x: None if pd.isna(x) else int(x)
    tops, entries = (old[old.digest.isna()], old[old.digest.notna()]) if len(old) else (old, old)
    stored = list(zip(map(bytes, entries.digest), map(none, entries.keep_id), map(int, entries["rows"]), strict=True)) if len(entries) else []
    if len(tops):
        shard = CuckooShard.load(stored, int(tops.iloc[0].n_buckets), bytes(tops.iloc[0]["filter"]))
    else:  # new, or dealt anew
        shard = CuckooShard(len(stored) + len(changes))
        for digest, keep, rows in stored:
            shard.add(digest, keep, rows)
    number = int((changes if len(changes) else old).shard.iloc[0])
    for digest, doc_id, added in zip(map(bytes, changes.digest), map(none, changes.doc_id), changes.added, strict=True):
        if added:
            shard.add(digest, doc_id, int(added))
    for digest, removed in zip(map(bytes, changes.digest), changes.removed, strict=True):
        if removed:
            shard.remove(digest, int(removed))
    rows = [(number, shards, d, keep, n, None, None) for d, keep, n in shard.entries()]
    rows.append((number, shards, None, None, None, shard.filter.buckets, bytes(shard.filter.table)))
    out = pd.DataFrame(rows, columns=["shard", "shards", "digest", "keep_id", "rows", "n_buckets", "filter"])
    return out.astype({"keep_id": "Int64", "rows": "Int64", "n_buckets": "Int64"})


def update_index(changes: DataFrame, index: DataFrame | None = None, shards: int | None = None, salts: int = 16, shard_digests: int = 50_000) -> DataFrame:
    """Applies changes (digest binary, doc_id long, delta +1 or -1) to an index and returns the new one.

    Within a batch insertions come before deletions. The index has a row for each live digest (smallest id ever seen
    while it lived, live rows) and one row for each shard's filter (digest null). Deleting more rows than live ends
    the digest; deleting an unknown digest does nothing. Null digests are ignored.

    Copies are pre-aggregated to `salts` rows for each digest at most before they are dealt to shards by digest, so a
    digest with a third of all rows weighs as much as any other. A shard holds about `shard_digests` digests. Their number
    comes from the size of the first batch, or is given as `shards`. When an index has grown to four times that, its digests are dealt
    to more shards, whose filters are built anew from the stored keys."""
    changes = changes.where(F.col("digest").isNotNull())
    if index is not None:
        known = index.agg(F.max("shards").alias("shards"), F.count("digest").alias("digests")).first()
        shards, wanted = known.shards, partitions_for(known.digests + changes.count(), shard_digests, 64)
        if wanted > 4 * shards:
            shards = wanted
            index = index.where(F.col("digest").isNotNull()).withColumns({"shard": shard_of(F.col("digest"), shards), "shards": F.lit(shards)})
    shards = shards or partitions_for(changes.count(), shard_digests, 64)
    salted = changes.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).agg(
        F.min("doc_id").alias("doc_id"), F.count_if(F.col("delta") > 0).alias("added"), F.count_if(F.col("delta") < 0).alias("removed")
    )
    dealt = salted.select(shard_of(F.col("digest"), shards).alias("shard"), "digest", "doc_id", "added", "removed").groupBy("shard")
    if index is None:
        return dealt.applyInPandas(lambda changes: _changed(pd.DataFrame(), changes, shards), INDEX)
    return index.groupBy("shard").cogroup(dealt).applyInPandas(lambda old, changes: _changed(old, changes, shards), INDEX)


def shard_of(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def squeezed(text: Column) -> Column:
    r"""Each run of `[\x20\x09-\x0D]` as one space. Single spaces, nearly all of the runs, aren't touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their squeezed forms are; a null counts as empty. keep_id is the smallest doc_id of the
    group; null ids count in group_size but stay only where a group has no other id. A repeated row (same id and
    text) gets the same result each time. doc_id is an integer. Extra columns aren't read.

    SHA-256 digests are built in the JVM and written once (about 80 bytes a document); the cuckoo index over them gives
    each live digest its keeper, and one join takes that back to the rows. Hot digests split at run time there."""
    rows = cut(spread(docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))).select("doc_id", F.sha2(squeezed(F.col("text")), 256).alias("text_sha256")), "digests")
    changes = rows.select(F.unhex("text_sha256").alias("digest"), "doc_id", F.lit(1).alias("delta"))
    index = update_index(changes).where(F.col("digest").isNotNull())
    live = index.select(F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", F.col("rows").alias("group_size"))
    return rows.join(live.hint("merge"), "text_sha256").select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")
