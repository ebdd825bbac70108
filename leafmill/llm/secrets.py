"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.tables import column, cut, map_batches, row_keys, scratch, spread

#: Base kinds in their fixed order; (pattern, group that holds the value, least length of it).
BASE = {
    "assign": (re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
ORDER = [*BASE, "owned"]
#: Candidates of the method: strings that look random, outside the base spans; of any length, dotted ones whole, without
#: full stops at their ends.
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{18,}[A-Za-z0-9+/_=-]")
PART = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

SCANNED = "spans array<struct<kind:string,start:long,end:long,value:string,random:boolean>>"


def entropy(value: str) -> float:
    """Shannon's, bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def looks_random(value: str, least: float = 3.0) -> bool:
    return len(value) >= 12 and any(c.isdigit() for c in value) and entropy(value) >= least


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value): leftmost non-overlapping matches of each kind whose value is long enough."""
    found = []
    for kind, (pattern, group, least) in BASE.items():
        found += [(kind, *m.span(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    return found


def candidates(text: str, taken: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Strings with digits and letters of both cases and of high entropy that touch no base span. Of a dotted string that
    isn't one the parts of 20 characters or more are tried."""
    starts, ends = sorted(s for _, s, _, _ in taken), sorted(e for _, _, e, _ in taken)

    def fits(m: re.Match) -> bool:
        x = m[0]
        untouched = bisect_left(starts, m.end()) == bisect_right(ends, m.start())  # all that begin before its end also end before its start
        return untouched and any(c.isdigit() for c in x) and any(c.islower() for c in x) and any(c.isupper() for c in x) and looks_random(x, 3.5)

    found = []
    for m in RANDOM.finditer(text):
        own = [m] if fits(m) else [x for x in PART.finditer(text, *m.span()) if fits(x)] if "." in m[0] else []
        found += [("owned", *x.span(), x[0]) for x in own]
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("random", pa.bool_())]))
    for batch in batches:
        rows = []
        for text in batch.column(3):
            base = base_spans(x := text.as_py() or "")
            rows.append([{"kind": k, "start": s, "end": e, "value": hashlib.sha256(v.encode()).hexdigest(), "random": looks_random(v)} for k, s, e, v in base + candidates(x, base)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, type=kind), *batch.columns[4:]], names=["_k1", "_k2", "doc_id", "spans", "repository", "owner"])


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", repository: str = "doc_id", owner: str = "source", example_owners: int = 3, example_repositories: int = 10) -> DataFrame:
    """One row for each row of docs: doc_id, spans (kind, start, end in code points, value hash, owners, repositories,
    verdict), in the order of start and kind.

    Spans are the three base kinds, always kept, and `owned`: random-looking strings outside them, kept only if their
    verdict is live. The verdict of a value comes from the whole corpus: `example` if its hash occurs under
    `example_owners` distinct owners or more, or under several owners in `example_repositories` distinct repositories or
    more, else `live` if it looks random, else `weak`. What one owner has stays that owner's, however many copies there
    are. Null owners and repositories count as none. A null text is empty; a repeated row gets the same spans each time and its
    repository counts once. Extra columns aren't read; values leave only as hashes.

    Texts are read once; what is found (few rows) is written, counted by value with partial aggregation over distinct
    (value, owner, repository), and joined back by value, where hot examples split at run time."""
    key = row_keys(column(doc_id), column(text))
    columns = [column(doc_id).alias("doc_id"), column(text).alias("text"), column(repository).cast("string").alias("repository"), column(owner).cast("string").alias("owner")]
    scanned = spread(docs.select(*dict.fromkeys((doc_id, text, repository, owner)))).select(*(v.alias(k) for k, v in key.items()), *columns)
    id_type = scanned.schema["doc_id"].dataType.simpleString()
    scanned = cut(scanned.transform(map_batches, _scan, f"_k1 long, _k2 long, doc_id {id_type}, {SCANNED}, repository string, owner string"), "secrets")
    each = scanned.select("_k1", "_k2", "repository", "owner", F.explode("spans").alias("s"))
    counted = each.groupBy(F.col("s.value").alias("value")).agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))
    verdict = (
        F.when((F.col("owners") >= example_owners) | ((F.col("owners") > 1) & (F.col("repositories") >= example_repositories)), "example").when(F.col("s.random"), "live").otherwise("weak")
    )
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("s.kind"))
    judged = (
        each.select("_k1", "_k2", "s", F.col("s.value").alias("value")).join(counted.hint("merge"), "value")
        .select("_k1", "_k2", F.struct(F.col("s.start").alias("start"), rank.alias("rank"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), "value", "owners", "repositories", verdict.alias("verdict")).alias("span"))
        .where((F.col("span.kind") != "owned") | (F.col("span.verdict") == "live"))
        .groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    )
    rows = scanned.select("_k1", "_k2", "doc_id").join(judged, ["_k1", "_k2"], "left")
    return rows.select("doc_id", F.coalesce("spans", F.array().cast(judged.schema["spans"].dataType)).alias("spans"))
