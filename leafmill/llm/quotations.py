"""Chat formatting: quoted passages are linked to the messages they come from, and conversations are built in reply order
without them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from leafmill.llm.tables import column, cut, map_batches, row_keys, scratch, spread

QUOTED = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)(.*)", re.S)
ATTRIBUTION = re.compile(r"(?:On|Am|Le|El)\b.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\b.{0,80}:\s*")
#: Turns to a bucket, and so the most messages in one row of the result.
BUCKET = 4096

PARSED = "own string, units array<binary>, passages array<struct<level:int,lines:array<string>,hash:binary,line_hashes:array<binary>>>"


def normal(text: str) -> str:
    """White space as single spaces, A-Z lower-cased."""
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", text)).translate({c: c + 32 for c in range(65, 91)})


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, content) of each line; an attribution above a quote has level -1."""
    out = []
    for line in text.split("\n"):
        m = QUOTED.fullmatch(line)
        out.append((m[1].count(">"), m[2]) if m else (0, line))
    for i, (level, line) in enumerate(out):
        if level == 0 and ATTRIBUTION.fullmatch(line.strip()):
            after = next((x for x in out[i + 1 :] if x[0] or x[1].strip()), (0, ""))
            if after[0] > 0:
                out[i] = (-1, line)
    return out


def parse(text: str) -> tuple[str, list[str], list[tuple[int, list[str]]]]:
    """(own text, its normalised units, quoted passages as (level, lines)). Units are the whole, its paragraphs and
    its lines. A passage is a run of lines of one level; a text without quotes is its own text unchanged."""
    lines, passages = levels(text), []
    before = 0
    for level, line in lines:
        if level > 0:
            if level != before:
                passages.append((level, []))
            passages[-1][1].append(line)
        before = level
    own = text if not passages else "\n".join(x for level, x in lines if level == 0).strip("\n")
    units = {normal(x) for x in [own, *re.split(r"\n[ \t]*\n", own), *own.split("\n")]}
    return own, sorted(units - {""}), passages


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    passage = pa.struct([("level", pa.int32()), ("lines", pa.list_(pa.string())), ("hash", pa.binary()), ("line_hashes", pa.list_(pa.binary()))])
    for batch in batches:
        own, units, found = [], [], []
        for text in batch.column(4).to_pylist():
            a, b, c = parse(text or "")
            own.append(a)
            units.append([digest(x) for x in b])
            rows = []
            for level, lines in c:
                if whole := normal("\n".join(lines)):
                    rows.append({"level": level, "lines": lines, "hash": digest(whole), "line_hashes": [digest(x) for x in map(normal, lines) if x]})
            found.append(rows)
        columns = [pa.array(own, pa.string()), pa.array(units, pa.list_(pa.binary())), pa.array(found, pa.list_(passage))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns, *batch.columns[5:]], names=["conv", "turn", "role", "row", "own", "units", "passages"])


def latest(rows: DataFrame, keys: list[str], counts: Column, into: str, inclusive: bool = False) -> DataFrame:
    """(keys, turn, into) for each turn of rows with the same keys: the largest turn below it (or up to it) of a row for which `counts`
    holds. Rows with null keys or turns are left out.

    Turns are made distinct first, so many rows of one turn are one; windows go over buckets of BUCKET turns, and
    a second one over buckets. So no group is larger than that, but for the buckets of one key."""
    turns = rows.where(" and ".join(f"{k} is not null" for k in [*keys, "turn"])).groupBy(*keys, "turn").agg(F.max(F.when(counts, F.col("turn"))).alias("counted"))
    turns = turns.withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    near = Win.partitionBy(*keys, "bucket").orderBy("turn").rowsBetween(Win.unboundedPreceding, Win.currentRow if inclusive else -1)
    far = Win.partitionBy(*keys).orderBy("bucket").rowsBetween(Win.unboundedPreceding, -1)
    tops = turns.groupBy(*keys, "bucket").agg(F.max("counted").alias("top"))
    tops = tops.withColumn("before", F.max("top").over(far)).where("before is not null").drop("top")
    found = turns.withColumn("near", F.max("counted").over(near)).join(tops, [*keys, "bucket"], "left")
    return found.select(*keys, "turn", F.coalesce("near", "before").alias(into))


def links(parsed: DataFrame) -> DataFrame:
    """(conv, turn, row, passage, level, source_conv, source_turn) of each quoted passage; the last two are null where
    no message has it.

    A passage asks with the hash of the whole (weight: its lines + 1) and of each line (weight 1) for the latest earlier
    message of its conversation with such a unit; the message with the largest weight, and of these the latest, is
    the source. What finds none there asks the corpus for the first message of another conversation with the whole passage."""
    each = parsed.select("conv", "turn", "row", F.posexplode("passages").alias("passage", "p"))
    asks = F.concat(
        F.array(F.struct(F.col("p.hash").alias("hash"), (F.size("p.line_hashes") + 1).alias("weight"))),
        F.transform("p.line_hashes", lambda h: F.struct(h.alias("hash"), F.lit(1).alias("weight"))),
    )
    probes = cut(each.select("conv", "turn", "row", "passage", F.col("p.level").alias("level"), F.col("p.hash").alias("whole"), F.explode(asks).alias("a")).select("*", "a.hash", "a.weight").drop("a"), "probes")
    units = parsed.where("conv is not null and turn is not null").select("conv", "turn", F.explode("units").alias("hash"))
    units = cut(units.join(probes.select("hash").distinct(), "hash", "left_semi"), "units")
    both = probes.withColumn("unit", F.lit(False)).unionByName(units.withColumn("unit", F.lit(True)), allowMissingColumns=True)
    within = probes.join(latest(both, ["conv", "hash"], F.col("unit"), "source").where("source is not null"), ["conv", "hash", "turn"])
    ranked = within.groupBy("conv", "turn", "row", "passage", "source").agg(F.sum("weight").alias("weight"))
    best = ranked.groupBy("conv", "turn", "row", "passage").agg(F.max(F.struct("weight", "source")).alias("best"))
    first = units.groupBy("hash").agg(F.min(F.struct("conv", "turn")).alias("first"))
    second = units.join(first, "hash").where("conv <> first.conv").groupBy("hash").agg(F.min(F.struct("conv", "turn")).alias("second"))
    passages = probes.select("conv", "turn", "row", "passage", "level", F.col("whole").alias("hash")).distinct()
    found = passages.join(best, ["conv", "turn", "row", "passage"], "left").join(first, "hash", "left").join(second, "hash", "left")
    inside = F.col("best").isNotNull()
    elsewhere = F.when(F.col("first.conv") != F.col("conv"), F.col("first")).when(F.col("first.conv") == F.col("conv"), F.col("second"))
    return found.select(
        "conv", "turn", "row", "passage", "level",
        F.when(inside, F.col("conv")).otherwise(elsewhere.conv).alias("source_conv"), F.when(inside, F.col("best.source")).otherwise(elsewhere.turn).alias("source_turn"),
    )


def branch_ranks(jumps: DataFrame) -> DataFrame:
    """(conv, head, rank) from jumps (conv, head, from_turn, parent): a branch begins at the message `head`, answers the
    message `from_turn`, and hangs on the branch `parent` (null: the first). Ranks count the branches of a conversation from 1 in
    reply order: whatever hangs on a branch comes behind it, later answered messages first.

    A tour goes down into each branch and up out of it. Each of the two places knows the place before it on the tour; places
    then skip along these, twice as far in each round, and add up the ways down. So a row has a fixed size, and rounds
    grow with the logarithm of a conversation's branches, whatever their depth."""
    order = Win.partitionBy("conv", "parent").orderBy(F.desc("from_turn"), "head")
    last = jumps.where("parent is not null").groupBy("conv", F.col("parent").alias("head")).agg(F.max_by("head", F.struct(-F.col("from_turn"), "head")).alias("last"))
    both = jumps.select("conv", "head", "parent", F.lag("head").over(order).alias("sibling")).join(last, ["conv", "head"], "left")
    down = both.select("conv", "head", F.lit(False).alias("up"), F.coalesce("sibling", "parent").alias("before"), F.col("sibling").isNotNull().alias("before_up"), F.lit(1).cast("long").alias("rank"))
    up = both.select("conv", "head", F.lit(True).alias("up"), F.coalesce("last", "head").alias("before"), F.col("last").isNotNull().alias("before_up"), F.lit(0).cast("long").alias("rank"))
    places = cut(down.union(up), "places")
    while not places.where("before is not null").isEmpty():
        skipped = places.select("conv", F.col("head").alias("before"), F.col("up").alias("before_up"), F.col("before").alias("further"), F.col("before_up").alias("further_up"), F.col("rank").alias("more"))
        joined = places.join(skipped, ["conv", "before", "before_up"], "left")
        places = cut(joined.select("conv", "head", "up", F.col("further").alias("before"), F.col("further_up").alias("before_up"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank")), "places")
    return places.where("not up").select("conv", "head", "rank")


def reply_ordered(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations without quotes: conv_id, branch, branch_rank, part, slice, n_quotes, n_linked, messages (turn, role,
    reply_to, text, sources), a row for each branch and 4,096 turns of it. Where one turn has more messages than that
    they are dealt to slices, else slice is 0.

    A message answers the source of its least nested quote that was found in its conversation (of several the
    latest), else the message before it. It opens a branch if it answers another than the one before; other messages
    go on with their branch. Branches in order of branch_rank (the first has 0), parts, and messages in order of turn are the
    conversation in reply order (depth first). Quote marks are `>` behind at most three blanks; quoted lines and
    attributions above them leave the text.

    conv is of any type, turn is an integer. Repeated rows count once; messages of one turn stand in the order of
    role and text and answer alike. Messages with a null conversation or turn stand alone, in a row each, without links. A
    null text is empty. Extra columns aren't read. A conversation or a passage with very many messages is dealt in buckets
    of turns, never gathered whole."""
    with scratch() as keep:
        return keep(_reply_ordered(messages, conv, turn, role, text))


def _reply_ordered(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    given = messages.select(column(conv).alias("conv"), column(turn).cast("long").alias("turn"), column(role).alias("role"), column(text).alias("text"))
    rows = spread(given).withColumns(row_keys(F.col("conv"), F.col("turn"), F.col("role"), F.col("text")))
    conv_type = rows.schema["conv"].dataType.simpleString()
    given = rows.select("conv", "turn", "role", F.concat_ws(":", "_k1", "_k2").alias("row"), "text")
    schema = f"conv {conv_type}, turn long, role string, row string, {PARSED}"
    parsed = cut(given.withColumn("role", F.col("role").cast("string")).transform(map_batches, _parse, schema), "parsed")
    linked = cut(links(parsed.select("conv", "turn", "row", "units", "passages")), "links")

    inside = linked.where("source_conv = conv").groupBy("conv", "turn").agg(F.max(F.struct(-F.col("level"), F.col("source_turn").alias("answers"))).answers.alias("answers"))
    turns = parsed.where("conv is not null and turn is not null").select("conv", "turn").distinct()
    turns = cut(latest(turns, ["conv"], F.lit(True), "before").join(inside, ["conv", "turn"], "left").withColumn("jump", F.coalesce(F.col("answers") != F.col("before"), F.lit(False))), "turns")
    turns = cut(turns.join(latest(turns, ["conv"], F.col("jump"), "head", inclusive=True), ["conv", "turn"]), "heads")
    jumps = turns.where("jump").select("conv", F.col("turn").alias("head"), F.col("answers").alias("from_turn"))
    heads = turns.select("conv", F.col("turn").alias("from_turn"), F.col("head").alias("parent"))
    ranks = branch_ranks(jumps.join(heads, ["conv", "from_turn"]))

    quotes = linked.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("passage", "level", F.col("source_conv").alias("conv"), F.col("source_turn").alias("turn")))).alias("sources"))
    placed = parsed.select("conv", "turn", "role", "row", "own").distinct().join(turns.select("conv", "turn", "head", F.coalesce("answers", "before").alias("reply_to")), ["conv", "turn"], "left")
    placed = placed.join(quotes, "row", "left").withColumn("sources", F.coalesce("sources", F.array().cast(quotes.schema["sources"].dataType)))
    crowded = placed.where("conv is not null and turn is not null").groupBy("conv", "turn").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("slices"))
    crowded = cut(crowded.where("slices > 1"), "crowded")
    slices = F.lit(0) if crowded.isEmpty() else F.coalesce(F.pmod(F.xxhash64("row"), F.col("slices")).cast("int"), F.lit(0))
    if not crowded.isEmpty():
        placed = placed.join(crowded, ["conv", "turn"], "left")
    alone = F.when(F.col("conv").isNull() | F.col("turn").isNull(), F.col("row"))
    message = F.struct("turn", "role", F.col("own").alias("text"), "reply_to", "sources")
    grouped = placed.groupBy("conv", "head", F.floor(F.col("turn") / BUCKET).alias("part"), slices.alias("slice"), alone.alias("_alone")).agg(F.array_sort(F.collect_list(message)).alias("messages"))
    found = grouped.join(ranks, ["conv", "head"], "left")
    quoted = F.flatten(F.transform("messages", lambda m: m.sources))
    return cut(found.select(
        F.col("conv").alias("conv_id"), F.col("head").alias("branch"), F.coalesce("rank", F.lit(0)).alias("branch_rank"), "part", "slice",
        F.size(quoted).cast("long").alias("n_quotes"), F.size(F.filter(quoted, lambda q: q.turn.isNotNull())).cast("long").alias("n_linked"), "messages",
    ), "conversations")
