"""Context limits of models, from a catalogue and a table of known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
CEILING, UNKNOWN_LIMIT = 1_048_576, 128_000
FIELDS = ("context_window", "max_context_tokens", "max_input_tokens", "context_length", "max_tokens", "max_sequence_length")
KNOWN = {
    "MiniMax-M3": 524_288,
    "MiniMax-Text-01": 1_000_000,
    "MiniMax-VL-01": 524_288,
    "gpt-4o": 128_000,
    "gpt-4o-mini": 128_000,
    "gpt-4-turbo": 128_000,
    "claude-3-5-sonnet-latest": 200_000,
    "claude-3-opus-latest": 200_000,
}


def entry_limit(entry: Column | None = None) -> Column:
    """The first positive of FIELDS (of the row, or of a struct), CEILING at most; null where there is none."""
    value = lambda f: F.col(f) if entry is None else entry[f]
    found = F.coalesce(*(F.when(value(f) > 0, value(f)) for f in FIELDS))
    return F.when(found.isNotNull(), F.least(found, F.lit(CEILING))).cast("long")


def known_limit(model: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    return F.coalesce(table[model], F.lit(UNKNOWN_LIMIT)).cast("long")


def resolve_limits(models: DataFrame, catalogue: DataFrame, model: str = "model", override: str | None = None) -> DataFrame:
    """models with ctx_limit: the override if positive; else the catalogue's entry of that name (case-insensitive), or else
    the first whose id contains the name, in the catalogue's order (`pos`), among entries that have a limit; else the table.

    Neither the catalogue nor the names have a bound. Both are reduced to distinct spellings in lower case first; an id's first
    entry stands for it. Names that are ids are joined by equality. Each of the others is compared with every id, so these
    comparisons are distinct names that are no id x distinct ids; nothing is broadcast that Spark doesn't find small."""
    entries = catalogue.select(F.lower(F.coalesce("id", F.lit(""))).alias("_id"), F.struct(F.col("pos").alias("pos"), entry_limit().alias("limit")).alias("_entry"))
    ids = entries.where("_entry.limit is not null").groupBy("_id").agg(F.min("_entry").alias("_entry"))
    names = models.select(F.lower(model).alias("_name")).where("_name is not null").distinct()
    listed = names.join(ids, F.col("_id") == F.col("_name"), "left").select("_name", "_entry")
    first = listed.where("_entry is null").select("_name").join(ids, F.contains("_id", "_name")).groupBy("_name").agg(F.min("_entry").alias("_entry"))
    best = listed.where("_entry is not null").unionByName(first).select("_name", F.col("_entry.limit").alias("_probed"))
    # Null-safe keys: best is dealt out anew, so Spark sees its size before it picks the join.
    joined = models.join(best, F.lower(models[model]).eqNullSafe(F.col("_name")), "left")
    forced = F.when(F.col(override) > 0, F.col(override)) if override else F.lit(None).cast("long")
    return joined.withColumn("ctx_limit", F.coalesce(forced, "_probed", known_limit(F.col(model))).cast("long")).drop("_name", "_probed")
