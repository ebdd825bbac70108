"""Line dedup: lines whose key occurs in many documents are dropped everywhere. DataFrame functions only."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.tables import column, cut, row_keys, scratch, spread, unused

SPACE = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """A-Z only. `lower` does just that on texts without other letters, and faster."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def line_keys(body: Column) -> Column:
    return F.transform(F.split(lower_ascii(body), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)))


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int, text: str, doc_id: str | None) -> DataFrame:
    """(h1, h2) of the keys that occur in `min_docs` documents or more.

    Distinct keys of each row are counted with map-side aggregation, so a key in a third of all rows costs one row a task. Only
    rows whose id occurs again need more: their keys are counted by id first. Rows with a null id, and all rows without an
    id column, are documents of their own."""
    given = docs.select(F.coalesce(column(text), F.lit("")).alias("body"), (column(doc_id) if doc_id else F.lit(None).cast("long")).alias("id"))
    again = None
    if doc_id:
        again = cut(given.where("id is not null").groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("again")), "again")
        again = None if again.isEmpty() else again
    each = given.select("id", F.explode(F.array_distinct(line_keys(F.col("body")))).alias("key")) if again is None else (
        given.join(again, "id", "left").select(F.when(F.col("again"), F.col("id")).alias("id"), F.explode(F.array_distinct(line_keys(F.col("body")))).alias("key"))
    )
    h1, h2 = hashes(F.col("key"))
    each = each.where(F.length("key") >= min_chars).select("id", h1.alias("h1"), h2.alias("h2"))
    if again is None:
        counted = each.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    else:
        by_id = each.groupBy("h1", "h2", "id").agg(F.count("*").alias("n"))
        counted = by_id.groupBy("h1", "h2").agg(F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(1)).alias("n"))
    return counted.where(F.col("n") >= min_docs).select("h1", "h2")


def dedup_lines(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    text: str = "text",
    into: str = "line_dedup",
    doc_id: str | None = "doc_id",
    inline_keys: int = 50_000,
) -> DataFrame:
    """Adds the struct column `into`: n_lines, n_dropped, text (the lines that stay, joined by newlines).

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of `min_chars` code points or
    more that occur in `min_docs` documents or more lose all their lines. A document is what has one `doc_id`: rows that
    share it (repeated ones, or with other texts) count once; a row with a null id, or any row where there is no such column
    (None), is a document of its own. A null or empty text is one empty line; its result text is empty. Empty keys
    are never dropped for `min_chars` of 1 or more. An existing column named `into` is replaced; other columns, of any name,
    pass through.

    Lines are exploded, hashed to 128 bits and counted (frequent_lines()). Up to `inline_keys` frequent hashes (counted
    first; 1 MB) become part of the expression, as two sets of constants: each row then drops its own lines in place, and no
    text is shuffled. Beyond that, lines are joined to the hashes by a sort-merge join, whose skewed partitions are split
    at run time, the positions of dropped lines go back to their documents, and the rest is put together by position."""
    docs = docs.drop(into)
    doc_id = doc_id if doc_id in docs.columns else None
    with scratch() as keep:
        frequent = cut(frequent_lines(spread(docs), min_docs, min_chars, text, doc_id), "lines")
        if frequent.limit(inline_keys + 1).count() <= inline_keys:
            return _dropped_in_place(docs, frequent, min_chars, text, into)
        return _dropped_by_join(docs, keep(frequent), min_chars, text, into)


def _dropped_in_place(docs: DataFrame, frequent: DataFrame, min_chars: int, text: str, into: str) -> DataFrame:
    body = F.coalesce(column(text), F.lit(""))
    sets = [one_of(frequent, name) for name in ("h1", "h2")]

    def stays(key: Column) -> Column:
        h1, h2 = hashes(key)
        return (F.length(key) < min_chars) | ~(sets[0](h1) & sets[1](h2))

    def told(x: Column) -> Column:
        kept = F.filter(F.arrays_zip(x.lines, x.keys), lambda y: stays(y.keys))
        return F.struct(F.size(x.lines).cast("long").alias("n_lines"), (F.size(x.lines) - F.size(kept)).cast("long").alias("n_dropped"), F.array_join(F.transform(kept, lambda y: y.lines), "\n").alias("text"))

    bound = F.struct(F.split(body, "\n", -1).alias("lines"), line_keys(body).alias("keys"))
    return spread(docs).withColumn(into, F.get(F.transform(F.array(bound), told), F.lit(0)))


def one_of(table: DataFrame, name: str) -> Callable[[Column], Column]:
    """A test for the values of a long column, which is small; they pass from the table to the plan within the JVM."""
    jvm = table.sparkSession._jvm
    values = getattr(table.select(name)._jdf, "as")(jvm.org.apache.spark.sql.Encoders.LONG()).collectAsList()
    return lambda x: Column(x._jc.isInCollection(values))


def _dropped_by_join(docs: DataFrame, frequent: DataFrame, min_chars: int, text: str, into: str) -> DataFrame:
    k1, k2, dropped_at, key, at = unused([*docs.columns, into, "h1", "h2"], "k1", "k2", "dropped", "key", "at")
    body = F.coalesce(column(text), F.lit(""))
    keyed = docs.withColumns(row_keys(*(column(c) for c in dict.fromkeys([*_plain(docs), text])), names=(k1, k2)))
    h1, h2 = hashes(F.col(key))
    dropped = (
        keyed.select(k1, k2, F.posexplode(line_keys(body)).alias(at, key)).where(F.length(key) >= min_chars).select(k1, k2, at, h1.alias("h1"), h2.alias("h2"))
        .join(frequent.hint("merge"), ["h1", "h2"]).groupBy(k1, k2).agg(F.collect_set(at).alias(dropped_at))
    )
    bound = F.struct(F.split(body, "\n", -1).alias("lines"), F.col(dropped_at).alias("dropped"))

    def rest(x: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(x.lines) - 1), x.dropped)
        return F.array_join(F.transform(kept, lambda i: F.get(x.lines, i)), "\n")

    kept = F.when(F.col(dropped_at).isNull(), body).otherwise(F.get(F.transform(F.array(bound), rest), F.lit(0)))
    n_lines = F.size(F.split(body, "\n", -1)).cast("long")
    n_dropped = F.when(F.col(dropped_at).isNull(), 0).otherwise(F.size(dropped_at)).cast("long")
    out = F.struct(n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), kept.alias("text"))
    return keyed.join(dropped, [k1, k2], "left").withColumn(into, out).drop(k1, k2, dropped_at)


def _plain(docs: DataFrame) -> list[str]:
    """Columns that a row key can be made of."""
    return [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant", "void"))]
