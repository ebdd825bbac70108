"""Page tables: cutting texts into pages, page specs, selections and missing pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X

WIDEST_RANGE = 10_000
_ITEM = re.compile(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?")


class PageSpecError(ValueError):
    """A page spec that can't be read, or names pages that there aren't."""


def page_split(docs: DataFrame, size: int = 400, doc_id: str = "doc_id", text: str = "text", double_breaks: bool = False) -> DataFrame:
    """(doc_id, page_number, markdown): consecutive slices of `size` characters; nothing for null or empty texts. With
    `double_breaks` each line break is a blank line first."""
    body = F.replace(F.col(text), F.lit("\n"), F.lit("\n\n")) if double_breaks else F.col(text)
    slices = F.regexp_extract_all(body, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(slices).alias("page_number", "markdown")).withColumn("page_number", F.col("page_number") + 1)


def parse_page_spec(spec: str) -> list[int]:
    """Pages of a list of numbers and ranges ("1-5, 8"), each once, in the order they are first named."""
    if not isinstance(spec, str) or not spec.strip():
        raise PageSpecError(f"a page list has numbers and ranges such as 1-5,8; this has none: {spec!r}")
    pages: dict[int, None] = {}
    for item in spec.split(","):
        m = _ITEM.fullmatch(item)
        if not m:
            raise PageSpecError(f"neither a number nor a range such as 2-5: {item.strip()!r}")
        first, last = int(m[1]), int(m[2] or m[1])
        if first < 1 or last < 1:
            raise PageSpecError(f"pages are counted from 1: {item.strip()!r}")
        if first > last:
            raise PageSpecError(f"a range ends before it begins: {item.strip()!r}")
        if last - first >= WIDEST_RANGE:
            raise PageSpecError(f"a range of over {WIDEST_RANGE} pages: {item.strip()!r}")
        pages.update(dict.fromkeys(range(first, last + 1)))
    return list(pages)


def resolve_pages(spec: list[int], total: int) -> list[int]:
    """The pages in ascending order; all must be there."""
    if total < 1:
        raise PageSpecError("the document is empty")
    pages = sorted(set(spec))
    for page in pages:
        if not 1 <= page <= total:
            raise PageSpecError(f"there is no page {page}; the last one is {total}")
    return pages


def spec_pages(spec: Column) -> Column:
    """parse_page_spec() as an expression: an array in first-seen order; null for a spec that can't be read."""
    space = f"[{X.SPACE}]*"
    items = F.split(spec, ",", -1)
    fits = F.forall(items, lambda x: x.rlike(rf"\A{space}[0-9]{{1,9}}{space}(?:-{space}[0-9]{{1,9}}{space})?\z"))

    def ends(x: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(x, F.lit("([0-9]+)"), F.lit(1)), lambda n: n.cast("int"))
        return X.bind(numbers, lambda n: F.struct(F.get(n, F.lit(0)).alias("first"), F.get(n, F.size(n) - 1).alias("last")))

    def pages(ranges: Column) -> Column:
        valid = F.forall(ranges, lambda r: (r.first >= 1) & (r.first <= r.last) & (r.last - r.first < WIDEST_RANGE))
        return F.when(valid, F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r.first, r.last)))))

    return F.when(fits, X.bind(F.transform(items, ends), pages))


def select_pages(pages: DataFrame, specs: DataFrame, on: str = "doc_id", page: str = "page_number", spec: str = "spec") -> DataFrame:
    """Rows of pages that their document's spec names (a semi join); documents without a spec keep none. A spec that
    can't be read, or names a page beyond the document, is an error when the rows are read."""
    wanted = specs.select(F.col(on).alias("_doc"), F.explode(F.coalesce(spec_pages(F.col(spec)), F.raise_error(F.concat(F.lit("bad page spec: "), F.coalesce(spec, F.lit("null")))).cast("array<int>"))).alias("_page"))
    return pages.join(wanted, (pages[on] == F.col("_doc")) & (pages[page] == F.col("_page")), "left_semi")


def missing_pages(target: DataFrame, cached: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """Rows of target whose keys cached doesn't have (an anti join)."""
    return target.join(cached.select(*keys), list(keys), "left_anti")


def all_pages(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of both tables, columns by name; what one of them lacks is null."""
    return cached.unionByName(fresh, allowMissingColumns=True)


def pages_out_of_range(specs: DataFrame, counts: DataFrame, on: str = "doc_id", spec: str = "spec", total: str = "total") -> DataFrame:
    """(doc, first_bad_page): for each document whose spec names a page that it hasn't, the smallest such page."""
    named = specs.join(counts, on).select(on, total, F.explode(spec_pages(F.col(spec))).alias("page"))
    return named.where((F.col("page") < 1) | (F.col("page") > F.col(total))).groupBy(on).agg(F.min("page").alias("first_bad_page"))
