"""What is kept of earlier runs: keys, completeness, routes, and drift of the settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import is_real_extract

FINGERPRINT = ("pdf", "dpi", "with_summary", "pages", "model", "persona_version")
#: What a route does with a page: nothing, the formatter alone, or all stages.
ROUTES = ("cached", "reformat", "full")
#: Names that some file systems reserve. Fixed values.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"{x}{i}" for x in ("COM", "LPT") for i in range(1, 10))]


def artifact_name(page_number: Column, suffix: str, prefix: str = "page") -> Column:
    """File name of a page's artifact; numbers have four digits or more."""
    return F.format_string(f"{prefix}_%04d{suffix}", page_number)


def artifacts(page_number: Column, folder: Column) -> Column:
    """struct(png, text, resized, extract, format) of paths."""
    kinds = {"png": ".png", "text": "_text.txt", "resized": "_resized.jpg", "extract": "_extract.txt", "format": "_format.md"}
    return F.struct(*(F.concat(folder, F.lit("/"), artifact_name(page_number, suffix)).alias(k) for k, suffix in kinds.items()))


def safe_stem(stem: Column, reserve: bool = False) -> Column:
    """Without blanks and dots at its end; `_` where nothing is left, and behind reserved names if asked for."""
    cut = F.rtrim(stem, F.lit(" ."))
    kept = F.when(F.upper(cut).isin(RESERVED), F.concat(cut, F.lit("_"))).otherwise(cut) if reserve else cut
    return F.when(cut == "", "_").otherwise(kept)


def file_stem(path: Column) -> Column:
    """The file's name without its last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?s)(?<=.)\.[^.]*\z", "")


def cache_key(path: Column) -> Column:
    """A document's folder name: its stem if that has 60 characters at most and no backslash, else 16 hex digits of the
    absolute path's SHA-256. Two documents may share a stem; tables use document_key()."""
    stem = safe_stem(file_stem(path))
    return F.when(F.length(stem).between(1, 60) & ~file_stem(path).contains("\\"), stem).otherwise(F.left(F.sha2(path, 256), F.lit(16)))


def document_key(path: Column) -> Column:
    return F.sha2(path, 256)


def output_name(path: Column) -> Column:
    """A file name for a document: its stem (50 characters at most) and 12 hex digits of its key, so documents of one
    stem, or of stems that differ in their last suffix, don't meet."""
    stem = F.regexp_replace(safe_stem(F.left(file_stem(path), F.lit(50)), reserve=True), r"[\\\\/:]", "_")
    return F.concat(stem, F.lit("-"), F.left(document_key(path), F.lit(12)))


def is_complete(extract: Column, formatted: Column, status: Column | None = None) -> Column:
    """Both texts are there. With a status, pages that fell back aren't complete, so a later run tries them again."""
    there = extract.isNotNull() & formatted.isNotNull()
    return there if status is None else there & (F.coalesce(status, F.lit("ok")) != "fallback")


def skips_render(image: Column, cached_dpi: Column, dpi: int) -> Column:
    return image.isNotNull() & (cached_dpi.isNull() | (cached_dpi == dpi))


def skips_resize(resized: Column, cached_side: Column, side: Column) -> Column:
    return resized.isNotNull() & (cached_side.isNull() | (cached_side == side))


def route(extract: Column, formatted: Column, status: Column | None = None, no_cache_format: bool = False, reuse_extract: bool = False) -> Column:
    """The first of ROUTES that holds: complete pages are kept unless the formatter is to run again; with
    `reuse_extract` a page with a real extract is only formatted again."""
    kept = is_complete(extract, formatted, status) & F.lit(not no_cache_format)
    again = F.lit(reuse_extract and not no_cache_format) & is_real_extract(extract)
    return F.when(kept, "cached").when(again, "reformat").otherwise("full")


def resume(pages: DataFrame, cached: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_number"), refetch_fallbacks: bool = True, **flags: bool) -> DataFrame:
    """pages with extract_text, format_markdown, status, summary_cached and route from the cache (a left join)."""
    summary = F.col("summary") if "summary" in cached.columns else F.lit(None).cast("string")
    joined = pages.join(cached.select(*keys, "extract_text", "format_markdown", "status", summary.alias("summary_cached")), list(keys), "left")
    status = F.col("status") if refetch_fallbacks else None
    return joined.withColumn("route", route(F.col("extract_text"), F.col("format_markdown"), status, **flags))


def _shown_pages(pages: Column) -> Column:
    shown = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.array_distinct(pages)), lambda x: x.cast("string")), ", "), F.lit("]"))
    return F.when(pages.isNull(), "None").otherwise(shown)


def _shown(x: Column, name: str) -> Column:
    if name == "pages":
        return _shown_pages(x)
    if name == "with_summary":
        return F.when(x, "True").when(~x, "False").otherwise("None")
    return x.cast("string") if name == "dpi" else F.concat(F.lit("'"), x, F.lit("'"))


def drift(stored: Column, current: Column) -> Column:
    """Reasons (array of strings, in the order of FINGERPRINT) why results under the stored settings can't be used.
    Lists of pages are compared as sets; no list (all pages) differs from any list."""

    def reason(name: str) -> Column:
        a, b = stored[name], current[name]
        same = F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b))) if name == "pages" else a.eqNullSafe(b)
        told = F.concat(F.lit(f"{name} changed: cached="), F.coalesce(_shown(a, name), F.lit("None")), F.lit(", current="), F.coalesce(_shown(b, name), F.lit("None")))
        return F.when(~same, told)

    return F.array_compact(F.array(*map(reason, FINGERPRINT)))


def check_fingerprints(stored: DataFrame, current: DataFrame, on: str = "doc_id") -> DataFrame:
    """(doc, reasons) of each document that has stored settings; no reasons: its cache is good."""
    a = stored.select(on, F.struct(*FINGERPRINT).alias("_stored"))
    b = current.select(on, F.struct(*FINGERPRINT).alias("_current"))
    return a.join(b, on).select(on, drift(F.col("_stored"), F.col("_current")).alias("reasons"))
