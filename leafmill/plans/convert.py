"""The whole run: files, images, pages, cache, model stages, cache again, documents."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.config import EngineConfig
from leafmill.functions import budget, prompts
from leafmill.functions.text import estimate_text_tokens, fallback_sentinel, text_layer_fallback
from leafmill.operators import cache, metrics
from leafmill.operators.limits import known_limit
from leafmill.operators.model import Stages, run_stages
from leafmill.operators.pages import PageSpecError, missing_pages, pages_out_of_range, parse_page_spec
from leafmill.operators.stitch import stitch
from leafmill.sources import pdf
from leafmill.sources.store import Store

log = logging.getLogger("leafmill.convert")


class DriftError(RuntimeError):
    """The cache was made under other settings."""


def plan_pages(pages: DataFrame, config: EngineConfig) -> DataFrame:
    """pages (doc_id, page_number, text_layer, image_path, width, height, image_bytes) with plan and long_side: the token
    budget of the extract call. Where a running summary will be part of the prompt, its longest form is planned for."""
    layer = F.col("text_layer") if config.text_hint else F.lit("")
    room = F.lit(-(-config.max_summary_chars // 3) + 16 if config.with_summary else 0)
    text = estimate_text_tokens(prompts.extract_prompt(F.coalesce("image_path", F.lit("")), layer, F.lit(""), config.max_summary_chars)) + room
    persona = estimate_text_tokens(prompts.backstory(F.lit(prompts.EXTRACTOR)))
    limit = F.lit(config.ctx_limit).cast("long") if config.ctx_limit else known_limit(F.lit(config.model))
    plan = budget.plan_for_image(limit, persona, text, F.col("image_bytes"), F.col("width"), F.col("height"), config.image_long_side, config.image_min_long_side, config.safety)
    planned = pages.withColumn("plan", plan)
    return planned.withColumn("long_side", budget.attach_side(F.col("plan"), config.image_long_side))


def persona_of(config: EngineConfig) -> Column:
    return F.lit(config.persona_version) if config.persona_version else prompts.persona_version(F.array(*map(F.lit, prompts.PERSONAS)))


def settings(pages: DataFrame, config: EngineConfig) -> DataFrame:
    """The settings of this run for each document, as they are stored."""
    chosen = F.array(*map(F.lit, sorted(set(parse_page_spec(config.pages))))) if config.pages else F.lit(None).cast("array<int>")
    source = F.max("path") if "path" in pages.columns else F.first("doc_id")
    return pages.groupBy("doc_id").agg(source.alias("pdf")).select(
        "doc_id", "pdf", F.lit(config.dpi).alias("dpi"), F.lit(config.with_summary).alias("with_summary"), chosen.alias("pages"),
        F.lit(config.model).alias("model"), persona_of(config).alias("persona_version"),
    )


def page_settings(config: EngineConfig) -> Column:
    """What a page's texts depend on, in one string that is stored with them."""
    return F.concat_ws("|", F.lit(f"{config.dpi}|{config.with_summary}|{config.model}"), persona_of(config))


def check_range(totals: DataFrame, spec: str | None) -> None:
    """An error that names the documents (20 at most) which lack pages of the spec; totals: (doc_id, total)."""
    if not spec:
        return
    bad = pages_out_of_range(totals.select("doc_id", F.lit(spec).alias("spec")), totals.select("doc_id", "total"))
    if worst := bad.join(totals.select("doc_id", "total"), "doc_id").orderBy("doc_id").limit(20).collect():
        raise PageSpecError("; ".join(f"{r.doc_id}: there is no page {r.first_bad_page}; the last one is {r.total}" for r in worst))


def rendered_pages(documents: DataFrame, renderer: Callable[[], pdf.Renderer], config: EngineConfig, store: Store) -> tuple[DataFrame, DataFrame]:
    """(pages with the paths of their images, (doc_id, path, total)) of files (doc_id, path, content).

    The renderer sees only pages whose image the cache hasn't at this resolution, or all if the configuration says so.
    Spans of pages are checked before anything is rendered."""
    store.write("totals", pdf.page_counts(documents, renderer))
    totals = store.read("totals").join(documents.select("doc_id"), "doc_id", "left_semi")
    check_range(totals, config.pages)
    chosen = F.array(*map(F.lit, sorted(set(parse_page_spec(config.pages))))) if config.pages else F.sequence(F.lit(1), F.col("total"))
    target = totals.where("total > 0").select("doc_id", F.explode(chosen).alias("page_number"))
    there = store.read("renders").where(cache.skips_render(F.col("image_path"), F.col("dpi"), config.dpi))
    missing = target if config.no_cache.render or config.no_cache.text else missing_pages(target, there)
    wanted = missing.groupBy("doc_id").agg(F.collect_list("page_number").alias("wanted"))
    store.write("renders", pdf.render_files(documents.join(wanted, "doc_id"), renderer, f"{store.folder}/files", config.dpi, "wanted"))
    return store.read("renders").join(target, ["doc_id", "page_number"], "left_semi"), totals


def with_resized(pages: DataFrame, renderer: Callable[[], pdf.Renderer], config: EngineConfig, store: Store) -> DataFrame:
    """Pages (planned and routed) with image_path of the image to attach: where the plan wants a smaller one and a model will
    see it, that is made, unless the cache has it at this side."""
    keys = ["doc_id", "page_number"]
    wanted = pages.where((F.col("route") == "full") & F.col("image_path").isNotNull() & budget.needs_resize(F.col("plan"), config.image_long_side)).select(*keys, "image_path", "long_side")
    have = store.read("resized").select(*keys, F.col("image_path").alias("small"), F.col("long_side").alias("side"))
    kept = cache.skips_resize(F.col("small"), F.col("side"), F.col("long_side"))
    todo = wanted if config.no_cache.resized else wanted.join(have, keys, "left").where(~kept).select(*wanted.columns)
    store.write("resized", pdf.resize_files(todo, renderer, f"{store.folder}/files", config.image_quality))
    made = wanted.select(*keys, "long_side").join(store.read("resized").withColumnRenamed("image_path", "small"), [*keys, "long_side"]).select(*keys, "small")
    return pages.join(made, keys, "left").withColumn("image_path", F.coalesce("small", "image_path")).drop("small")


def outcome(pages: DataFrame, done: DataFrame, mode: str) -> DataFrame:
    """(doc_id, markdown, n_chars, n_pages, failed_pages, error), a row for each document of pages (doc_id, page_number).

    done: (doc_id, page_number, format_markdown, status, error). A page that failed, or has no row, fails its document: the
    numbers of such pages and the first one's error are given and there is no text. Other documents aren't touched."""
    each = pages.select("doc_id", "page_number").join(done, ["doc_id", "page_number"], "left")
    bad = F.col("status").isNull() | (F.col("status") == "failed")
    faults = F.array_sort(F.collect_list(F.when(bad, F.struct("page_number", F.coalesce("error", F.lit("no result")).alias("error")))))
    told = each.groupBy("doc_id").agg(faults.alias("faults")).select("doc_id", F.transform("faults", lambda x: x.page_number).alias("failed_pages"), F.get("faults", F.lit(0)).error.alias("error"))
    text = stitch(each.withColumn("format_markdown", F.coalesce("format_markdown", F.lit(""))), mode, markdown="format_markdown")
    whole = F.size("failed_pages") == 0
    return text.join(told, "doc_id").select("doc_id", F.when(whole, F.col("markdown")).alias("markdown"), F.when(whole, F.col("n_chars")).alias("n_chars"), "n_pages", "failed_pages", "error")


def convert(pages: DataFrame, config: EngineConfig, stages: Stages, store: Store, totals: DataFrame | None = None, renderer: Callable[[], pdf.Renderer] | None = None) -> DataFrame:
    """outcome() of each document of pages. totals: (doc_id, total), where pages aren't all that the documents have.

    A document whose cache was made under other settings stops the run, unless nothing of the cache is to be used; so does
    a span of pages that a document hasn't. Pages that the cache has complete aren't run again; those that fell back are, unless
    the configuration says otherwise, and those that failed. Model answers and failures are written before anything reads
    them, with the settings they were made under, and only answers under these settings are used, so neither a
    crash nor a failed page brings an older text back. Each page is written with the summary it ended with, so a resumed run
    goes on with the summary of the page before. The settings of documents that failed aren't written."""
    pages = pages.withColumn("doc_id", F.col("doc_id").cast("string"))
    if config.pages:
        check_range(pages.groupBy("doc_id").agg(F.max("page_number").alias("total")) if totals is None else totals, config.pages)
        pages = pages.where(F.col("page_number").isin(parse_page_spec(config.pages)))
    mine, under = settings(pages, config), page_settings(config)
    if not config.no_cache.all():
        drifted = cache.check_fingerprints(store.read("meta"), mine).where(F.size("reasons") > 0)
        if worst := drifted.orderBy("doc_id").limit(20).collect():
            raise DriftError("; ".join(f"{r.doc_id}: {', '.join(r.reasons)}" for r in worst))

    cached = store.read("pages").where(F.col("settings") == under)
    if config.no_cache.all():
        cached = cached.limit(0)
    planned = plan_pages(pages, config)
    routed = cache.resume(planned, cached, refetch_fallbacks=config.retry_fallbacks, no_cache_format=config.no_cache.format, reuse_extract=config.no_cache.extract)
    if config.no_cache.summary:
        routed = routed.withColumn("summary_cached", F.lit(None).cast("string"))
    work = routed.where("route <> 'cached'") if not config.with_summary else routed
    if renderer:
        work = with_resized(work, renderer, config, store)
    results = run_stages(work, stages).where("status <> 'cached'")
    store.write("pages", results.select("doc_id", "page_number", "extract_text", F.col("markdown").alias("format_markdown"), "status", "error", "summary", under.alias("settings")))

    done = store.read("pages").join(pages.select("doc_id", "page_number"), ["doc_id", "page_number"], "left_semi").where(F.col("settings") == under)
    found = outcome(pages, done, config.stitch_mode)
    whole = found.where("size(failed_pages) = 0").select("doc_id")
    if not config.with_summary:
        store.delete("summary", mine)
    elif not config.no_cache.summary:
        store.write("summary", done.join(whole, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by("summary", "page_number").alias("summary")))
    counts = {r.status: r.n for r in done.groupBy("status").agg(F.count("*").alias("n")).collect()}
    for status, told in (("fallback", "used their text layer"), ("failed", "failed")):
        if counts.get(status):
            log.warning("%d pages %s", counts[status], told)
    store.write("meta", mine.join(whole, "doc_id", "left_semi"))
    return found


def dry_results(pages: DataFrame) -> DataFrame:
    """What a run gives when no model can be reached: every page from its text layer."""
    return pages.select("doc_id", "page_number", text_layer_fallback(F.col("text_layer")).alias("markdown"), fallback_sentinel(F.col("page_number")).alias("extract_text"), F.lit("fallback").alias("status"))


__all__ = ["DriftError", "check_range", "convert", "dry_results", "metrics", "outcome", "plan_pages", "rendered_pages", "settings"]
