"""Registered queries of the engine's own operators, over whole test tables.

Pages are cut from `documents` (400 characters each); sizes, settings and errors, which the test tables don't have, are
made from ids by the same arithmetic here and in the SQL beside each query (plans/oracle.py)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.config import RetryConfig

from leafmill.functions import budget, prompts, retry
from leafmill.functions import text as X
from leafmill.operators import cache, limits, metrics, pages, stitch
from leafmill.operators.model import EchoClient, MalformedOutput, ModelError, Stages, run_stages
from leafmill.plans.convert import outcome
from leafmill.sources import pdf, shared, store
from leafmill.streaming.stitch import stitch_stream as stitched_stream

SIZE = 400


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_split(documents(spark, sf_dir), SIZE)


def double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_split(documents(spark, sf_dir), SIZE, double_breaks=True)


def tabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with headings, table rows, lists and ideographs put in by page number."""
    page = F.col("page_number")
    head = F.when(page % 7 == 2, "| h | k |\n|---|---|\n| a | b |\n").when(page % 7 == 4, "- item ").when(page % 11 == 5, "中文").otherwise("")
    tail = F.when(page % 7 == 1, "\n\n| x | y").when(page % 11 == 4, "中").when(page % 13 == 6, "\n\n# Head").when(page % 5 == 3, " (").otherwise("")
    return double(spark, sf_dir).withColumn("markdown", F.concat(head, "markdown", tail))


def stitched(source, mode: str):
    return lambda spark, sf_dir: stitch.stitch(source(spark, sf_dir), mode)


def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return double(spark, sf_dir).select("doc_id", "page_number", F.posexplode(X.blocks(F.col("markdown"))).alias("position", "block"))


def boundary_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitch.boundaries(tabled(spark, sf_dir))


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabled(spark, sf_dir).select("doc_id", "page_number", X.estimate_text_tokens(F.col("markdown")).alias("tokens"))


def image_bytes() -> Column:
    return F.when(F.col("doc_id") % 10 != 3, F.col("n_chars") * 97 + F.col("doc_id") * 1013)


def image_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = image_bytes()
    return documents(spark, sf_dir).select("doc_id", budget.estimate_image_tokens(size).alias("tokens"), budget.size_at_side(size, F.lit(2000), (F.col("doc_id") % 2000).cast("int")).alias("shrunk"), budget.fallback_side(size).alias("side"))


def budget_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, high = (1000 + F.col("doc_id") % 1700), F.when(F.col("doc_id") % 9 != 4, 300 + (F.col("doc_id") * 7) % 2300)
    plan = budget.plan_for_image(20_000 + F.col("doc_id") * 31, F.lit(120), F.col("n_chars").cast("long"), image_bytes(), wide, high)
    planned = documents(spark, sf_dir).select("doc_id", plan.alias("p"))
    return planned.select("doc_id", "p.total", "p.limit", "p.fits", "p.needed_long_side", "p.reason", budget.needs_resize(F.col("p"), 1536).alias("resize"), budget.attach_side(F.col("p"), 1536).alias("side"))


def strip_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit(" 　"), F.left("text", F.lit(60)), F.lit("<think>a\nb</think>"), F.substring("text", 61, 1 << 30), F.lit("<think></think> \n"), F.when(F.col("doc_id") % 3 == 0, "<think>open").otherwise(""))
    return documents(spark, sf_dir).select("doc_id", X.strip_reasoning(made).alias("text"))


def truncate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", X.truncate_summary(F.col("text"), (F.col("doc_id") % 997 - 3).cast("int")).alias("summary"))


def text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.when(F.col("page_number") % 4 == 0, F.lit(" \n　 ")).otherwise(F.col("markdown"))
    return single(spark, sf_dir).select("doc_id", "page_number", X.text_layer_fallback(layer).alias("markdown"), X.fallback_sentinel(F.col("page_number")).alias("extract_text"))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat_ws("", F.lit(" 2 - "), 2 + F.col("doc_id") % 4, F.lit(" ,1,"), 1 + F.col("doc_id") % 6, F.lit("-"), 4 + F.col("doc_id") % 6)
    return documents(spark, sf_dir).select("doc_id", made.alias("spec"))


def page_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs(spark, sf_dir).select("doc_id", F.posexplode(pages.spec_pages(F.col("spec"))).alias("position", "page"))


def page_spec_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a spec keep no page."""
    return pages.select_pages(single(spark, sf_dir), specs(spark, sf_dir).where("doc_id % 3 <> 0"))


def pages_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = single(spark, sf_dir).groupBy("doc_id").agg(F.max("page_number").alias("total"))
    return pages.pages_out_of_range(specs(spark, sf_dir), counts)


def cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache with holes: some pages missing, some half done, some that fell back."""
    page, mixed = F.col("page_number"), F.col("doc_id") + F.col("page_number")
    extract = F.when(mixed % 11 == 0, X.fallback_sentinel(page)).when(mixed % 7 != 1, F.col("markdown"))
    return single(spark, sf_dir).where(mixed % 5 != 0).select(
        "doc_id", "page_number", extract.alias("extract_text"), F.when(mixed % 6 != 2, F.col("markdown")).alias("format_markdown"), F.when(mixed % 11 == 0, "fallback").otherwise("ok").alias("status")
    )


def missing_pages_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.missing_pages(single(spark, sf_dir), cached_pages(spark, sf_dir)).select("doc_id", "page_number")


def page_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached pages and those still to be made, in order."""
    cached = cached_pages(spark, sf_dir).select("doc_id", "page_number", F.lit("cache").alias("source"))
    fresh = missing_pages_anti(spark, sf_dir).withColumn("source", F.lit("render"))
    return pages.all_pages(cached, fresh)


def resume_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, cached = single(spark, sf_dir).select("doc_id", "page_number"), cached_pages(spark, sf_dir)
    kept = cache.route(F.col("extract_text"), F.col("format_markdown"))
    routed = cache.resume(base, cached, reuse_extract=True).withColumn("route_keeping_fallbacks", kept)
    return routed.select("doc_id", "page_number", "route", "route_keeping_fallbacks", X.is_real_extract(F.col("extract_text")).alias("has_extract"))


def fingerprints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = F.col("doc_id")
    base = documents(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("/in/"), d, F.lit(".pdf")).alias("pdf"), F.lit(144).alias("dpi"), F.lit(True).alias("with_summary"),
        F.when(d % 4 != 0, F.array(F.lit(1), (2 + d % 3).cast("int"))).alias("pages"), F.lit("m").alias("model"), F.lit("v1").alias("persona_version"),
    )
    changed = base.withColumns({
        "pdf": F.when(d % 13 == 1, F.lit("/other.pdf")).otherwise(F.col("pdf")), "dpi": F.when(d % 7 == 2, 200).otherwise(F.col("dpi")),
        "with_summary": F.when(d % 11 == 3, F.lit(False)).otherwise(F.col("with_summary")),
        "pages": F.when(d % 5 == 4, F.array(F.lit(9), F.lit(3), F.lit(9))).when(d % 5 == 3, F.reverse("pages")).otherwise(F.col("pages")),
        "model": F.when(d % 17 == 5, F.lit("n")).otherwise(F.col("model")), "persona_version": F.when(d % 19 == 6, F.lit("v2")).otherwise(F.col("persona_version")),
    })
    return base, changed


def fingerprint_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.check_fingerprints(*fingerprints(spark, sf_dir)).select("doc_id", F.array_join("reasons", "; ").alias("reasons"), F.size("reasons").cast("long").alias("n"))


def meta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, _ = fingerprints(spark, sf_dir)
    raw = F.when(F.col("doc_id") % 6 == 5, F.lit('{"pdf": 3')).when(F.col("doc_id") % 6 == 4, F.lit('{"pdf": "x", "dpi": 1}')).otherwise(store.meta_json(F.struct(*cache.FINGERPRINT)))
    back = stored.select("doc_id", store.parse_meta(raw).alias("m"))
    return back.select("doc_id", "m.pdf", "m.dpi", "m.with_summary", F.size("m.pages").alias("n_pages"), "m.model", F.col("m").isNull().alias("rejected"))


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = F.when(F.col("page_number") % 3 != 1, F.col("markdown"))
    path = cache.artifact_name(F.col("page_number"), ".png")
    hint = F.when(F.col("page_number") % 4 != 2, F.col("markdown"))
    return single(spark, sf_dir).select("doc_id", "page_number", prompts.extract_prompt(path, hint, summary, 100).alias("extract"), prompts.reformat_prompt(F.col("markdown")).alias("reformat"), prompts.summarize_prompt(summary, 500).alias("summarize"))


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    waits = retry.waits((1 + d % 9).cast("int"), 1.0 + (d % 3), 5.0 + (d % 50), F.lit(0.25), (d % 5 - 2) / 2.0)
    return documents(spark, sf_dir).select("doc_id", F.posexplode(waits).alias("attempt", "seconds"))


def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kind = F.when(d % 7 == 0, "timeout").when(d % 7 == 1, "connection").otherwise("status")
    status = F.when(d % 7 > 1, (400 + (d * 13) % 150).cast("int"))
    return documents(spark, sf_dir).select("doc_id", retry.is_transient(kind, status).alias("transient"), retry.error_summary(F.lit("Error"), status, F.concat(F.lit("m"), d.cast("string"))).alias("summary"))


def ctx_limit_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    entries = part.select(
        F.col("p_partkey").alias("pos"), F.concat(F.lit("Model-"), F.col("p_partkey") % 60, F.when(F.col("p_partkey") % 3 == 1, "-snapshot").otherwise("")).alias("id"),
        *(F.when(F.col("p_partkey") % 5 == i - 1, F.col("p_partkey").cast("long") * 9000 * (i % 3)).alias(f) for i, f in enumerate(limits.FIELDS)),
    )
    named = F.when(F.col("doc_id") % 9 == 0, F.lit("gpt-4-turbo")).when(F.col("doc_id") % 9 == 1, F.lit("nobody")).otherwise(F.concat(F.lit("model-"), F.col("doc_id") % 90))
    forced = F.when(F.col("doc_id") % 31 == 7, F.lit(5000).cast("long"))
    models = documents(spark, sf_dir).select("doc_id", named.alias("model"), forced.alias("forced"))
    return limits.resolve_limits(models, entries, override="forced").select("doc_id", "model", "ctx_limit")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.col("doc_id") * 3 + F.col("page_number")
    return single(spark, sf_dir).select("doc_id", "page_number", "markdown", F.when(mixed % 8 == 1, "fallback").otherwise("ok").alias("status"), (mixed % 100 / 8).cast("double").alias("elapsed"))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_metrics(results(spark, sf_dir))


def fallback_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fallback_pages(results(spark, sf_dir)).select("doc_id", F.array_join("pages", ",").alias("pages"), "n")


def page_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_ordinals(page_spec_semi(spark, sf_dir)).select("doc_id", "page_number", "ordinal", "n_pages")


def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with whole texts as names, and with short ones."""
    end = F.concat(F.when(F.col("doc_id") % 4 == 1, "..").otherwise(""), F.lit(".pdf"))
    whole = F.concat(F.lit("/in/"), F.replace("text", F.lit("/"), F.lit("_")), end)
    path = F.concat(F.lit("/in/"), F.when(F.col("doc_id") % 7 != 3, F.concat("source", F.lit(". "), "doc_id")).otherwise(""), end)
    return documents(spark, sf_dir).select("doc_id", cache.cache_key(whole).alias("whole"), cache.cache_key(path).alias("key"), cache.output_name(path).alias("name"), cache.safe_stem(F.when(F.col("doc_id") % 5 == 2, F.lit("com1. ")).otherwise(cache.file_stem(path)), reserve=True).alias("stem"))


def artifact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = cache.artifacts(F.col("page_number") + 9990, F.concat(F.lit("/c/"), F.col("doc_id")))
    return single(spark, sf_dir).select("doc_id", "page_number", named.alias("a")).select("doc_id", "page_number", "a.*")


def data_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("doc_id") % 5 != 1, F.encode("text", "utf-8"))
    url = F.when(F.col("doc_id") % 5 == 2, "https://x/y.png").when(F.col("doc_id") % 5 == 3, "data:image/png;base64,AAAA").otherwise(F.concat(F.lit("/p/"), F.col("doc_id")))
    action = F.when(F.col("doc_id") % 2 == 0, "look")
    return documents(spark, sf_dir).select("doc_id", X.data_url(content).alias("url"), X.image_reference(url, content, action).alias("reference"))


def persona_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.array(*map(F.lit, prompts.PERSONAS))
    return documents(spark, sf_dir).select("source").distinct().select("source", prompts.persona_version(told).alias("version"), prompts.persona_version(F.array_append(told, F.col("source"))).alias("changed"), prompts.backstory(F.lit(prompts.SUMMARIZER)).alias("backstory"))


def model_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages with the stand-in client, page by page: it copies the text hint."""
    given = single(spark, sf_dir).select("doc_id", "page_number", F.lit("p.png").alias("image_path"), F.col("markdown").alias("text_layer"), F.lit("full").alias("route"))
    found = run_stages(given, Stages(EchoClient, with_summary=False))
    return found.select("doc_id", "page_number", "markdown", "extract_text", "status", "attempts")


def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a summary that goes from page to page."""
    given = single(spark, sf_dir).select("doc_id", "page_number", F.lit("p.png").alias("image_path"), F.col("markdown").alias("text_layer"), F.lit("full").alias("route"))
    found = run_stages(given, Stages(EchoClient, with_summary=True, max_summary_chars=150))
    return found.select("doc_id", "page_number", "markdown", "summary", "status", "attempts")


def model_reformat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose extract is there: the formatter alone, over each extract."""
    given = single(spark, sf_dir).select("doc_id", "page_number", F.col("markdown").alias("extract_text"), F.lit("reformat").alias("route"))
    return run_stages(given, Stages(EchoClient, with_summary=False)).select("doc_id", "page_number", "markdown", "extract_text", "status", "attempts")


class Flaky(EchoClient):
    """Refuses some pages, answers nonsense for others, and is busy for up to three calls for the rest."""

    def __init__(self):
        self.calls: dict[str, int] = {}

    def complete(self, stage, system, prompt, image_path, long_side):
        if stage == "extract":
            number = int(re.search(r"\d+", image_path)[0])
            if number % 11 == 7:
                raise ModelError("refused", status=400)
            if number % 13 == 9:
                raise MalformedOutput("bad", errors=2)
            seen = self.calls.pop(prompt, 0) + 1
            if seen <= number % 4:
                if seen < 3:
                    self.calls[prompt] = seen
                raise ModelError("busy", status=503)
        return super().complete(stage, system, prompt, image_path, long_side)


def model_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts at most; then the text layer."""
    given = single(spark, sf_dir).select("doc_id", "page_number", cache.artifact_name(F.col("page_number"), ".png").alias("image_path"), F.col("markdown").alias("text_layer"), F.lit("full").alias("route"))
    found = run_stages(given, Stages(Flaky, with_summary=False, retry=RetryConfig(3, 0, 0, 0)))
    return found.select("doc_id", "page_number", "markdown", "extract_text", "status", "attempts", "error", "malformed")


def convert_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a run in which some pages failed and some have no result."""
    mixed = F.col("doc_id") * 5 + F.col("page_number")
    failed = mixed % 29 == 1
    done = single(spark, sf_dir).where(mixed % 41 != 0).select(
        "doc_id", "page_number", F.when(~failed, F.col("markdown")).alias("format_markdown"),
        F.when(failed, "failed").when(mixed % 8 == 3, "fallback").otherwise("ok").alias("status"), F.when(failed, F.concat(F.lit("E"), "page_number")).alias("error"),
    )
    return outcome(single(spark, sf_dir), done, "off").withColumn("failed_pages", F.array_join("failed_pages", ","))


def stitch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put together from the blocks of a stream of their pages."""
    folder, last = shared.new_folder(spark, "stream"), F.max("page_number").over(Window.partitionBy("doc_id"))
    given = double(spark, sf_dir).withColumn("last_page", last)
    given.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(given.schema).parquet(f"{folder}/in")
    writer = stitched_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    blocks = F.array_sort(F.collect_list(F.struct("position", "block")))
    return spark.read.parquet(f"{folder}/out").groupBy("doc_id").agg(F.array_join(F.transform(blocks, lambda x: x.block), "\n\n").alias("markdown"))


def pdf_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    content = F.when(kind == 0, F.col("text")).when(kind == 1, F.concat(F.lit("%PDF-"), "text")).when(kind == 2, F.concat(F.lit(" %PDF-"), "text"))
    return documents(spark, sf_dir).select("doc_id", pdf.is_pdf(F.encode(content, "utf-8")).alias("is_pdf"))


def summary_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 5
    raw = F.when(kind == 1, "{}").when(kind == 2, store.summary_json(F.col("text"))).when(kind == 3, F.concat(F.lit('{"summary":'), "doc_id", F.lit("}"))).when(kind == 4, F.concat(F.lit("["), "doc_id", F.lit("]")))
    told = documents(spark, sf_dir).select("doc_id", raw.alias("raw"), store.is_corrupt_summary(raw).alias("corrupt"))
    return told.select("doc_id", "corrupt", store.parse_summary(F.when(~F.col("corrupt"), F.col("raw"))).alias("summary"))


def store_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written once, some again, and some deleted."""
    rows, page = single(spark, sf_dir), F.col("page_number")
    version = lambda df, n, deleted=False: df.withColumns({"version": F.lit(n).cast("long"), "deleted": F.lit(deleted)})
    again = version(rows.where(page % 3 == 0).withColumn("markdown", F.concat(F.lit("new "), "markdown")), 2)
    gone = version(rows.where(page % 5 == 0).withColumn("markdown", F.lit(None).cast("string")), 3, True)
    return store.latest(version(rows, 1).unionByName(again).unionByName(gone), ["doc_id", "page_number"])


def cached_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which images of an earlier run can be taken."""
    page, mixed = F.col("page_number"), F.col("doc_id") + F.col("page_number")
    there, dpi, side = F.when(mixed % 4 != 0, "p.png"), F.when(page % 3 != 0, 72 * (1 + mixed % 2)), F.when(page % 5 != 0, 700 + mixed % 3)
    return single(spark, sf_dir).select("doc_id", "page_number", cache.skips_render(there, dpi, 144).alias("render"), cache.skips_resize(there, side, F.lit(701)).alias("resize"))


QUERIES = {
    "page_split": single,
    "stitch_off": stitched(single, "off"),
    "stitch_heuristic": stitched(double, "heuristic"),
    "stitch_unbroken": stitched(single, "heuristic"),
    "stitch_tables": stitched(tabled, "heuristic"),
    "stitch_compat": stitched(tabled, "heuristic_compat"),
    **{f.__name__: f for f in (
        block_split, boundary_decision, text_tokens, image_tokens, budget_plan, strip_think, truncate_summary, text_fallback, page_spec, page_spec_semi,
        pages_out_of_range, missing_pages_anti, page_union, resume_route, fingerprint_drift, meta_round_trip, prompt_build, retry_schedule, error_kinds,
        ctx_limit_resolve, run_metrics, fallback_pages, page_ordinals, cache_key, artifact_paths, data_url, persona_version, model_stages, model_summary,
        model_reformat, model_retries, convert_failures, stitch_stream, pdf_magic, summary_read, store_latest, cached_images,
    )},
}
