"""Command line: convert a folder of PDF files, or a table of pages, to Markdown files."""

from __future__ import annotations

import argparse
import importlib
import logging
import os
import sys
import uuid
from dataclasses import replace

from leafmill import __version__
from leafmill.config import ConfigError, EngineConfig, NoCache, RetryConfig, safe_folder
from leafmill.operators.pages import PageSpecError, parse_page_spec

CACHES = ("render", "text", "resized", "extract", "format", "summary")


def at_least(least: int):
    def number(raw: str) -> int:
        value = int(raw)
        if value < least:
            raise argparse.ArgumentTypeError(f"expected an integer >= {least}, got {raw}")
        return value

    return number


def page_spec(raw: str) -> str:
    try:
        parse_page_spec(raw)
    except PageSpecError as error:
        raise argparse.ArgumentTypeError(str(error)) from None
    return raw


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("leafmill", description=__doc__)
    p.add_argument("input", nargs="?", help="folder of PDF files, or a Parquet table of pages")
    p.add_argument("-o", "--output", help="folder for the Markdown files")
    p.add_argument("--renderer", help="module:factory of a renderer plugin, for PDF files")
    p.add_argument("--client", default="leafmill.operators.model:EchoClient", help="module:factory of a model client")
    p.add_argument("--dpi", type=at_least(1))
    p.add_argument("-p", "--pages", type=page_spec, help="for example 1-5,8")
    cache = p.add_argument_group("cache")
    cache.add_argument("--cache-dir", default=".leafmill-cache")
    cache.add_argument("--no-intermediates", action="store_true", help="keep nothing but the Markdown files")
    for name in (*CACHES, "all"):
        cache.add_argument(f"--no-cache-{name}", action="store_true")
    features = p.add_argument_group("features")
    features.add_argument("--no-summary", action="store_true")
    features.add_argument("--no-text-hint", action="store_true")
    features.add_argument("--no-fallback-to-text", action="store_true")
    features.add_argument("--stitch-mode", choices=("off", "heuristic", "heuristic_compat"))
    tuning = p.add_argument_group("tuning")
    tuning.add_argument("--max-retries", type=at_least(0), help="0: no bound")
    for name in ("initial-delay", "max-delay", "jitter"):
        tuning.add_argument(f"--retry-{name}", type=float)
    for name, least in (("image-long-side", 64), ("max-summary-chars", 100), ("ctx-limit", 256)):
        tuning.add_argument(f"--{name}", type=at_least(least))
    tuning.add_argument("--image-quality", type=at_least(1))
    tuning.add_argument("--request-timeout", type=float)
    p.add_argument("--model")
    p.add_argument("--persona-version", help="stands for the persona texts in the stored settings, instead of their hash")
    p.add_argument("-V", "--version", action="version", version=f"leafmill {__version__}")
    return p


def settings(args: argparse.Namespace) -> EngineConfig:
    """Flags over environment over defaults."""
    given = {
        "dpi": args.dpi, "pages": args.pages, "model": args.model, "persona_version": args.persona_version, "stitch_mode": args.stitch_mode, "image_long_side": args.image_long_side, "image_quality": args.image_quality,
        "max_summary_chars": args.max_summary_chars, "ctx_limit": args.ctx_limit, "request_timeout": args.request_timeout, "max_attempts": args.max_retries,
        "initial_delay": args.retry_initial_delay, "max_delay": args.retry_max_delay, "jitter": args.retry_jitter, "with_summary": False if args.no_summary else None,
        "text_hint": False if args.no_text_hint else None, "fallback_to_text": False if args.no_fallback_to_text else None,
        "no_cache": NoCache.everything() if args.no_cache_all else NoCache(*(getattr(args, f"no_cache_{x}") for x in CACHES)),
    }
    return EngineConfig.load(given)


def plugin(name: str):
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)


def main(argv: list[str] | None = None) -> int:
    """0 if all went well, 1 for a mistake of the user's or a document that failed; argparse itself ends with 2."""
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s")
    args = parser().parse_args(argv)
    try:
        config = settings(args)
        folder = safe_folder(args.cache_dir)
    except ConfigError as error:
        return failed(error)
    if not args.input or not args.output:
        return failed("an input and --output are needed")
    from pyspark.sql import SparkSession

    from leafmill.plans.convert import DriftError
    from leafmill.sources.catalogue import resolve_limit
    from leafmill.sources.store import Store

    spark = SparkSession.builder.appName("leafmill").getOrCreate()
    store = Store(spark, f"{folder}/run-{uuid.uuid4().hex}" if args.no_intermediates else folder)
    try:
        return run(spark, args, replace(config, ctx_limit=resolve_limit(config, os.environ)), store)
    except DriftError as error:
        return failed(f"the cache was made under other settings ({error}); use --no-cache-all or another folder")
    except PageSpecError as error:
        return failed(error)
    finally:
        if args.no_intermediates:
            store.drop()


def failed(message) -> int:
    print(f"error: {message}", file=sys.stderr)
    return 1


def run(spark, args: argparse.Namespace, config: EngineConfig, store) -> int:
    from pyspark.sql import functions as F

    from leafmill.operators.cache import output_name
    from leafmill.operators.model import Stages
    from leafmill.plans.convert import convert, rendered_pages
    from leafmill.sources import pdf
    from leafmill.sources.store import write_markdown

    renderer, totals, end = plugin(args.renderer) if args.renderer else None, None, 0
    if renderer:
        documents, rejected = pdf.pdfs(pdf.scan_files(spark, args.input))
        for row in rejected.orderBy("path").limit(20).collect():
            end = failed(f"not a PDF: {row.path}")
        if documents.isEmpty():
            return failed("no PDF files")
        pages, totals = rendered_pages(documents, renderer, config, store)
    else:
        pages = spark.read.parquet(args.input)
        for name, kind in (("path", "string"), ("image_path", "string"), ("width", "int"), ("height", "int"), ("image_bytes", "long")):
            if name not in pages.columns:
                pages = pages.withColumn(name, F.lit(None).cast(kind))
    stages = Stages(
        plugin(args.client), config.with_summary, config.text_hint, config.fallback_to_text, config.max_summary_chars,
        config.request_timeout, RetryConfig() if config.retry is None else config.retry,
    )
    found = convert(pages, config, stages, store, totals, renderer)
    for row in found.where("size(failed_pages) > 0").orderBy("doc_id").limit(20).collect():
        end = failed(f"{row.doc_id}: pages {', '.join(map(str, row.failed_pages))} failed ({row.error})")
    paths = pages.groupBy("doc_id").agg(F.max("path").alias("path")).withColumn("doc_id", F.col("doc_id").cast("string"))
    source = F.coalesce("path", F.concat("doc_id", F.lit(".")), F.lit(""))  # an id has no suffix to lose
    named = found.where("size(failed_pages) = 0").join(paths, "doc_id", "left").withColumn("name", output_name(source))
    if clash := named.groupBy(F.lower("name").alias("name")).count().where("count > 1").first():
        return failed(f"{clash['count']} documents would be written to {clash.name}.md")
    written = write_markdown(named, args.output).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).first()
    print(f"{written.n} documents, {written.chars or 0} characters")
    return end
