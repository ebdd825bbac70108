"""PDF files as rows, and their pages through a renderer plugin."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.cache import document_key
from leafmill.sources.shared import file_system, get, put
from leafmill.sources.store import RENDERS, RESIZED

MAGIC = b"%PDF-"
PAGE = "doc_id string, path string, page_number int, width int, height int, image binary, image_bytes long, text_layer string, dpi int"


class Rendered(NamedTuple):
    page_number: int
    width: int
    height: int
    image: bytes
    text: str


class Renderer(Protocol):
    """Made in each worker; the engine itself can't render. render() gives the pages asked for (None: all) in order; resize() gives
    an image whose long side is `side`."""

    def page_count(self, content: bytes) -> int: ...

    def render(self, content: bytes, dpi: int, pages: list[int] | None) -> Iterator[Rendered]: ...

    def resize(self, image: bytes, side: int, quality: int) -> bytes: ...


class TextRenderer:
    """A stand-in for tests: a magic line, then pages of text between form feeds. Images are the text's bytes."""

    def page_count(self, content):
        return content.count(b"\x0c") + 1

    def render(self, content, dpi, pages):
        for number, page in enumerate(content.partition(b"\n")[2].split(b"\x0c"), 1):
            if pages is None or number in pages:
                yield Rendered(number, 8 * dpi, 11 * dpi, page, page.decode())

    def resize(self, image, side, quality):
        return b"%d %d " % (side, quality) + image


def scan_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, path, length, content, is_pdf), a row for each file; doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(document_key(F.col("path")).alias("doc_id"), "path", "length", "content", is_pdf(F.col("content")).alias("is_pdf"))


def is_pdf(content: Column) -> Column:
    """Whether a file begins as a PDF file does; false for null."""
    return F.coalesce(F.substring(content, 1, len(MAGIC)) == F.lit(MAGIC), F.lit(False))


def pdfs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected files without their content)."""
    return files.where("is_pdf").drop("is_pdf"), files.where(~F.col("is_pdf")).select("doc_id", "path", "length")


def page_counts(documents: DataFrame, renderer: Callable[[], Renderer]) -> DataFrame:
    """(doc_id, path, total)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = renderer()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "path": batch.path, "total": [tool.page_count(bytes(x)) for x in batch.content]})

    return documents.select("doc_id", "path", "content").mapInPandas(run, "doc_id string, path string, total int")


def render(documents: DataFrame, renderer: Callable[[], Renderer], dpi: int = 144, pages: str | None = None) -> DataFrame:
    """PAGE rows: each document's pages, or those in its array column `pages` (null: all). Selection goes into the
    renderer, so other pages aren't rendered. A worker holds one file and one page."""
    chosen = documents.select("doc_id", "path", "content", (F.col(pages) if pages else F.lit(None)).cast("array<int>").alias("pages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = renderer()
        for batch in batches:
            for row in batch.itertuples():
                wanted = None if row.pages is None else sorted(set(map(int, row.pages)))
                for p in tool.render(bytes(row.content), dpi, wanted):
                    yield pd.DataFrame([(row.doc_id, row.path, p.page_number, p.width, p.height, p.image, len(p.image), p.text, dpi)], columns=[x.split()[0] for x in PAGE.split(", ")]).astype({"page_number": "int32", "width": "int32", "height": "int32", "dpi": "int32"})

    return chosen.mapInPandas(run, PAGE)


def render_files(documents: DataFrame, renderer: Callable[[], Renderer], folder: str, dpi: int = 144, pages: str | None = None) -> DataFrame:
    """Like render(), but images go to files, `<folder>/<doc_id>/page_0001.png`, and the rows (RENDERS) have their paths. A
    task that runs again writes the same files."""
    names = [x.split()[0] for x in RENDERS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = file_system(folder)
        for batch in batches:
            paths = [f"{x.doc_id}/page_{x.page_number:04d}.png" for x in batch.itertuples()]
            for path, image in zip(paths, batch.image, strict=True):
                put(files, f"{root}/{path}", bytes(image))
            yield batch.assign(image_path=[f"{folder}/{x}" for x in paths])[names]

    return render(documents, renderer, dpi, pages).mapInPandas(run, RENDERS)


def resize_files(pages: DataFrame, renderer: Callable[[], Renderer], folder: str, quality: int = 85) -> DataFrame:
    """RESIZED rows for pages (doc_id, page_number, image_path, long_side): the images at that side, in files
    `<folder>/<doc_id>/page_0001_resized.jpg`. No image library is part of the engine: the renderer does it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, (files, root) = renderer(), file_system(folder)
        for batch in batches:
            paths = [f"{x.doc_id}/page_{x.page_number:04d}_resized.jpg" for x in batch.itertuples()]
            for path, row in zip(paths, batch.itertuples(), strict=True):
                put(files, f"{root}/{path}", tool.resize(get(row.image_path), int(row.long_side), quality))
            yield batch.assign(image_path=[f"{folder}/{x}" for x in paths])

    return pages.select("doc_id", "page_number", "image_path", "long_side").mapInPandas(run, RESIZED)
