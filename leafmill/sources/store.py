"""The tables of a cache folder: pages, settings and summaries; and final documents."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.sources.shared import file_system, put

PAGES = "doc_id string, page_number int, extract_text string, format_markdown string, status string, error string, summary string, settings string"
RENDERS = "doc_id string, page_number int, path string, image_path string, width int, height int, image_bytes long, text_layer string, dpi int"
RESIZED = "doc_id string, page_number int, image_path string, long_side int"
TOTALS = "doc_id string, path string, total int"
META = "doc_id string, pdf string, dpi int, with_summary boolean, pages array<int>, model string, persona_version string"
SUMMARY = "doc_id string, summary string"
SCHEMAS = {"pages": PAGES, "renders": RENDERS, "resized": RESIZED, "totals": TOTALS, "meta": META, "summary": SUMMARY}
KEYS = {table: ["doc_id", "page_number"] if "page_number" in columns else ["doc_id"] for table, columns in SCHEMAS.items()}


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of each key that of the largest version, if it isn't marked as deleted."""
    names = [c for c in rows.columns if c not in (*keys, "version")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "version").alias("row"))
    return last.where("not row.deleted").select(*keys, "row.*").drop("deleted")


class Store:
    """Append-only tables in one folder. A write is one committed batch with a version; a read gives each key's row of the
    largest version, so a crashed run leaves what was there. Versions are the writer's clock, in nanoseconds. compact() rewrites
    a table without old versions; a crash at any point of it loses nothing. Rows hold no images, only their paths."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _file(self, path: str) -> tuple:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def exists(self, table: str) -> bool:
        """Whether there is such a table; what a crashed compact() has put aside comes back first."""
        files, path = self._file(self._path(table))
        aside = self._file(f"{self._path(table)}-aside")[1]
        if not files.exists(path) and files.exists(aside):
            files.rename(aside, path)
        return files.exists(path)

    def _schema(self, table: str) -> T.StructType:
        return T.StructType([*T._parse_datatype_string(SCHEMAS[table]).fields, T.StructField("version", T.LongType()), T.StructField("deleted", T.BooleanType())])

    def _versions(self, table: str) -> DataFrame:
        schema = self._schema(table)
        return self.spark.read.schema(schema).parquet(self._path(table)) if self.exists(table) else self.spark.createDataFrame([], schema)

    def read(self, table: str) -> DataFrame:
        return latest(self._versions(table), KEYS[table])

    def write(self, table: str, rows: DataFrame, deleted: bool = False) -> None:
        """Adds rows by their names; columns that aren't given are null. One row for each key."""
        columns = {f.name: (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType) for f in T._parse_datatype_string(SCHEMAS[table])}
        given = rows.select(*(c.alias(k) for k, c in columns.items())).withColumns({"version": F.lit(time.time_ns()), "deleted": F.lit(deleted)})
        self.exists(table)
        given.write.mode("append").parquet(self._path(table))

    def delete(self, table: str, keys: DataFrame) -> None:
        self.write(table, keys.select(*KEYS[table]), deleted=True)

    def drop(self) -> None:
        """Deletes the folder."""
        files, path = self._file(self.folder)
        files.delete(path, True)

    def compact(self, table: str) -> None:
        """Rewrites beside the table, puts the table aside, takes its place, and only then deletes it. No other writer may be at
        work."""
        fresh = f"{self._path(table)}-{uuid.uuid4().hex}"
        self.read(table).withColumns({"version": F.lit(time.time_ns()), "deleted": F.lit(False)}).write.parquet(fresh)
        files, path = self._file(self._path(table))
        aside = self._file(f"{self._path(table)}-aside")[1]
        files.delete(aside, True)
        files.rename(path, aside)
        files.rename(self._file(fresh)[1], path)
        files.delete(aside, True)


META_JSON = "pdf string, dpi int, with_summary boolean, pages array<int>, model string, persona_version string"


def meta_json(meta: Column) -> Column:
    """A settings struct as JSON; no list of pages stays null."""
    return F.to_json(meta, {"ignoreNullFields": "false"})


def parse_meta(raw: Column) -> Column:
    """A settings struct from JSON; null for anything that isn't an object with all fields of their types (pages may be
    null)."""
    required = [x.split()[0] for x in META_JSON.split(", ") if not x.startswith("pages")]
    found = F.from_json(raw, T._parse_datatype_string(META_JSON), {"mode": "PERMISSIVE"})
    pages = F.get_json_object(raw, "$.pages")
    whole = F.json_array_length(pages) == F.size(F.filter(found.pages, lambda x: x.isNotNull()))
    complete = pages.isNull() | F.coalesce(whole, F.lit(False))
    for name in required:
        complete = complete & found[name].isNotNull()
    return F.when(complete, found)


def summary_json(summary: Column) -> Column:
    return F.to_json(F.struct(summary.alias("summary")))


def is_corrupt_summary(raw: Column) -> Column:
    """Not null and not a JSON object whose summary, if it has one, is a string."""
    kind = F.schema_of_variant(F.try_parse_json(raw))
    value = F.try_variant_get(F.try_parse_json(raw), "$.summary", "variant")
    fits = kind.startswith("OBJECT") & (value.isNull() | (F.schema_of_variant(value) == "STRING"))
    return raw.isNotNull() & ~F.coalesce(fits, F.lit(False))


def parse_summary(raw: Column) -> Column:
    """The summary of a JSON object; empty where there is none; an error for what is corrupt."""
    text = F.coalesce(F.get_json_object(raw, "$.summary"), F.lit(""))
    return F.when(is_corrupt_summary(raw), F.raise_error(F.concat(F.lit("corrupt summary: "), F.left(raw, F.lit(80))))).otherwise(text)


def quarantine(rows: DataFrame, raw: str, folder: str) -> DataFrame:
    """Rows whose summary is fine; the others are added to a table in the folder, with the time."""
    bad = is_corrupt_summary(F.col(raw))
    rows.where(bad).withColumn("seen", F.current_timestamp()).write.mode("append").parquet(folder)
    return rows.where(~bad)


def write_markdown(documents: DataFrame, folder: str, name: str = "name", text: str = "markdown") -> DataFrame:
    """(path, n_chars) of files written, `<name>.md` for each row, each first under another name beside it and then
    moved. The folder is of any file system that pyarrow knows and all workers share. Nothing is written until the result
    is read; a task that runs again writes the same files."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = file_system(folder)
        for batch in batches:
            paths = [f"{root}/{stem}.md" for stem in batch[name]]
            for path, body in zip(paths, batch[text], strict=True):
                put(files, path, (body or "").encode())
            yield pd.DataFrame({"path": paths, "n_chars": batch[text].fillna("").str.len()})

    return documents.select(name, text).mapInPandas(run, "path string, n_chars long")
