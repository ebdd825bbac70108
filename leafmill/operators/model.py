"""Model stages over pages: extract, format and summarise, with retries, time limits and fallback."""

from __future__ import annotations

import random
import re
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.config import RetryConfig
from leafmill.functions import prompts as P
from leafmill.functions import text as X
from leafmill.functions.retry import PASSING, wait_times

RESULT = "page_number int, markdown string, extract_text string, summary string, status string, error string, attempts int, elapsed double, malformed int"
COLUMNS = ["doc_id", "page_number", "image_path", "text_layer", "extract_text", "format_markdown", "route", "long_side", "summary_before", "summary_cached"]


class ModelError(Exception):
    """A failed call; kind is "timeout", "connection", or the server's own word."""

    def __init__(self, message: str, kind: str = "status", status: int | None = None):
        super().__init__(message)
        self.kind, self.status = kind, status

    @property
    def transient(self) -> bool:
        return self.kind in PASSING or (self.status or 0) >= 500 or self.status == 429

    def __str__(self) -> str:
        head = type(self).__name__ if self.status is None else f"{type(self).__name__}: status={self.status}"
        return f"{head}: {self.args[0]}"


class MalformedOutput(Exception):
    """An answer that can't be read: not tried again. `errors` is how many faults were found in it."""

    def __init__(self, message: str, errors: int = 1):
        super().__init__(message)
        self.errors = errors

    def __str__(self) -> str:
        return f"MalformedOutput: {self.errors} fault(s): {self.args[0]}"


class ModelClient(Protocol):
    def complete(self, stage: str, system: str, prompt: str, image_path: str | None, long_side: int | None) -> str: ...


class EchoClient:
    """A deterministic stand-in: extracts the text hint, formats by returning the extract, summarises by its head."""

    def complete(self, stage, system, prompt, image_path, long_side):
        fenced = re.search(r"```\n(.*)\n```", prompt, re.S)
        return fenced[1] if fenced else "" if stage == "extract" else prompt.rpartition("\n\n")[2]


@dataclass(frozen=True)
class Stages:
    """What a worker needs. `client` makes a ModelClient; it is called once in each worker."""

    client: Callable[[], ModelClient]
    with_summary: bool = True
    text_hint: bool = True
    fallback_to_text: bool = True
    max_summary_chars: int = P.MAX_SUMMARY_CHARS
    timeout: float | None = None
    retry: RetryConfig = RetryConfig()
    fail_fast: bool = False
    keep_summary: bool = True
    sleep: Callable[[float], None] = time.sleep
    seed: int = 0


def within(seconds: float | None, call: Callable[[], str]) -> str:
    """call()'s result; a transient ModelError after so many seconds. The thread can't be killed and is left behind."""
    if seconds is None:
        return call()
    box: list = []

    def work():
        try:
            box.append((call(), None))
        except BaseException as error:  # noqa: BLE001
            box.append((None, error))

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if not box:
        raise ModelError(f"no answer within {seconds:g} s", kind="timeout")
    result, error = box[0]
    if error is not None:
        raise error
    return result


def call_with_retry(call: Callable[[], str], retry: RetryConfig, timeout: float | None = None, sleep: Callable[[float], None] = time.sleep, seed: int = 0) -> tuple[str, int]:
    """(result, attempts). Transient errors are tried again until the attempts are used up; others are raised at once."""
    delays = wait_times(retry.initial_delay, retry.max_delay, retry.jitter, random.Random(seed))
    attempt = 0
    while True:
        attempt += 1
        try:
            return within(timeout, call), attempt
        except MalformedOutput as error:
            error.attempts = attempt
            raise
        except ModelError as error:
            error.attempts = attempt
            if not error.transient or attempt == retry.max_attempts:
                raise
        sleep(next(delays))


def clean(text: str | None) -> str:
    """Without reasoning blocks and white space at the ends."""
    return re.sub(r"(?s)<think>.*?</think>", "", text or "").strip(X.SPACES)


class PageRunner:
    """Runs the stages of one page after the other; the summary goes from page to page."""

    def __init__(self, stages: Stages):
        self.stages, self.client, self.calls = stages, stages.client(), 0

    def ask(self, stage: str, system: str, prompt: str, image_path: str | None = None, side: int | None = None) -> str:
        s = self.stages
        text, attempts = call_with_retry(lambda: self.client.complete(stage, system, prompt, image_path, side), s.retry, s.timeout, s.sleep, s.seed)
        self.calls += attempts
        return clean(text)

    def run(self, page: dict, summary: str) -> tuple[dict, str]:
        began, self.calls = time.monotonic(), 0
        row = {"doc_id": page["doc_id"], "page_number": page["page_number"], "error": None, "status": "ok", "malformed": 0}
        layer, old = page["text_layer"] or "", page["extract_text"]
        try:
            if page["route"] == "cached":
                row |= {"markdown": (page["format_markdown"] or "").strip(X.SPACES), "extract_text": old, "status": "cached"}
                summary = page["summary_cached"] or summary
            else:
                found, summary = self.stage(page, layer, old, summary)
                row |= found
        except (ModelError, MalformedOutput) as error:
            self.calls = max(self.calls, getattr(error, "attempts", 0))
            row |= {"error": str(error), "malformed": getattr(error, "errors", 0)}
            passing = isinstance(error, MalformedOutput) or error.transient
            if not passing or not self.stages.fallback_to_text:
                if self.stages.fail_fast:
                    raise
                row |= {"markdown": None, "extract_text": None, "status": "failed"}
            elif page["route"] == "reformat":
                row |= {"markdown": old, "extract_text": old, "status": "fallback"}
            else:
                row |= {"markdown": fallback_text(layer), "extract_text": sentinel_text(page["page_number"]), "status": "fallback"}
        return row | {"summary": summary, "attempts": self.calls, "elapsed": time.monotonic() - began}, summary

    def stage(self, page: dict, layer: str, old: str | None, summary: str) -> tuple[dict, str]:
        s = self.stages
        if page["route"] == "reformat":
            extract = old
            markdown = self.ask("format", P.FORMATTER, P.REFORMAT + extract + "\n```")
        else:
            prompt = extract_prompt_text(page["image_path"], layer if s.text_hint else "", summary, s.max_summary_chars)
            extract = self.ask("extract", P.EXTRACTOR, prompt, page["image_path"], page["long_side"])
            markdown = self.ask("format", P.FORMATTER, f"{P.FORMAT}\n\n{extract}")
        if s.with_summary:
            before = P.FIRST_PAGE if not summary.strip(X.SPACES) else f"{P.PREVIOUS}{summary}\n\n"
            told = self.ask("summarize", P.SUMMARIZER, f"{before}{P.SUMMARIZE % s.max_summary_chars}\n\n{markdown}")
            summary = cut_summary(told, s.max_summary_chars)
        return {"markdown": markdown, "extract_text": extract}, summary


def cut_summary(text: str, most: int) -> str:
    """functions.text.truncate_summary() on a string."""
    room = most - len(X.SUMMARY_MARK) - 2
    if most <= 0 or len(text) <= most:
        return text
    head, tail = text[: room // 2].rstrip(X.SPACES), text[len(text) - (room + 1) // 2 :].lstrip(X.SPACES)
    return text[:most] if room < 0 else f"{head}\n{X.SUMMARY_MARK}" + (f"\n{tail}" if tail else "")


def extract_prompt_text(image_path: str | None, layer: str, summary: str, most: int) -> str:
    """functions.prompts.extract_prompt() on strings."""
    summary, layer = cut_summary(summary, most), layer.strip(X.SPACES)
    before = f"{P.SO_FAR}{summary}\n\n" if summary.strip(X.SPACES) else ""
    hint = f"{P.HINT}{layer}\n```\n\n" if layer else ""
    return before + hint + str(image_path).join(P.ATTACH) + P.RULES


def sentinel_text(page_number: int) -> str:
    return f"{X.SENTINEL} {page_number}{X.SENTINEL_END}"


def fallback_text(layer: str) -> str:
    layer = layer.strip(X.SPACES)
    return f"{X.NOTICE}\n\n```\n{layer}\n```\n" if layer else X.NOTHING


def _rows(found: list[dict]) -> pd.DataFrame:
    names = ["doc_id", *(x.split()[0] for x in RESULT.split(", "))]
    return pd.DataFrame(found, columns=names).astype({"page_number": "int32", "attempts": "int32", "malformed": "int32"})


def _records(batch: pd.DataFrame) -> list[dict]:
    return batch.astype(object).where(batch.notna(), None).to_dict("records")


def _apart(stages: Stages):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner = PageRunner(stages)
        for batch in batches:
            yield _rows([runner.run(page, page["summary_before"] or "")[0] for page in _records(batch)])

    return run


def _in_turn(stages: Stages):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner, document, summary = PageRunner(stages), object(), ""
        for batch in batches:
            found = []
            for page in _records(batch):
                if page["doc_id"] != document:
                    document, summary = page["doc_id"], page["summary_before"] or ""
                row, summary = runner.run(page, summary)
                found.append(row)
            yield _rows(found)

    return run


def run_stages(pages: DataFrame, stages: Stages, partitions: int | None = None) -> DataFrame:
    """doc_id and RESULT for each page (COLUMNS; those that aren't there are null. summary_before is what a document begins with,
    summary_cached what a cached page ended with).

    Without a summary pages are independent and stay where they are. With one they go to their document's partition
    and through it in page order, one after the other: a worker holds one page and one summary, however long the
    document. `partitions` bounds the calls at a time. Images are references, never bytes.

    Calls aren't repeatable: write the result before it is read twice, and run without speculative execution. A failed
    document has status `failed` for the page, or with `fail_fast` fails the job."""
    given, schema = pages, f"doc_id {pages.schema['doc_id'].dataType.simpleString()}, {RESULT}"
    for name, kind in (("summary_before", "string"), ("summary_cached", "string"), ("long_side", "int"), ("image_path", "string"), ("extract_text", "string"), ("format_markdown", "string"), ("text_layer", "string")):
        given = given.withColumn(name, (F.col(name) if name in pages.columns else F.lit(None)).cast(kind))
    given = given.select(*COLUMNS)
    if not stages.with_summary:
        dealt = given.repartition(partitions) if partitions else given
        return dealt.mapInPandas(_apart(stages), schema)
    dealt = given.repartition(*([partitions] if partitions else []), "doc_id").sortWithinPartitions("doc_id", "page_number")
    return dealt.mapInPandas(_in_turn(stages), schema)
