import threading
import time

import pytest

from leafmill.config import RetryConfig
from leafmill.operators.model import EchoClient, MalformedOutput, ModelError, PageRunner, Stages, call_with_retry, run_stages, within


class Scripted:
    """Answers from a list; exceptions in it are raised."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def complete(self, stage, system, prompt, image_path, long_side):
        self.asked.append((stage, prompt))
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def page(**other):
    return {"doc_id": "d", "page_number": 3, "image_path": "p.png", "text_layer": "layer", "extract_text": None, "format_markdown": None, "route": "full", "long_side": 9, "summary_cached": None} | other


def run(client, page, summary="", **options):
    waits = []
    stages = Stages(lambda: client, sleep=waits.append, retry=options.pop("retry", RetryConfig(3, 2, 900, 0)), **options)
    row, after = PageRunner(stages).run(page, summary)
    return row, after, waits


def test_three_calls_in_order():
    client = Scripted(" raw ", "<think>x</think>clean", "sum")
    row, summary, _ = run(client, page(), "before")
    assert (row["markdown"], row["extract_text"], row["status"], row["attempts"], summary) == ("clean", "raw", "ok", 3, "sum")
    assert [s for s, _ in client.asked] == ["extract", "format", "summarize"]
    assert "before" in client.asked[0][1] and "layer" in client.asked[0][1]


def test_transient_errors_are_tried_again():
    client = Scripted(ModelError("busy", status=503), ModelError("slow", kind="timeout"), "raw", "clean")
    row, _, waits = run(client, page(), with_summary=False)
    assert row["status"] == "ok" and row["attempts"] == 4 and waits == [2, 2]


def test_exhaustion_falls_back_and_keeps_the_summary():
    client = Scripted(*[ModelError("busy", status=429)] * 3)
    row, summary, waits = run(client, page(), "before")
    assert row["status"] == "fallback" and "layer" in row["markdown"] and row["extract_text"].startswith("(vision model unavailable for page 3")
    assert summary == "before" and waits == [2, 2] and "status=429" in row["error"]


def test_malformed_output_falls_back_at_once():
    row, _, waits = run(Scripted(MalformedOutput("bad")), page())
    assert row["status"] == "fallback" and waits == []


def test_permanent_errors_fail_the_page_or_the_job():
    row, _, _ = run(Scripted(ModelError("no", status=400)), page())
    assert row["status"] == "failed" and row["markdown"] is None
    with pytest.raises(ModelError):
        run(Scripted(ModelError("no", status=400)), page(), fail_fast=True)


def test_reformat_uses_the_old_extract():
    client = Scripted("clean")
    row, _, _ = run(client, page(route="reformat", extract_text="old"), with_summary=False)
    assert row["markdown"] == "clean" and row["extract_text"] == "old" and [s for s, _ in client.asked] == ["format"]
    row, _, _ = run(Scripted(MalformedOutput("bad")), page(route="reformat", extract_text="old"), with_summary=False)
    assert row["markdown"] == "old" and row["status"] == "fallback"


def test_cached_pages_call_nothing():
    row, summary, _ = run(Scripted(), page(route="cached", format_markdown=" md ", extract_text="e", summary_cached="then"), "before")
    assert row["markdown"] == "md" and row["status"] == "cached" and summary == "then"


def test_time_limit():
    began = time.monotonic()
    with pytest.raises(ModelError) as error:
        within(0.2, lambda: threading.Event().wait(5))
    assert error.value.transient and time.monotonic() - began < 1


def test_unlimited_attempts():
    client = Scripted(*[ModelError("x", kind="connection")] * 40, "done")
    assert call_with_retry(lambda: client.complete("", "", "", None, None), RetryConfig(0, 1, 5, 0.25), sleep=lambda s: None) == ("done", 41)


def test_summary_goes_from_page_to_page(spark):
    class Counting(EchoClient):
        def complete(self, stage, system, prompt, image_path, long_side):
            if stage == "summarize":
                before = prompt.partition("Previous running summary:\n")[2].partition("\n")[0]
                return f"{before}+{prompt.rpartition(chr(10) * 2)[2]}"
            return super().complete(stage, system, prompt, image_path, long_side)

    rows = [(d, n, "p", f"t{d}{n}", "full") for d in range(5) for n in range(1, 5)]
    pages = spark.createDataFrame(rows, "doc_id int, page_number int, image_path string, text_layer string, route string").repartition(7)
    found = {(r.doc_id, r.page_number): r.summary for r in run_stages(pages, Stages(Counting)).collect()}
    assert found[2, 4] == "+t21+t22+t23+t24" and found[4, 1] == "+t41"
