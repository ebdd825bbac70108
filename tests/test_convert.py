import json

import pytest
from pyspark.sql import functions as F

from leafmill import cli
from leafmill.config import ConfigError, EngineConfig, NoCache, RetryConfig
from leafmill.operators.model import EchoClient, ModelError, Stages
from leafmill.operators.pages import PageSpecError
from leafmill.plans.convert import DriftError, convert, plan_pages, rendered_pages
from leafmill.sources import pdf
from leafmill.sources.store import Store

SCHEMA = "doc_id string, page_number int, text_layer string, image_path string, width int, height int, image_bytes long"
ROWS = [("a", 1, "shall be", "p", 900, 900, 5000), ("a", 2, "connected.", "p", 900, 900, 5000), ("b", 1, "single", "p", None, None, None)]


class Broken(EchoClient):
    def complete(self, stage, system, prompt, image_path, long_side):
        if "connected" in prompt:
            raise ModelError("away", kind="connection")
        return super().complete(stage, system, prompt, image_path, long_side)


class Refusing(EchoClient):
    """Permanent errors for some pages."""

    def complete(self, stage, system, prompt, image_path, long_side):
        if stage == "extract" and ("connected" in prompt or "single" in prompt):
            raise ModelError("no such model", status=404)
        return super().complete(stage, system, prompt, image_path, long_side)


class Never:
    def complete(self, *args):
        raise AssertionError("must not be asked")


def outcomes(spark, folder, client=EchoClient, rows=ROWS, **options):
    config = EngineConfig(retry=RetryConfig(1, 0, 0, 0), **options)
    stages = Stages(client, config.with_summary, retry=config.retry)
    return {r.doc_id: r for r in convert(spark.createDataFrame(rows, SCHEMA), config, stages, Store(spark, str(folder))).collect()}


def run(*args, **options):
    return {k: r.markdown for k, r in outcomes(*args, **options).items()}


@pytest.mark.parametrize("summary", [True, False])
def test_run_and_resume(spark, tmp_path, summary):
    expected = {"a": "shall be connected.", "b": "single"}
    broken = run(spark, tmp_path, Broken, with_summary=summary)
    assert broken["b"] == "single" and "falling back" in broken["a"]
    assert run(spark, tmp_path, with_summary=summary) == expected  # the page that fell back is tried again
    assert run(spark, tmp_path, Never, with_summary=summary) == expected  # all of it is there now


@pytest.mark.parametrize("summary", [True, False])
def test_failures_are_rows(spark, tmp_path, summary):
    rows = [*ROWS, ("a", 3, "more.", "p", 900, 900, 5000), ("c", 1, "fine", "p", 900, 900, 5000)]
    found = outcomes(spark, tmp_path, Refusing, rows, with_summary=summary)
    assert {k: (r.markdown, r.n_chars, r.n_pages, r.failed_pages) for k, r in found.items()} == {"a": (None, None, 3, [2]), "b": (None, None, 1, [1]), "c": ("fine", 4, 1, [])}
    assert "404" in found["a"].error and found["c"].error is None
    store = Store(spark, str(tmp_path))
    assert [r.doc_id for r in store.read("meta").collect()] == ["c"]
    again = outcomes(spark, tmp_path, EchoClient, rows, with_summary=summary)  # failed pages are tried again
    assert {k: r.markdown for k, r in again.items()} == {"a": "shall be connected.\n\nmore.", "b": "single", "c": "fine"}


def test_pages_that_are_not_there(spark, tmp_path):
    with pytest.raises(PageSpecError, match="a: there is no page 3; the last one is 2.*b: there is no page 2"):
        run(spark, tmp_path, pages="1-9")
    assert run(spark, tmp_path / "x", pages="1") == {"a": "shall be", "b": "single"}


def test_a_failed_page_brings_no_older_text_back(spark, tmp_path):
    old = run(spark, tmp_path, dpi=72)
    assert old["b"] == "single"
    new = outcomes(spark, tmp_path, Refusing, dpi=300, no_cache=NoCache.everything())
    assert new["a"].markdown is None and new["b"].markdown is None
    found = {r.doc_id: r.dpi for r in Store(spark, str(tmp_path)).read("meta").collect()}
    assert found == {"a": 72, "b": 72}  # as of the last run that went well
    again = outcomes(spark, tmp_path, EchoClient, dpi=72)  # texts made at 300 are of no use here
    assert again["a"].markdown == old["a"] and again["b"].markdown == old["b"]


class Counted(pdf.TextRenderer):
    """Notes what it renders and resizes in a file beside the input."""

    log = None

    def note(self, *what):
        with open(self.log, "a") as out:
            out.write(json.dumps(what) + "\n")

    def page_count(self, content):
        return super().page_count(content)

    def render(self, content, dpi, pages):
        for page in super().render(content, dpi, pages):
            self.note("render", page.text, dpi)
            yield page._replace(image=page.image * 8000)

    def resize(self, image, side, quality):
        self.note("resize", side)
        return super().resize(image, side, quality)


class Seeing(EchoClient):
    """Its extract is what it sees: the side and the head of the image at the path it is given."""

    def complete(self, stage, system, prompt, image_path, long_side):
        if stage == "extract":
            with open(image_path.removeprefix("file:"), "rb") as file:
                return f"{long_side}: {file.read()[:14].decode()} {image_path in prompt}"
        return super().complete(stage, system, prompt, image_path, long_side)


def test_images_reach_the_model_and_are_made_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF-1\none\x0ctwo\x0cthree")
    log, store = tmp_path / "log", Store(spark, str(tmp_path / "cache"))
    renderer = type("Logged", (Counted,), {"log": str(log)})

    def go(spec=None, **options):
        log.write_text("")
        config = EngineConfig(retry=RetryConfig(1, 0, 0, 0), with_summary=False, stitch_mode="off", ctx_limit=6000, pages=spec, **options)
        documents, _ = pdf.pdfs(pdf.scan_files(spark, str(tmp_path / "in")))
        pages, totals = rendered_pages(documents, renderer, config, store)
        rows = convert(pages, config, Stages(Seeing, False, text_hint=True, retry=config.retry), store, totals, renderer).collect()
        return rows[0].markdown.split("\n\n---\n\n"), sorted(map(tuple, map(json.loads, log.read_text().split("\n")[:-1])), key=repr)

    seen, made = go("1,2")
    assert [x for x in made if x[0] == "render"] == [("render", "one", 144), ("render", "two", 144)]
    sides = [x[1] for x in made if x[0] == "resize"]
    assert len(sides) == 2 and all(768 <= s < 1536 for s in sides)
    assert sorted(int(x.split(": ")[0]) for x in seen) == sides and all(x.split(": ")[0] == x.split()[1] for x in seen)
    assert all(" 85 " in x and x.endswith("True") for x in seen) and "one" in seen[0] and "two" in seen[1]
    assert go("1,2") == (seen, [])  # all of it is there
    with pytest.raises(PageSpecError):
        go("2-4")
    store.delete("meta", store.read("meta"))
    more, made = go()
    assert more[:2] == seen and [x for x in made if x[0] == "render"] == [("render", "three", 144)]
    with pytest.raises(DriftError):
        go("1")
    again, made = go(no_cache=NoCache(render=True))
    assert again == more and len(made) == 3  # rendered again, but nothing is asked or resized


def test_drift_is_refused(spark, tmp_path):
    run(spark, tmp_path)
    with pytest.raises(DriftError, match="dpi changed: cached=144, current=72"):
        run(spark, tmp_path, dpi=72)
    assert run(spark, tmp_path, dpi=72, no_cache=NoCache.everything())["b"] == "single"


def test_plan(spark):
    found = plan_pages(spark.createDataFrame(ROWS, SCHEMA), EngineConfig(ctx_limit=3000)).collect()
    assert all(r.plan.fits for r in found if r.image_bytes is None) and all(r.long_side <= 1536 for r in found)


def test_config():
    given = {"LEAFMILL_DPI": "72", "LEAFMILL_RETRY_MAX_ATTEMPTS": "5", "LEAFMILL_FALLBACK_TO_TEXT": "off"}
    config = EngineConfig.load({"max_attempts": 0, "model": None}, given)
    assert (config.dpi, config.retry.max_attempts, config.fallback_to_text) == (72, 0, False)
    for wrong in ({"LEAFMILL_DPI": "x"}, {"LEAFMILL_FALLBACK_TO_TEXT": "maybe"}, {"LEAFMILL_DPI": "0"}, {"LEAFMILL_REQUEST_TIMEOUT": "900"}):
        with pytest.raises(ConfigError):
            EngineConfig.load({}, wrong)
    assert NoCache.everything().all() and not NoCache(render=True).all()
    for wrong in ({"image_quality": 101}, {"safety": 0}, {"image_long_side": 10}):
        with pytest.raises(ConfigError):
            EngineConfig(**wrong)
    with pytest.raises(ConfigError):
        RetryConfig(initial_delay=5, max_delay=1)


def test_command_line(spark, tmp_path, capsys):
    for name, text in (("one.pdf", b"%PDF-1\nshall be\x0cconnected."), ("bad.pdf", b"no")):
        (tmp_path / name).write_bytes(text)
    arguments = [str(tmp_path), "-o", str(tmp_path / "out"), "--renderer", "leafmill.sources.pdf:TextRenderer", "--cache-dir", str(tmp_path / "cache"), "--max-retries", "1"]
    stop = spark.stop
    try:
        spark.stop = lambda: None
        assert cli.main(arguments) == 1  # one file is no PDF
        (tmp_path / "bad.pdf").unlink()
        assert cli.main(arguments) == 0
    finally:
        spark.stop = stop
    assert [p.read_text() for p in (tmp_path / "out").iterdir()] == ["shall be connected."]
    assert "not a PDF" in capsys.readouterr().err
    assert cli.main([*arguments, "--no-intermediates", "--no-summary"]) == 0 and not list((tmp_path / "cache").glob("run-*"))
    capsys.readouterr()
    assert cli.main([*arguments, "--persona-version", "mine"]) == 1 and "persona_version changed" in capsys.readouterr().err
    assert cli.main([*arguments, "-p", "1-3"]) == 1 and "there is no page 3; the last one is 2" in capsys.readouterr().err
    with pytest.raises(SystemExit) as end:
        cli.main(["-V"])
    assert end.value.code == 0 and capsys.readouterr().out.startswith("leafmill 0.")
    for wrong in (["--image-long-side", "63"], ["--max-summary-chars", "99"], ["--ctx-limit", "255"]):
        with pytest.raises(SystemExit):
            cli.main(wrong)
    assert cli.main([]) == 1 and cli.main(["x", "-o", "y", "--cache-dir", "a/../b"]) == 1
    with pytest.raises(SystemExit) as end:
        cli.main(["-p", "0"])
    assert end.value.code == 2


def test_files_of_like_names_and_failures(spark, tmp_path, capsys):
    rows = [("doc.1", 1, "first"), ("doc.2", 1, "second"), ("Doc.2", 1, "third"), ("x/doc", 1, "single"), ("bad", 1, "connected")]
    spark.createDataFrame(rows, "doc_id string, page_number int, text_layer string").write.parquet(str(tmp_path / "pages"))
    arguments = [str(tmp_path / "pages"), "-o", str(tmp_path / "out"), "--cache-dir", str(tmp_path / "cache"), "--max-retries", "1", "--no-summary"]
    assert cli.main(arguments) == 0
    assert sorted(p.read_text() for p in (tmp_path / "out").iterdir()) == ["connected", "first", "second", "single", "third"]
    assert len({p.name.lower() for p in (tmp_path / "out").iterdir()}) == 5
    refused = [*arguments, "--client", "tests.test_convert:Refusing", "--no-cache-all"]
    refused[2] = str(tmp_path / "more")
    assert cli.main(refused) == 1
    told = capsys.readouterr()
    assert "bad: pages 1 failed" in told.err and "3 documents" in told.out
    assert cli.main([*refused, "--no-intermediates"]) == 1 and not list((tmp_path / "cache").glob("run-*"))
