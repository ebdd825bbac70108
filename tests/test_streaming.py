import random
import time

from leafmill.operators.stitcher import stitch_pages
from leafmill.streaming.stitch import stitch_stream
from tests.test_stitch import fuzz


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    documents = fuzz(40, seed=11)
    rows = [(f"d{i}", k + 1, text, len(pages) if k % 2 else None) for i, pages in enumerate(documents) for k, text in enumerate(pages)]
    rows += [(f"d{i}", len(pages), pages[-1], len(pages)) for i, pages in enumerate(documents)]  # ends, pages that come again
    random.Random(2).shuffle(rows)
    schema = "doc_id string, page_number int, markdown string, last_page int"
    for part in range(4):
        spark.createDataFrame(rows[part::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stitch_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    found: dict = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("doc_id", "position").collect():
        found.setdefault(r.doc_id, []).append(r.block)
    assert {k: "\n\n".join(v) for k, v in found.items()} == {f"d{i}": t for i, x in enumerate(documents) if (t := stitch_pages(x))}


def test_documents_whose_end_never_comes(spark, tmp_path):
    """A gap and no last page: after a while what is there is given, later pages are ignored, and the state goes."""
    schema, folder = "doc_id string, page_number int, markdown string, last_page int", str(tmp_path / "in")
    add = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)
    add(("d", 1, "shall be", None), ("d", 2, "connected.", None), ("d", 4, "fourth.", None), ("e", 1, "whole.", 1))
    stream = spark.readStream.schema(schema).parquet(folder)
    query = stitch_stream(stream, idle_ms=500).writeStream.format("memory").queryName("blocks").trigger(processingTime="200 milliseconds").start()
    rows = lambda: sorted((r.doc_id, r.position, r.block) for r in spark.table("blocks").collect())
    expected, end = [("d", 0, "shall be connected."), ("d", 1, "fourth."), ("e", 0, "whole.")], time.monotonic() + 90
    try:
        n = 0
        while rows() != expected and time.monotonic() < end:
            n += 1
            add((f"f{n}", 1, None, 1))  # time passes with the batches
            time.sleep(0.5)
        assert rows() == expected
    finally:
        query.stop()
