from leafmill.sources import pdf


def files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1\none\x0ctwo\x0cthree")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1\nsingle")
    (tmp_path / "c.pdf").write_bytes(b"not one")
    return pdf.pdfs(pdf.scan_files(spark, str(tmp_path)))


def test_magic_and_rendering(spark, tmp_path):
    documents, rejected = files(spark, tmp_path)
    assert [r.path.rpartition("/")[2] for r in rejected.collect()] == ["c.pdf"]
    assert sorted(r.total for r in pdf.page_counts(documents, pdf.TextRenderer).collect()) == [1, 3]
    found = sorted((r.path[-5:], r.page_number, r.text_layer, r.width, r.image_bytes) for r in pdf.render(documents, pdf.TextRenderer, 72).collect())
    assert found == [("a.pdf", 1, "one", 576, 3), ("a.pdf", 2, "two", 576, 3), ("a.pdf", 3, "three", 576, 5), ("b.pdf", 1, "single", 576, 6)]


def test_chosen_pages_and_resizing(spark, tmp_path):
    from pyspark.sql import functions as F

    documents, _ = files(spark, tmp_path)
    pages = pdf.render(documents.withColumn("pages", F.array(F.lit(3), F.lit(1), F.lit(3))), pdf.TextRenderer, pages="pages")
    assert sorted(r.page_number for r in pages.collect()) == [1, 1, 3]
    written = pdf.render_files(documents, pdf.TextRenderer, str(tmp_path / "images"), 72)
    rows = {(r.text_layer, open(r.image_path, "rb").read(), r.image_path[-14:], r.height) for r in written.collect()}
    assert ("three", b"three", "/page_0003.png", 792) in rows and len(rows) == 4
    smaller = pdf.resize_files(written.withColumn("long_side", F.lit(800)), pdf.TextRenderer, str(tmp_path / "images"), 70)
    assert sorted(open(r.image_path, "rb").read() for r in smaller.collect()) == [b"800 70 one", b"800 70 single", b"800 70 three", b"800 70 two"]
    assert not [x for x in (tmp_path / "images").rglob(".*")]
