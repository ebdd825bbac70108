import corpus_pipeline as pipeline
from tests.llm import plain


def test_stages_on_their_own_inputs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clutter = spark.createDataFrame([(10_001, "123 456 !!", "en", "src1", 10), (10_002, None, "en", "src1", 0), (10_003, "", None, None, None)], docs.schema)
    docs, names = docs.unionByName(clutter), docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert [name for name, _ in pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
    for number, (_, stage) in enumerate(pipeline.STAGES):
        before = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        out = stage(spark, docs, sf_dir).cache()
        rows = out.collect()
        if number < 4:
            assert out.columns == names
            after = sorted((r.doc_id, r.text) for r in rows)
        if number == 0:
            assert after == [x for x in before if x[0] < 10_000]
        if number == 1:
            assert after == sorted((i, text) for i, _, _, text in plain.lines(before, 10))
            assert all(r.n_chars == len(r.text) for r in rows)
        if number == 2:
            found = plain.near(before)
            assert after == [x for x in before if found[x[0]][1] == x[0]] and len(after) < len(before)
        if number == 3:
            clean = {i for i, _, hit, _ in plain.contamination(before, items) if not hit}
            assert after == [x for x in before if x[0] in clean] and len(after) < len(before)
        if number == 4:
            assert sorted(r.doc_id for r in rows) == [i for i, _ in before] and all(r.lossless for r in rows)
            last = sorted((r.doc_id, r.n_pieces, r.ids) for r in rows)
        docs = out
    assert last == sorted((r.doc_id, r.n_pieces, r.ids) for r in pipeline.run(spark, sf_dir).collect())


def test_pipeline_of_nothing(spark, sf_dir, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
