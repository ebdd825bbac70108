"""The registered queries of this subpackage; each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import cuckoo, decontaminate, language_id, line_dedup, near_dedup, pseudonyms, quotations, secrets, sentencepiece_sampling, substring_dedup


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1)
    return found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("line_dedup.text"), 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_dedup(documents(spark, sf_dir))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(documents(spark, sf_dir).select("doc_id", "text"), benchmark, window=10)
    items = F.col("found.items")
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x.kind != "owned")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    def judged(verdict: str) -> Column:
        return F.size(F.filter("spans", lambda x: x.verdict == verdict)).cast("long").alias(f"n_{verdict}")

    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), judged("live"), judged("example"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), percent=75)


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key="leafmill-test-key")
    counts = [F.get("pseudonyms.found", F.lit(i)).n.alias(f"n_{kind}") for i, kind in enumerate(pseudonyms.PATTERNS)]
    return found.select("doc_id", F.col("pseudonyms.text").alias("text"), *counts)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(documents(spark, sf_dir), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def quoting_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of `conversations`, which quote nobody, with quotes put in by their numbers: of the message two turns before, of
    that one nested in the one three turns before, or of the first message of the conversation before."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turn, texts = F.col("turn"), talks.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    quoted = lambda text, marks: F.concat(F.regexp_replace(text, "(?m)^", marks), F.lit("\n"))

    def said(name: str, conv: Column, at: Column) -> DataFrame:
        return texts.select(conv.alias("conv_id"), at.alias("turn"), F.col("said").alias(name))

    near, far = said("near", F.col("conv_id"), turn + 2), said("far", F.col("conv_id"), turn + 3)
    other = texts.where("turn = 0").select((F.col("conv_id") + 1).alias("conv_id"), F.lit(4).cast(talks.schema["turn"].dataType).alias("turn"), F.col("said").alias("other"))
    both = talks.join(near, ["conv_id", "turn"], "left").join(far, ["conv_id", "turn"], "left").join(other, ["conv_id", "turn"], "left")
    head = F.when((turn % 5 == 3) & F.col("far").isNotNull(), F.concat(quoted(F.col("far"), "> > "), F.lit("> so it was\n"), quoted(F.col("near"), "> ")))
    head = head.when(turn % 3 == 2, F.concat(F.lit("On Monday they wrote:\n"), quoted(F.col("near"), ">"))).when(turn == 4, quoted(F.col("other"), "> "))
    return both.select("conv_id", "turn", "role", F.concat(F.coalesce(head, F.lit("")), "text").alias("text"))


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.reply_ordered(quoting_conversations(spark, sf_dir))


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_sampling.encode(documents(spark, sf_dir).select("doc_id", "text"), seed=20)
    return coded.select("doc_id", F.size("pieces.ids").cast("long").alias("n_pieces"), "pieces.ids", "pieces.lossless")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(language_id.training_rows(docs))
    told = language_id.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


QUERIES = {
    "op1_quotation_linking": op1_quotation_linking,
    "op2_sentencepiece_sampling": op2_sentencepiece_sampling,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_decontaminate": op5_decontaminate,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_pseudonyms": op9_pseudonyms,
    "op10_substring_dedup": op10_substring_dedup,
}
