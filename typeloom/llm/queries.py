"""The operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm import bpe, chat_format, decontaminate, html_text, line_dedup, lm_score, media, near_dup, toxicity, url_filter
from typeloom.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), spans=False)
    return decontaminate.digest(found)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.score(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.digest(near_dup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", "n_near", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT bigint(-1) conv_id, bigint(turn) turn, role, '</s>[INST] ok [/INST]' text FROM VALUES (0, 'user'), (1, 'assistant') t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    rendered = chat_format.render(turns)
    target = chat_format.unescape(F.col("target"))
    loss = chat_format.examples(rendered).groupBy(F.col("conv_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("turn_no", target.alias("target")))).alias("x"), F.sum(F.col("context_chars") + F.col("target_chars")).alias("example_chars"))
    told = rendered.select("conv_id", chat_format.parse(F.col("rendered")).alias("turns"), F.length("rendered").cast("long").alias("formatted_chars"))
    both = told.join(loss, told.conv_id.eqNullSafe(F.col("_id")), "left")
    text = F.coalesce(F.array_join(F.transform("x", lambda e: e["target"]), ""), F.lit(""))
    return both.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), "formatted_chars",
        F.coalesce("example_chars", F.lit(0)).alias("example_chars"), F.coalesce(F.size("x"), F.lit(0)).cast("long").alias("n_examples"),
    )


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_lm_score, op3_near_dup, op4_url_filter, op5_line_dedup, op6_toxicity, op7_chat_format, op8_html_text, op9_media, op10_bpe)}
