"""The operators with production parameters over their whole tables, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, with their scores."""
    from heddle.llm.quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("keep")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.substring_dedup import remove

    return remove(table(spark, sf_dir, "documents"), size=50)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that leaks a benchmark item, with the item."""
    from heddle.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.jaccard_join import join

    return join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("byte_bpe_50k.tiktoken"))


#: The conversation that is formatted besides the table's: its text holds control strings of chat templates.
EXTRA_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.chat import digest, reconstruct, render

    kinds = T.StructType([T.StructField(n, k) for n, k in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()))])
    # values as literals: a local relation of the JVM, no Python rows
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kinds, strict=True))) for row in EXTRA_CONVERSATION))).alias("r")).select("r.*")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest(render(reconstruct(turn_log(rows))))


def turn_log(rows: DataFrame) -> DataFrame:
    """The log that a chat server writes for these turns: a text arrives in two deltas, an assistant's after a dropped draft.

    Each row is a message of its own: its key is the row's number, which a repeated task gives again.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    start, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    event = lambda step, kind, text: F.struct((F.col("turn") * 4 + step).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    asked = F.array(event(0, "message", start), event(1, "delta", rest))
    answered = F.array(event(0, "message", F.lit("")), event(1, "delta", F.lit("draft")), event(2, "regenerate", start), event(3, "delta", rest))
    events = F.explode(F.when(F.col("role") == "assistant", answered).otherwise(asked)).alias("e")
    return rows.withColumn("message", F.monotonically_increasing_id()).select("conv_id", "message", "role", events).select("conv_id", F.col("message").alias("turn"), "role", "e.*")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is moved on by one, then anchors are the rows whose id is divisible by 50."""
    from heddle.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("byte_bpe_50k.tiktoken"), _vocabulary("piece_bpe_32k.model"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the documents whose id's crc32 doesn't leave 2 in four, and held out on the others."""
    from heddle.llm.langid import held_out, identify

    return identify(table(spark, sf_dir, "documents"), held_out(F.col("doc_id")))


_OPERATORS = (
    op1_quality_classifier, op2_html_extraction, op3_license_scan, op4_substring_dedup, op5_token_counts, op6_decontamination, op7_top_k, op8_jaccard_join, op9_packing, op10_chat_format,
    op11_hard_negatives, op12_alignment, op13_language_id,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
