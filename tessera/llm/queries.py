"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, jaccard_join, language_id, lexical_search, periodic_runs, quality, secrets, substring_dedup, transport_stream, url_filter
from ._arrow import bound_batches
from .oracles import ORACLES  # noqa: F401  the driver's entry reads it here

VOCABULARY = "byte_bpe_50k.json"
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bound_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES)
    shown = (F.round(c, 9).alias(c) for c in ("bad_mean", "bad_bound"))
    return judged.select("page_id", "host", "path", "rule", "verdict", *shown)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=512)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), digest=True)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), size=4, threshold=(85, 100))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mark = "</s>[INST] ok [/INST]"
    probe = {"conv_id": F.lit(-1), "turn": F.col("id"), "role": F.when(F.col("id") == 0, "user").otherwise("assistant"), "text": F.lit(mark)}
    probe = spark.range(2).select(*(c.cast(given.schema[name].dataType).alias(name) for name, c in probe.items()))
    out = chat_format.format_chats(chat_format.to_events(given.unionByName(probe)))
    turns = F.col("turns")
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    spans = F.transform("loss_spans", lambda s: chat_format.unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    return (
        out.withColumns({"turns": chat_format.parse(F.col("formatted")), "loss": F.array_join(spans, "")})
        .select(
            "conv_id",
            F.size(turns).cast("long").alias("n_turns"),
            F.sha2(said, 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transport_stream.media_column(table(spark, sf_dir, "documents"), keep_media=False)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "stamps", "access_points")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50, keep_text=False)


def with_periods(docs: DataFrame) -> DataFrame:
    """`docs` with the contract's periodic tails: in a tenth of the documents, words from `a` on repeat `p` words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, a, p = F.size("words"), F.col("a"), F.col("p")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    sized = chosen.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int")).withColumn("p", (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), a), tail), " ")
    return sized.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_periods(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    # In order of start and period, so that the first of equal exponents stays.
    best = F.aggregate("runs", none, lambda held, r: F.when(held.isNull() | (r["length"] * held["period"] > held["length"] * r["period"]), r).otherwise(held))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = F.col("best.length"), F.col("best.period")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_token_counts,
        op3_secret_scan,
        op4_bpe_encode_decode,
        op5_ngram_jaccard_join,
        op6_benchmark_decontamination,
        op7_chat_format,
        op8_language_id,
        op9_media_columns,
        op10_substring_dedup,
        op11_periodic_runs,
        op12_quality_classifier,
        op13_lexical_search,
    )
}
