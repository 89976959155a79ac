"""A pipeline over `documents`: five operators in a row, each working on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, language_id, secrets
from tessera.llm._arrow import bound_batches
from tessera.storage import new_path

#: A document whose best language has a mean probability below this is rejected; with four languages 0.25 is chance.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language that stands out, go. `lang` stays as it was given.

    Null and empty texts have no letters. Repeated rows are judged each alike; an empty table stays empty.
    """
    bound_batches(spark)
    judged = language_id.predict(docs, language_id.fit(docs), carry=True)
    return judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays; repeated rows go."""
    bound_batches(spark)
    found = jaccard_join.near_duplicates(docs, size=5, threshold=(80, 100))
    copies = found.filter(F.col("component_id") < F.col("doc_id")).select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(docs.columns)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.

    Null and empty texts have no words and stay, as all do where the benchmark is empty. Repeated rows are judged each alike;
    an empty table stays empty.
    """
    bound_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_contamination(docs, benchmark, carry=True).filter(~F.col("contaminated")).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by a mark, and n_chars follows.

    Null and empty texts stay as they are. Repeated rows are changed each alike; an empty table stays empty.
    """
    bound_batches(spark)
    found = secrets.scan(docs, secrets.train(docs), carry=True)
    changed = F.col("spans") != ""
    return found.select("row.*", "redacted", changed.alias("changed")).select(
        *(
            F.when(F.col("changed"), F.col("redacted")).otherwise(F.col("text")).alias("text") if c == "text"
            else F.when(F.col("changed"), F.length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars"
            else F.col(c)
            for c in docs.columns
        )
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it again.

    A null text counts as empty: no ids, and decoded as it was. Repeated rows are encoded each; an empty table stays empty.
    """
    bound_batches(spark)
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), carry=True)
    same = F.col("decoded") == F.coalesce(F.col("row.text"), F.lit(""))
    return out.select("doc_id", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_copies),
    ("benchmark_decontamination", drop_benchmark_text),
    ("secret_scan", redact_secrets),
    ("bpe_encode_decode", encode),
]

#: Trained models and a tokenizer are part of it, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = new_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}-{k}-{name}")
            docs = spark.read.schema(docs.schema).parquet(f"{base}-{k}-{name}")
    return docs
