"""One query per operator over the given tables, and SQL beside those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.context import configure
from tidemark.llm import oracle_sql
from tidemark.llm.decision_list import judged, learned, statistics
from tidemark.llm.decontaminate import decontaminated
from tidemark.llm.hard_negatives import hard_negatives
from tidemark.llm.language_id import identify
from tidemark.llm.line_suffixes import repeated_lines
from tidemark.llm.lm_scoring import lm_scores
from tidemark.llm.merkle import leaf_digest, manifest
from tidemark.llm.ngram_jaccard import jaccard_components
from tidemark.llm.pfair import mixed
from tidemark.llm.secret_crf import scan
from tidemark.llm.shared import lower_ascii, written
from tidemark.llm.token_files import document_tokens
from tidemark.llm.toxicity import toxicity
from tidemark.llm.unit_dedup import repeated_passages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _slot(buckets: int) -> Column:
    """The part of the given split that a document's id falls into."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(buckets))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by family and then by duels within the family."""
    return identify(_table(spark, sf_dir, "documents"), training=_slot(4) != 2)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie inside a ten-word window of a benchmark item."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def op3_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in passages of 50 words that occur earlier in the corpus, or in
    another document at all."""
    found = repeated_passages(_table(spark, sf_dir, "documents"))

    def words(name: str) -> Column:
        sizes = F.transform(name, lambda s: s["end"] - s["start"])
        return F.aggregate(sizes, F.lit(0).cast("long"), lambda n, size: n + size)

    def shown(span: Column) -> Column:
        return F.concat_ws(":", span["start"], span["end"])

    return found.select(
        "doc_id",
        words("removed").alias("n_removed"),
        words("shared").alias("n_shared"),
        F.array_join(F.transform("removed", shown), ",").alias("removed"),
    )


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics of every document and the verdict of the learned rules."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = written(statistics(docs).drop("text"))
    rules = learned(measured, _table(spark, sf_dir, "labels"))
    return judged(measured, rules).select(
        "doc_id",
        *[f"stats.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines")],
        "stats.n_repeat_words",
        "base_failed",
        "rule",
        "kept",
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files of the whole table."""
    found = document_tokens(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens")


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mixture of sources by the square roots of their sizes."""
    found = mixed(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc_id"), "source", "block", "slot", "position", "on_target"
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that belong to later copies of repeated runs of lines."""
    found = repeated_lines(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("drops").cast("long").alias("n_removed"),
        F.array_join(F.transform("drops", lambda at: at.cast("string")), ",").alias("removed"),
        F.col("shared_lines").cast("long").alias("shared_lines"),
    )


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op9_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by patterns and by a conditional random field."""
    return scan(_table(spark, sf_dir, "documents"))


def op10_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and recurrent log10 probabilities of whole documents."""
    return lm_scores(_table(spark, sf_dir, "documents"), training=_slot(5) != 1)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, where every seventh carries another label."""
    own, at = F.col("label"), F.col("vec_id")
    shifted = F.when(F.pmod(at, F.lit(7)) == 0, (own + 1) % 10).otherwise(own)
    return hard_negatives(
        _table(spark, sf_dir, "embeddings"), F.pmod(at, F.lit(50)) == 0, label=shifted
    )


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from the labels of three quarters of them."""
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity(docs, labels, training=_slot(4) != 2)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof in a Merkle manifest by language, and whether a third of them, with
    their letters lowered, still fold to its root."""
    docs = _table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    as_read = [F.col(f) for f in fields]
    lowered = leaf_digest(*as_read[:-1], lower_ascii(F.col("text")))
    found = F.when(_slot(3) == 0, lowered).otherwise(leaf_digest(*as_read))
    return manifest(docs, fields, found=found)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracles() -> dict[str, str]:
    return dict(oracle_sql.SQL)
