"""From raw documents to a mixed training corpus: five stages, each one operator of ``tidemark.llm``.

Every stage takes the documents its predecessor kept and returns documents with the same columns;
the last one adds each document's place in the mixture. ``run`` writes what a stage returns to the
shared folder and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.context import configure
from tidemark.llm.decision_list import judged, learned, statistics
from tidemark.llm.decontaminate import decontaminated
from tidemark.llm.line_suffixes import kept_text, repeated_lines
from tidemark.llm.ngram_jaccard import jaccard_components
from tidemark.llm.pfair import mixed
from tidemark.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or meet a learned rule go; a null text fails it."""
    labels = configure(spark).read.parquet(f"{sf_dir}/labels.parquet")
    measured = written(statistics(docs.select("doc_id", "text")).drop("text"))
    rules = learned(measured, labels)
    return judged(statistics(docs.select(*COLUMNS)), rules).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut out; ``n_chars`` follows the text.

    A document all of whose lines with a word are later copies goes; one without such cuts is as it
    was, null or empty text included. Rows equal in id and text are cut alike, as the first of them.
    """
    configure(spark)
    named = docs.select(*COLUMNS, F.md5("text").alias("digest"))
    cuts = (
        repeated_lines(named, keep=("digest",))
        .groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        .agg(F.min_by("drops", F.size("drops")).alias("drops"))
        .where(F.size("drops") > 0)
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("digest").eqNullSafe(F.col("_digest"))
    cut = named.join(cuts, same, "left").withColumn(
        "left", F.when(F.col("drops").isNotNull(), kept_text(F.col("text"), F.col("drops")))
    )
    emptied = F.col("drops").isNotNull() & ~F.col("left").rlike(r"[^\x20\x09-\x0D]")
    return cut.where(~emptied).select(
        "doc_id",
        F.coalesce("left", "text").alias("text"),
        "lang",
        "source",
        F.coalesce(F.length("left").cast("long"), "n_chars").alias("n_chars"),
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shared shingles, the one with the smallest id stays.

    The sets are of five words and the similarity 0.8. Documents without a word stay, and so do
    those with a null id; of rows that repeat an id one stays.
    """
    configure(spark)
    found = jaccard_components(docs.select("doc_id", "text"), width=5, percent=80)
    first = F.col("component_id") == F.col("doc_id")
    kept = found.where(first).select("doc_id").distinct()
    rows = docs.select(*COLUMNS)
    named = rows.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    unnamed = rows.where(F.col("doc_id").isNull())
    return named.join(kept, "doc_id", "left_semi").unionByName(unnamed)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside any window of a benchmark item go."""
    benchmark = configure(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    named = docs.select(*COLUMNS, F.md5("text").alias("digest"))
    # The verdict follows from the text alone, so the text's digest can stand for the row.
    found = decontaminated(named, benchmark, id_col="digest")
    hit = found.where("contaminated").select(F.col("doc_id").alias("digest")).distinct()
    return named.join(hit, "digest", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, with their slot and position in the mixture of sources."""
    configure(spark)
    rows = docs.select(*COLUMNS, F.col("source").alias("given"))
    placed = mixed(rows, keep=("text", "lang", "given", "n_chars"))
    return placed.select(
        "doc_id",
        "text",
        "lang",
        F.col("given").alias("source"),
        "n_chars",
        "slot",
        "position",
        "on_target",
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
]

#: The first stage's rules are learned, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of ``sf_dir``."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracles() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
