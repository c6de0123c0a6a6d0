"""The corpus pipeline: toxicity, near-dedup, substring dedup, decontamination and mixing.

Each stage reads what the one before it wrote and works on all of it; the first four return
the columns of documents. Texts are cut only by substring dedup (n_chars follows), rows go
with the other decisions: toxic texts, all but one of a group of near copies, texts that
hold benchmark items, and what the mix doesn't take. The last gives a row per document of
the mix: doc_id, size, source_size, target, taken."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import decontamination, mixing, near, substrings, toxicity
from stratalog.llm.common import bounded_batches, fresh, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text scores below toxicity.CUT, with all their columns, whatever these are called.

    The model learns from docs that `labels` knows, so null ids and unlabelled rows are only
    scored. Null and empty texts have no windows and stay; repeated rows go or stay together;
    a table without rows, or without labels of both kinds, is returned as it is."""
    bounded_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "score")
    scored = docs.withColumn(score, toxicity.scores(model, F.col("text")))
    return scored.where(F.col(score) < toxicity.CUT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id, with all its columns.

    Null and empty texts are copies of nothing and stay. Null ids are larger than others. Rows that
    repeat the smallest id of a group all stay, as ids name rows. No rows give none."""
    return near.without_duplicates(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; words covered by a 20-word window that also starts earlier are cut from texts, and
    n_chars follows if there is such a column.

    Null, empty and short texts stay as they are. Of ties none is earlier: rows that repeat an
    id keep what they have at equal places. Other columns stay, whatever they are called."""
    out = substrings.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no benchmark item, with all their columns, whatever these are called.

    Null and empty texts hold none, and null and empty items are held by none. Repeated rows go
    or stay together; without items all rows stay."""
    (found,) = fresh(docs, "hits")
    hits = decontamination.with_hits(docs, found, table(spark, sf_dir, "benchmark"))
    return hits.where(F.size(found) == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document of the mix: doc_id, size, source_size, target, taken (above 0).

    A null source is one of the sources, and the last; texts without words are never taken;
    repeated rows are decided each alike. No rows give none."""
    return mixing.mix(docs).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: The stages aren't SQL; tests/llm/test_queries.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
