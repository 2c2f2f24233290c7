"""A corpus pipeline: toxicity, near duplicates, repeated passages, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before has written, and
returns a DataFrame. All but the last return the columns of documents, so that a stage can
stand in for another; the last returns the pieces of the packed sequences.

The stages decide: rejected documents go (toxicity 0.5 or more; all but one document of each
near-duplicate group, on 5-word shingles at a similarity of 0.8; documents that hold a window
of the benchmark), and passages of 50 words or more that an earlier document has are cut from
the later ones.

What holds for every stage: a null or empty text is clean, so its document stays; a document
without a doc_id stays, as far as its text is clean; a very long text is read whole; an empty
table gives an empty table; columns besides doc_id and text are carried as they are, whatever
their names (only n_chars follows a text that is cut). Stages say below how they treat ties
and repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import decontamination, neardup, packing, passages, toxicity
from tidewheel.llm.common import delete_path, shared_path, table, tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted on the labelled ones among ``docs``, does not predict to be toxic.

    A score of exactly 0.5 is a rejection. Rows that repeat an id or a text are judged alike,
    each by its own text; without a labelled row nothing is known and all documents stay.
    """
    machine = toxicity.fit(docs, table(tune(spark), sf_dir, "labels"))
    return toxicity.score(docs, machine, carry=docs.columns).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id.

    Rows that repeat a doc_id and text are one row from here on. Texts without words are
    near duplicates of nothing.
    """
    tune(spark)
    return neardup.deduplicated(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that one with a smaller doc_id has; n_chars follows.

    A document of which no word is left goes. Of rows that repeat a doc_id all are cut alike;
    rows without a doc_id are left as they are.
    """
    tune(spark)
    return passages.cut(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of 13 words of the benchmark, and of which fewer than one word in twenty is hit.

    Only the second rule counts for items of fewer than 13 words: such a run of common words
    may stand in a long clean document by chance. Repeated rows are judged alike; with an
    empty benchmark all documents stay.
    """
    found = decontamination.contamination(docs, table(tune(spark), sf_dir, "benchmark"), carry=docs.columns)
    return found.where(f"n_hit < {decontamination.WINDOW} and not contaminated").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids; every row of ``docs`` is packed, an empty text as its end id alone."""
    tune(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the fitted model or the encoding; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder, read by the next, and then removed.

    The last of these folders stays, as the result reads it.
    """
    docs, done = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:
            delete_path(spark, done)
        done = path
    return STAGES[-1][1](spark, docs, sf_dir)
