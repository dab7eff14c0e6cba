"""The corpus pipeline: five stages, each over all that the one before it kept.

Languages are told and rejected documents go; recurring lines go; of near copies one
document stays; repeated passages go; what is left is packed.  Every stage but the
last returns the columns of ``documents``.  Extra columns keep their values, whatever
their names; nulls and repeated rows are handled as each operator says.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedcore.llm import jaccard, language, packing, substrings, templates
from feedcore.llm.common import release, stage, staged_paths
from feedcore.llm.queries import held_out

def over_texts(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` over ``docs``, whose extra columns keep their values, whatever ``work`` calls its own."""
    names = {c: c if c in ("doc_id", "text") else f"_given{i}" for i, c in enumerate(docs.columns)}
    found = work(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())))
    return found.select(*(F.col(n).alias(c) for c, n in names.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is rejected if it has no letter, or if it is like no learned language."""
    model, usual = language.learn(docs, ~held_out())
    bound = language.learned_bound(docs, ~held_out(), usual)

    def work(given: DataFrame) -> DataFrame:
        told = language.predict(given, model, given.columns)
        return told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("familiar") >= bound))

    return over_texts(docs, work)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return over_texts(docs, templates.drop_recurring)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return over_texts(docs, jaccard.distinct_documents)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return over_texts(docs, lambda given: substrings.remove_repeats(given, with_text=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)


Step = Callable[[SparkSession, DataFrame, str], DataFrame]
_STEPS: list[tuple[str, Step]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]
#: Folders staged by the latest call of a stage, by session, table folder and place.
_LEFT: dict[tuple[str, str, int], list[str]] = {}


def _tidy(place: int, step: Step) -> Step:
    """``step``, after what the stage before it staged is deleted: its result is written by now.

    For callers that apply ``STAGES`` themselves, one run at a time a table folder.
    """

    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        session = spark.sparkContext.applicationId
        release(docs, _LEFT.pop((session, sf_dir, place - 1), []))
        with staged_paths() as paths:
            found = step(spark, docs, sf_dir)
        _LEFT[session, sf_dir, place] = paths
        return found

    return run_step


STAGES = [(name, _tidy(place, step)) for place, (name, step) in enumerate(_STEPS)]
#: Languages, templates and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again.

    What a stage staged on its way goes when its result is written; runs share no folder.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in _STEPS[:-1]:
        with staged_paths() as paths:
            found = step(spark, docs, sf_dir)
        docs = stage(found, name)
        release(docs, paths)
    return _STEPS[-1][1](spark, docs, sf_dir)
