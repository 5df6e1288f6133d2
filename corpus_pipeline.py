"""A training corpus from raw documents: five stages, each an operator of docloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's rows and reads them again as
the next one's docs. All but the last return the columns of documents, and any others that the table has.

Defined results: a null text counts as empty; null ids and rows that repeat an id are rows like others; of rows equal in
text or near each other one stays, also where they repeat an id or have none; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers as tokens
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import table, without, written
from docloom.llm.exact_dedup import one_of_equals
from docloom.llm.jaccard_join import near_duplicates
from docloom.llm.language_id import LEAST_SCORE, UNKNOWN, fit, held_out, identify
from docloom.llm.packing import pack_documents
from docloom.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell; texts without a letter, or without a likely language, go."""
    rows = docs.select(F.col("text").alias("_text"), F.struct(*docs.columns).alias("_row"))
    judged = identify(rows, fit(docs.filter(~held_out())), text_col="_text", keep=("_row",))
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts: the smallest doc_id."""
    return one_of_equals(docs)


def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the smallest doc_id."""
    named = F.xxhash64(F.coalesce("text", F.lit("")))
    classes = near_duplicates(docs.withColumn("_text_hash", named), more=("_text_hash",), choose=True)
    gone = classes.filter(~F.col("chosen")).select(F.col("doc_id").alias("id"), F.col("_text_hash").alias("mark"))
    return without(docs, gone, "doc_id", named)


def repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that occur elsewhere too are cut out of the texts."""
    kept = remove_repeats(docs, keep=tuple(c for c in docs.columns if c != "text"))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return kept.select(*[new.get(c, F.col(f"extra.{c}")).alias(c) for c in docs.columns])


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack_documents(docs, tokens.path("word_bpe_49k.json"))


STAGES = [
    ("language identification", language),
    ("exact duplicates", exact),
    ("near duplicates", near),
    ("repeated passages", repeats),
    ("packing", packed),
]

#: Language identification and packing are not expressible in SQL; the tests hold each operator against brute force and the
#: stages against planted rows and a plain restatement.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
