"""A training corpus from raw documents: language ID, quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. run() writes each stage's result to the shared folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelaw.llm import language_id, packing, setsketch, suffix_dedup, weak_quality
from gaugelaw.llm._common import materialise, table, text_or_empty
from gaugelaw.llm.queries import tokenizer_path


def whole_rows(docs: DataFrame) -> DataFrame:
    """Rows (row, text): all columns of docs in one, so that no name of theirs can be that of a result."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a confident language.

    Null and empty texts, those without a letter and rejected ones go. Repeated rows, null ids and
    further columns, whatever their names, stay; ties between languages go to the first by name;
    very long texts are judged whole; an empty table stays empty.
    """
    found = language_id.identify(whole_rows(docs), language_id.fit(docs), keep=("row",))
    return found.filter("accepted").select("row.*")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer accepts, a score of exactly the limit (a tie) too.

    Null and empty texts and those without words go. Repeated rows, null ids and further columns,
    whatever their names, stay; very long texts are judged whole; an empty table stays empty.
    """
    found = weak_quality.classify(whole_rows(docs), weak_quality.fit(docs), keep=("row",))
    return found.filter("accepted").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id; of rows with one id and text (ties), one.

    Rows with a null id come after all others of their group, and rows that share an id but not the
    text are documents of their own. Null and empty texts are linked with nothing; very long texts
    are compared whole; further columns, whatever their names, stay; an empty table stays empty.
    """
    text = text_or_empty("text")
    known = docs.withColumn("__row", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")))
    kept = setsketch.near_duplicates(known, width=5, percent=80, id_col="__row").filter("kept").select("__row").distinct()
    return known.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).select(docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words, or of 400 bytes with fewer words, that start more than once in the corpus.

    Every copy of a passage goes. A document keeps its row if nothing is left of it, and a null text
    becomes an empty one. Repeated rows count as copies; null ids and further columns, whatever their
    names, stay; very long texts are read whole; an empty table stays empty.
    """
    found = suffix_dedup.remove_repeats(whole_rows(docs).select("row", "text"), 400, id_col="row", as_text=True, words=51)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, one row for each piece of a document.

    Null and empty texts are an end mark alone; repeated rows, ties in length and null ids are packed
    as they come, very long texts whole; further columns are not read; an empty table gives no rows.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("packing", pack),
]

#: Several stages train models or use tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
