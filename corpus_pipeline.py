"""A pipeline over the documents: filter, filter, de-duplicate, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last keep the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import mixing, quality, rules, simhash
from nearfield.llm.common import read_table, stored
from nearfield.llm.queries import PIECE_MODEL, tokenized


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def within_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the forest sees all labelled documents, also those rejected before."""
    return rules.keep_by_rules(docs, read_table(spark, sf_dir, "labels"), known=read_table(spark, sf_dir, "documents"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Rows are taken one by one, so repeated rows, repeated and null keys each
    draw for themselves; null text has no words; an empty table stays empty;
    columns of any name pass.
    """
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the text that the ids decode to, for every row.

    Null text is empty and has no ids; repeated rows are each tokenized; an
    empty table stays empty; columns but doc_id and text are not read.
    """
    found = tokenized(docs, PIECE_MODEL)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("quality_classifier", good_quality),
    ("quality_rules", within_rules),
    ("near_dedup", without_copies),
    ("mix", mixed),
    ("pieces", tokens),
]

#: A trained network, a forest and seeded draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
