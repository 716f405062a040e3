"""Cleaning pipeline over ``documents``: each stage is one of the operators, over all that the stage before kept.

All stages but the last return the columns of documents. A stage's text column is read whole; n_chars
follows the text where a stage changes it. Rows with a null text pass the filters and encode to nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionmatch.llm import fm_decontamination as fm
from regionmatch.llm import minhash_forest, piece_lattice, suffix_trees
from regionmatch.llm import toxicity_grammar as tg
from regionmatch.llm.staging import fresh
from regionmatch.session import scratch_path

#: Documents with at least this probability of toxicity are rejected.
TOXIC = 0.7


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the grammar scores as toxic. It is fitted on the labelled raw documents."""
    grammar = tg.fit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    name = fresh("score", docs.columns)
    return tg.score_column(docs, grammar, name=name).filter(F.col(name) < TOXIC).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class, the one with the smallest id. Rows that share an id, or have
    none, are told apart by their texts; of equal rows one stays; rows without a word stay."""
    return minhash_forest.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that repeat an earlier document's; untouched texts stay as they are."""
    return suffix_trees.cut_repeats(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the benchmark contaminates."""
    mark = fresh("contaminated", docs.columns)
    found = fm.mark_contaminated(docs, _read(spark, sf_dir, "benchmark"), mark)
    return found.filter(~F.col(mark)).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, their number, the best segmentations' scores, and whether decoding gives the text back."""
    vocabulary = piece_lattice.load()
    coded = piece_lattice.summary(piece_lattice.encode(docs, vocabulary, keep=("text",)))
    back = piece_lattice.decode(coded, vocabulary)
    return back.select("doc_id", "n_pieces", "ids", "scores", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage is written to the shared folder and read by the next."""
    docs = _read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The first stage's model has no SQL form.
ORACLE_SQL = None
