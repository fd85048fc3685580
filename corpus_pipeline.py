"""A training corpus from documents: quality rules, near duplicates, personal data, mixing, piece ids.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
documents. Nulls, empty texts, repeated rows and further columns are treated as the stages' operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brinewatch.llm import decision
from brinewatch.llm.mixing import mixed
from brinewatch.llm.near import near_groups
from brinewatch.llm.pieces import encoded
from brinewatch.llm.pii import redacted
from brinewatch.llm.queries import PIECES
from brinewatch.llm.tables import read, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    return decision.judged(docs, read(spark, sf_dir, "labels")).where("_kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8): the one of the smallest doc_id.

    Of rows of the same doc_id and text the one of the least other columns stays; rows of that doc_id with other texts, and rows
    without doc_id, all stay.
    """
    kept = near_groups(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others, F.lit(0).alias("_"))).alias("_others"))
    named = named.select(*(F.col(f"`{c}`") if c in ("doc_id", "text") else F.col(f"_others.`{c}`") for c in docs.columns))
    return named.unionAll(docs.where("doc_id is null").select(*docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows."""
    out = redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller sources are repeated up to twice by temperature; nothing is dropped."""
    return mixed(docs, repetition=2.0).select(*docs.columns)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row, their number and digest, and whether they decode to the text."""
    return encoded(docs, PIECES, ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixing),
    ("sentence pieces", sentence_pieces),
]
#: Learned rules, sketches and the piece lattice are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
