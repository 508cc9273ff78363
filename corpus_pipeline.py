"""A corpus pipeline: each stage works on all that the one before it kept, written as Parquet and read again.

toxicity rejects documents, exact and near duplicates leave one of each group, mixing takes sources at their target
weights (a document taken twice is there twice), and the rest is encoded. Every stage but the last returns the columns
of ``documents``, whatever else they are named; those beside doc_id, text and source only travel along.

In every stage a null text counts as empty and a null identifier as none: such rows are documents of their own. Rows that
repeat are documents too, so exact dedup leaves one of them. Ties go to the larger identifier in exact dedup and to the
smaller one in near dedup. Texts are worked on whole, however long. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.llm.common import discard, materialise
from framequarry.llm.exact_dedup import exact_dedup
from framequarry.llm.mixing import mix
from framequarry.llm.near_dedup import near_duplicates
from framequarry.llm.queries import MIX_WEIGHTS, MODEL
from framequarry.llm.sentencepiece_codec import Vocabulary, encode
from framequarry.llm.toxicity import fit


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5; the model is fitted on the stage's own documents. Without labels all stay."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(model.score(F.col("text").cast("string")) < 0.5)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest identifier; one row of each, also of those without any identifier."""
    return exact_dedup(docs, carry=True).filter("kept").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest identifier, or one text of a group without any. Empty texts stay."""
    gone = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("gone_id"), "text_hash").distinct()
    own = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (own == gone["text_hash"]), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Empty texts are not taken."""
    taken = mix(docs, MIX_WEIGHTS, carry=True).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip."""
    return encode(docs, Vocabulary.load(MODEL))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL cannot express the fitted model, the sketches or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
