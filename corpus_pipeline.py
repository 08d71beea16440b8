"""A training-data pipeline: five stages over documents, each a Spark job over the last one's table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm import langid
from jobtide.llm.linededup import dedup_lines
from jobtide.llm.mixing import mixed_documents
from jobtide.llm.queries import piece_model
from jobtide.llm.sentencepieces import with_pieces
from jobtide.llm.simhash import drop_near_duplicates
from jobtide.llm.workspace import Workspace


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose text has no letter or fits no learned language.

    Learned from the stage's own rows with a language. Where none has one, no text can be
    judged, and all with a letter stay, as do texts found in a language with too few labelled ones.
    """
    model = langid.fit(docs)
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    found = langid.identify(found, model, fits_col="fits")
    if model is None:
        return found.where(F.coalesce("text", F.lit("")).rlike(r"\p{L}")).select("row.*")
    return found.where("fits").select("row.*")


def dedup_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that later documents share; ``n_chars`` follows the text.

    A document that loses all its text goes.
    """
    found = dedup_lines(docs)
    kept = found.where((F.col("n_dropped") == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id."""
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes their words."""
    return mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, with the ids of the text's pieces and their number."""
    return with_pieces(docs, piece_model())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("line dedup", dedup_shared_lines),
    ("SimHash near-dedup", dedup_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: Language models, XXH64 and piece search are beyond SQL; a brute-force version tests the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    space = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = space.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            space.drop(f"stage-{k - 1}")
    return docs
