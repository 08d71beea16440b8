"""One registered query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm import chat, interactions, langid
from jobtide.llm import sentencepieces as sp
from jobtide.llm import tokenfiles, toxicity
from jobtide.llm.batches import bound_batches
from jobtide.llm.fingerprint import edited_neighbours
from jobtide.llm.lexical import ranked_search
from jobtide.llm.linededup import dedup_lines
from jobtide.llm.maxscore import top_products
from jobtide.llm.mixing import mix
from jobtide.llm.repetition import with_repetition
from jobtide.llm.simhash import near_duplicates
from jobtide.llm.workspace import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The vocabulary file of the registered queries; operators take its path as an argument."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _crc(n: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(-1))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = _crc(3) == 1
    model = langid.fit(docs.where(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: digests of both, and whether the text came back."""
    bound_batches(spark)
    table = sp.load_pieces(piece_model())
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.withColumn("found", sp.round_trip(F.col("text"), table))
    return found.select(
        "doc_id",
        "found.*",
        (F.col("found.decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")), 256)).alias("lossless"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of every document, from flat token files of all of them."""
    folder = Workspace(spark).path("tokens")
    end, filler = tokenfiles.write_token_files(_table(spark, sf_dir, "documents"), folder, piece_model())
    counted = tokenfiles.count_documents(tokenfiles.read_blocks(spark, folder), end, filler=filler)
    return tokenfiles.numbered_counts(counted)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    found = edited_neighbours(_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labels of those that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = _crc(4) == 2
    model = toxicity.fit(docs, labels.where(~held_out))
    found = toxicity.with_toxicity(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and dropped, and the digest of the kept text, of every document."""
    return dedup_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, repetition shares and verdicts of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_repetition(docs).select("doc_id", "repetition.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    mixed, _ = mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


#: A conversation whose texts hold what templates use as control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"
CONTROL_ID = -7


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of one full of control strings, read back from the format."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(CONTROL_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    parts = turns.unionByName(added).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.digest_conversations(parts)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five greatest inner products of every fiftieth vector with the others."""
    return top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters does at each step of all their orders, by source."""
    counts = interactions.survivors(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return interactions.order_report(counts)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
            op1_language_id,
            op2_sentencepiece,
            op3_token_counts,
            op4_fingerprints,
            op5_toxicity,
            op6_line_dedup,
            op7_repetition,
            op8_mix_sources,
            op9_simhash_near_dedup,
            op10_chat_format,
            op11_lexical_search,
            op12_exact_top_k,
            op13_filter_audit,
        )}
