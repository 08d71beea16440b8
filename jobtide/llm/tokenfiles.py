"""Token counts from flat, unindexed token files, by a scan for end-of-document identifiers.

A writing task puts its documents one behind the other into a stream of little-endian identifiers, each
document closed by the same end identifier, without an index. A stream is a row of files of bounded
size, whatever the documents; a filler identifier may stand between any two. Files are cut into blocks; numpy finds a
block's end identifiers all at once. A document that goes over the borders of blocks or files is put together by
a prefix scan over the small records of the blocks of its stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtide.llm.batches import bound_batches, pieces

#: Identifiers of 16 bits. Those from RESERVED on are outside of the vocabulary: five of them, 15 bits each,
#: open a document with its number, so that a stream without index can still be told apart.
DTYPE = "<u2"
RESERVED = 1 << 15
HEADER = 5
NO_ID = 1 << 14
BLOCK_TOKENS = 1 << 18
#: Identifiers that are written at once, and such chunks of a file: 32 MB a file.
CHUNK_TOKENS = 1 << 18
FILE_CHUNKS = 64
BATCH_ROWS = 1024
BATCH_CHARS = 1 << 20


def _header(ids: np.ndarray, missing: np.ndarray) -> np.ndarray:
    bits = ids.astype(np.uint64)
    digits = [(bits >> np.uint64(15 * k)) & np.uint64(0x7FFF) for k in range(HEADER)]
    digits[-1] = np.where(missing, NO_ID, digits[-1] & np.uint64(NO_ID - 1))
    return (np.stack(digits, axis=1) + np.uint64(RESERVED)).astype(DTYPE)


def number_of(header: list[int]) -> int | None:
    """The document number that a header stands for; None for a document without one."""
    digits = [d - RESERVED for d in header]
    if digits[-1] & NO_ID:
        return None
    value = sum(d << (15 * k) for k, d in enumerate(digits)) & ((1 << 64) - 1)
    return value - (1 << 64) if value >= 1 << 63 else value


def stream_chunks(model: bytes, end: int, chunk_tokens: int = CHUNK_TOKENS):
    """For ``mapInArrow`` over ``id, text``: a task's documents as chunks of one stream of identifiers.

    A document is its header, its identifiers (none for a null text) and the end identifier.
    """
    width = np.dtype(DTYPE).itemsize * chunk_tokens
    closing = np.array([end], DTYPE).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        held = bytearray()
        for batch in batches:
            ids, texts = batch.columns
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            headers = _header(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), missing)
            for start, stop in pieces(texts, BATCH_ROWS, BATCH_CHARS):
                part = [t or "" for t in texts[start:stop].to_pylist()]
                for header, found in zip(headers[start:stop], encoder.encode(part, num_threads=1), strict=True):
                    held += header.tobytes() + np.array(found, DTYPE).tobytes() + closing
                full = len(held) // width * width
                if full:
                    chunks = [bytes(held[at : at + width]) for at in range(0, full, width)]
                    del held[:full]
                    yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary())], names=["value"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], names=["value"])

    return run


def write_token_files(
    docs: DataFrame,
    folder: str,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_tokens: int = CHUNK_TOKENS,
    file_chunks: int = FILE_CHUNKS,
    compression: str = "gzip",
) -> tuple[int, int]:
    """Write the documents' identifiers as flat files; returns the end and the filler identifier.

    A file holds ``file_chunks`` chunks at most, and a document may go on in the next, so no document is too long.
    Spark's text writer puts the filler behind every chunk. ``compression`` is the storage's; what files hold
    is the flat run. Null ids are kept as such. End and filler must be pairs of ASCII bytes and must not be
    pieces: the model's end and begin marks.
    """
    import sentencepiece

    with open(model_path, "rb") as file:
        model = file.read()
    loaded = sentencepiece.SentencePieceProcessor(model_proto=model)
    end, filler = loaded.eos_id(), loaded.bos_id()
    if not (0 < end < 128 and 0 < filler < 128) or loaded.vocab_size() > RESERVED:
        raise ValueError("the vocabulary does not fit 16-bit files")
    bound_batches(docs.sparkSession)
    (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(stream_chunks(model, end, chunk_tokens), "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", np.array([filler], DTYPE).tobytes().decode())
        .option("compression", compression)
        .option("maxRecordsPerFile", file_chunks)
        .text(folder)
    )
    return end, filler


def read_blocks(spark: SparkSession, folder: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``file, block, data``: the streams of a folder cut into blocks of ``block_tokens`` identifiers or somewhat more.

    ``file`` is the stream's first file, and ``block`` rises along the stream, from 0 on.
    """
    width = np.dtype(DTYPE).itemsize * block_tokens
    name = F.col("_metadata.file_path")
    whole = spark.read.text(folder, wholetext=True).select(
        F.regexp_replace(name, r"-c\d+(\.[^/]*)$", "").alias("file"),
        F.regexp_extract(name, r"-c(\d+)\.[^/]*$", 1).cast("long").alias("part"),
        F.col("value").cast("binary").alias("data"),
    )
    # The last block of a file takes the rest, so that only the last of a stream can be short.
    number = F.greatest(F.lit(1).cast("long"), F.expr(f"octet_length(data) div {width}"))
    def block(k: Column) -> Column:
        length = F.when(k < number - 1, F.lit(width).cast("long")).otherwise(F.octet_length("data").cast("long"))
        return F.substring("data", (k * width + 1).cast("int"), length.cast("int"))

    blocks = F.transform(F.sequence(F.lit(0).cast("long"), number - 1), block)
    cut = whole.select("file", "part", F.posexplode(blocks).alias("k", "data"))
    return cut.select("file", (F.col("part") * (1 << 32) + F.col("k")).alias("block"), "data")


SCAN_SCHEMA = "file string, block long, n_tokens long, ends int, tail long, lengths array<long>, heads array<array<int>>, lead array<int>"


def scan_blocks(end: int, header: int = HEADER, filler: int | None = None):
    """A function for ``mapInArrow`` over ``file, block, data``: one small record for each block.

    ``lengths`` has an entry for each end identifier: the identifiers before it since the
    last one in the block. ``tail`` counts what follows the last. ``heads`` holds the first
    identifiers of the documents that begin in the block, as far as it goes; ``lead`` those of the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, block, data in zip(*(c for c in batch.columns), strict=True):
                ids = np.frombuffer(data.as_buffer(), DTYPE)
                if filler is not None:
                    ids = ids[ids != filler]
                at = np.flatnonzero(ids == end)
                begins = np.r_[np.empty(0, np.int64) if block.as_py() else 0, at + 1].astype(np.int64)
                rows.append(
                    {
                        "file": file.as_py(),
                        "block": block.as_py(),
                        "n_tokens": len(ids),
                        "ends": len(at),
                        "tail": len(ids) - (at[-1] + 1 if len(at) else 0),
                        "lengths": np.diff(np.r_[-1, at]) - 1,
                        "heads": [ids[b : b + header] for b in begins],
                        "lead": ids[:header],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=_SCAN)

    return run


_SCAN = pa.schema(
    [
        ("file", pa.string()),
        ("block", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ends", pa.int32()),
        ("tail", pa.int64()),
        ("lengths", pa.list_(pa.int64())),
        ("heads", pa.list_(pa.list_(pa.int32()))),
        ("lead", pa.list_(pa.int32())),
    ]
)


def count_documents(blocks: DataFrame, end: int, header: int = HEADER, filler: int | None = None) -> DataFrame:
    """``file, ordinal, head, n_tokens`` of every document, its header included in the count.

    All blocks of a ``file`` but the last have to hold more identifiers than a header. They are scanned in their order: a
    document's length is the part before its end identifier plus the tails of the blocks since the last end, and its head
    the one that is still open. What follows the last end identifier of a file is a document only if
    there is something. Identifiers equal to ``filler`` do not count.
    """
    scanned = blocks.mapInArrow(scan_blocks(end, header, filler), SCAN_SCHEMA)
    along = Window.partitionBy("file").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    no_heads = F.array().cast("array<array<int>>")
    # A head that the block's border cuts is completed by what the next block begins with.
    whole = F.transform(
        "heads", lambda h: F.slice(F.concat(h, F.coalesce("next_lead", F.array().cast("array<int>"))), 1, header)
    )
    stitched = (
        scanned.withColumns(
            {
                "segment": F.coalesce(F.sum((F.col("ends") > 0).cast("long")).over(before), F.lit(0)),
                "docs_before": F.coalesce(F.sum("ends").over(before), F.lit(0)),
                "next_lead": F.lead("lead").over(along),
                "last": F.lead("block").over(along).isNull(),
            }
        )
        .withColumn("whole", whole)
        .withColumn("open", F.last(F.when(F.size("whole") > 0, F.element_at("whole", -1)), ignorenulls=True).over(before))
        # A segment is a run of blocks up to one with an end; the tail of the end before it comes along.
        .withColumn("own_tail", F.when(F.col("ends") == 0, F.col("tail")).otherwise(F.lit(0)))
        .withColumn("carried", F.coalesce(F.sum("own_tail").over(within), F.lit(0)))
        .withColumn("prior", F.max(F.when(F.col("ends") > 0, F.struct("block", "tail"))).over(before))
        .withColumn("carry", F.col("carried") + F.coalesce(F.col("prior.tail"), F.lit(0)))
    )
    unclosed = F.when(F.col("last") & (F.col("tail") + F.when(F.col("ends") == 0, F.col("carry")).otherwise(F.lit(0)) > 0),
        F.array(F.when(F.col("ends") == 0, F.col("carry") + F.col("tail")).otherwise(F.col("tail")))
    ).otherwise(F.array().cast("array<bigint>"))
    lengths = F.transform("lengths", lambda n, i: n + F.when(i == 0, F.col("carry")).otherwise(F.lit(0)))
    # The documents that end in a block: the one that is open where it begins, and those that begin in it.
    heads = F.concat(F.when(F.col("open").isNull(), no_heads).otherwise(F.array("open")), F.col("whole"))
    ending = stitched.select("file", "docs_before", heads.alias("heads"), F.posexplode(F.concat(lengths, unclosed)).alias("i", "n_tokens"))
    return ending.select("file", (F.col("docs_before") + F.col("i")).alias("ordinal"), F.get("heads", F.col("i")).alias("head"), "n_tokens")


def numbered_counts(counted: DataFrame) -> DataFrame:
    """``doc_id, n_tokens`` from documents with a header, which the count leaves out."""
    digits = [F.get("head", k).cast("long") - RESERVED for k in range(HEADER)]
    value = digits[0]
    for k in range(1, HEADER - 1):
        value = value.bitwiseOR(F.shiftleft(digits[k], 15 * k))
    value = value.bitwiseOR(F.shiftleft(digits[-1], 15 * (HEADER - 1)))
    missing = digits[-1].bitwiseAND(F.lit(NO_ID)) != 0
    return counted.select(F.when(~missing, value).alias("doc_id"), (F.col("n_tokens") - HEADER).alias("n_tokens"))
