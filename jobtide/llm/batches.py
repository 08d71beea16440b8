"""Arrow batches of texts for functions in Python workers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of one Arrow batch; a single longer text is a batch of its own.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound batches that go to Python by bytes as well, unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("bB") or 0) >= 2**31 - 1:
        spark.conf.set(key, str(BATCH_BYTES))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in a row, and ``n + 1`` offsets; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    joined = "".join(texts.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.r_[0, np.cumsum(lengths, dtype=np.int64)]


def segments(texts: list[str], limit: int, border: re.Pattern) -> Iterator[list[tuple[int, str]]]:
    """Lists of (row, part of its text), about ``limit`` characters each; texts are cut at a border only."""
    held, size = [], 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > limit:
                found = border.search(text, at + limit)
                stop = found.start() if found else stop
            held.append((row, text[at:stop]))
            size, at = size + stop - at, stop
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def pieces(texts: pa.Array, max_rows: int, max_chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``max_rows`` texts and ``max_chars`` characters, or one text."""
    lengths = pc.fill_null(pc.utf8_length(texts.cast(pa.string())), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        seen = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, seen + max_chars, "right"))
        stop = min(max(stop, start + 1), start + max_rows)
        yield start, stop
        start = stop
