"""Quality rules on repetition: characters inside duplicated word n-grams and lines.

Rolling hashes of words give the hashes of all word n-grams of several lengths and of
all lines, for a batch of whole texts at once. A word is covered at a length if some n-gram over it
occurs twice or more in its text; the characters of covered words, as a share of all word
characters, are held against a limit for each length.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.batches import bound_batches, code_points, pieces
from jobtide.llm.wordscan import is_space, mixed, range_hashes, spans

#: Greatest share of word characters inside duplicated n-grams of each length, and inside lines that repeat an earlier one.
MAX_COVERED = {5: 0.15, 7: 0.13, 10: 0.10}
MAX_LINE_SHARE = 0.20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
BATCH_ROWS = 2048
BATCH_CHARS = 2 << 20

_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys have occurred before."""
    _, first = np.unique(keys, return_index=True)
    out = np.ones(len(keys), bool)
    out[first] = False
    return out


def _covered(word_hash: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Words inside n-grams that occur twice or more in their text."""
    number = len(word_hash) - n + 1
    out = np.zeros(len(word_hash), bool)
    if number < 1:
        return out
    at = np.flatnonzero(owner[:number] == owner[n - 1 :])
    if not len(at):
        return out
    hashes = range_hashes(word_hash, at, at + n) ^ mixed(owner[at])
    twice = at[_again(hashes)]
    steps = np.zeros(len(word_hash) + 1, np.int32)
    steps[twice] += 1
    steps[twice + n] -= 1
    return np.cumsum(steps[:-1]) > 0


def measures(texts: pa.Array, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of each text, and ``covered_<n>`` and ``dup_line_chars`` in characters of words."""
    points, offsets = code_points(texts)
    rows = len(texts)
    out = {name: np.zeros(rows, np.int64) for name in (*_LONGS, "dup_line_chars", *(f"covered_{n}" for n in lengths))}
    if not len(points):
        return out
    owner_of = lambda at: np.searchsorted(offsets, at, "right") - 1
    total = lambda owner, weights=None: np.bincount(owner, weights, rows).astype(np.int64)
    symbol = np.zeros(128, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    out["n_symbols"] = total(owner_of(np.flatnonzero((points < 128) & symbol[np.minimum(points, 127)])))
    space = is_space(points)
    start, end = spans(~space, offsets)
    owner, chars = owner_of(start), end - start
    out["n_words"], out["word_chars"] = total(owner), total(owner, chars)
    hashes = range_hashes(points, start, end)
    repeated = _covered(hashes, owner, WINDOW)
    out["n_repeat_words"] = total(owner[repeated])
    for n in lengths:
        inside = _covered(hashes, owner, n)
        out[f"covered_{n}"] = total(owner[inside], chars[inside])
    line_start, line_end = spans(points != 0x0A, offsets)
    ahead = np.r_[0, np.cumsum(chars)]
    first, last = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    wordy = last > first
    line_start, line_end, first, last = line_start[wordy], line_end[wordy], first[wordy], last[wordy]
    line_owner = owner_of(line_start)
    later = _later(range_hashes(points, line_start, line_end) ^ mixed(line_owner))
    out["n_dup_lines"] = total(line_owner[later])
    out["dup_line_chars"] = total(line_owner[later], (ahead[last] - ahead[first])[later])
    return out


def rate(
    text: Column, max_covered: Mapping[int, float] = MAX_COVERED, max_line_share: float = MAX_LINE_SHARE
) -> Column:
    """A struct of the counts, shares and verdicts of a text column.

    A null or empty text has no words and fails the base rule. ``kept`` is false where the base rule fails or a
    share is above its limit.
    """
    lengths = tuple(sorted(max_covered))
    shares = [f"covered_{n}" for n in lengths]
    fields = [*_LONGS, *shares, "dup_line_share", "base_failed", "kept"]
    schema = ", ".join(
        f"{f} {'long' if f in _LONGS else 'double' if f in (*shares, 'dup_line_share') else 'boolean'}" for f in fields
    )

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [measures(texts[a:b], lengths) for a, b in pieces(texts, BATCH_ROWS, BATCH_CHARS)]
            found = measures(texts[:0], lengths) if not parts else {
                k: np.concatenate([p[k] for p in parts]) for k in parts[0]
            }
            all_ = np.maximum(found["word_chars"], 1)
            found["dup_line_share"] = found.pop("dup_line_chars") / all_
            bad = found["dup_line_share"] > max_line_share
            for n in lengths:
                found[f"covered_{n}"] = found[f"covered_{n}"] / all_
                bad |= found[f"covered_{n}"] > max_covered[n]
            found["base_failed"] = (found["n_words"] < MIN_WORDS) | (
                100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"]
            )
            found["kept"] = ~(found["base_failed"] | bad)
            yield pa.StructArray.from_arrays([pa.array(found[f]) for f in fields], names=fields)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema)(text)


def with_repetition(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """All rows and columns, with a struct ``repetition`` in place of any of that name."""
    bound_batches(docs.sparkSession)
    return docs.withColumn("repetition", rate(F.col(text_col), **limits))
