"""Audit of how text filters interact, by truth-table survival words.

Five filters have 32 subsets. A document becomes a 32-bit word whose bit ``s`` is set if it survives all filters of
subset ``s``: the words of the filters that it passes and fails, combined. Carry-save adders count all
positions of many words at once, which gives the survivors of every subset, for each part of the
table and each label. All figures for any order of the filters follow from these counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.batches import bound_batches
from jobtide.llm.text import whole, words
from jobtide.llm.workspace import Workspace

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SYMBOLS = "[#$%&*|]"
#: Filters on the text alone, and the one on earlier copies of it.
TEXT_FILTERS, COPY_FILTER = "ABCD", "E"
FILTERS = TEXT_FILTERS + COPY_FILTER
SUBSETS = 1 << len(FILTERS)
LABELS = ("every", "good", "toxic")
#: Parts of which a task holds counters at once.
HELD_PARTS = 4096


def text_failures(text: Column, w: Column) -> dict[str, Column]:
    """Whether a text, with the words ``w``, fails each filter on texts."""
    return {
        "A": F.size(w) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * F.size(w),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS_PERCENT * F.char_length(text),
        "D": text.rlike(SYMBOLS),
    }


def subsets_with(filter_number: int) -> int:
    """The word of all subsets that hold a filter."""
    return sum(1 << s for s in range(SUBSETS) if s >> filter_number & 1)


def survival_word(fails: list[Column]) -> Column:
    """The 32-bit word of the subsets that a document survives, as a long."""
    every = (1 << SUBSETS) - 1
    word = F.lit(every).cast("long")
    for number, failed in enumerate(fails):
        word = word.bitwiseAND(F.when(failed, F.lit(every & ~subsets_with(number))).otherwise(F.lit(every)).cast("long"))
    return word


class PositionCounts:
    """Counts of set bits by position. Level ``j`` holds at most two words, each worth ``2**j``."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, new: np.ndarray, level: int = 0) -> None:
        """Add words worth ``2**level``: three of a level become one there and one above."""
        while len(new):
            while len(self.levels) <= level:
                self.levels.append(np.empty(0, np.uint32))
            held, carried = np.r_[self.levels[level], new], []
            while len(held) > 2:
                n = len(held) // 3
                a, b, c = held[:n], held[n : 2 * n], held[2 * n : 3 * n]
                odd = a ^ b
                carried.append((a & b) | (odd & c))
                held = np.r_[odd ^ c, held[3 * n :]]
            self.levels[level] = held
            new, level = np.concatenate([np.empty(0, np.uint32), *carried]), level + 1

    def add_times(self, new: np.ndarray, times: np.ndarray) -> None:
        """Add words that stand for several documents, by the binary digits of their number."""
        level = 0
        while (times > 0).any():
            self.add(new[times & 1 == 1], level)
            times, level = times >> 1, level + 1

    def totals(self) -> np.ndarray:
        out = np.zeros(SUBSETS, np.int64)
        for level, held in enumerate(self.levels):
            bits = (held[:, None] >> np.arange(SUBSETS, dtype=np.uint32)) & np.uint32(1)
            out += bits.sum(axis=0, dtype=np.int64) << level
        return out


COUNT_SCHEMA = "part string, " + ", ".join(f"{name} array<long>" for name in LABELS)


def count_survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over ``part, word, good, toxic, n``: survivors of every subset, by part and label.

    A part may come out several times; its rows are to be added up.
    """
    held: dict[str, list[PositionCounts]] = {}

    def rows() -> pa.RecordBatch:
        lists = [pa.array([c[k].totals() for c in held.values()], pa.list_(pa.int64())) for k in range(len(LABELS))]
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), *lists], names=["part", *LABELS])

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        which = parts.indices.to_numpy(zero_copy_only=False)
        word, good, toxic, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
        order = np.argsort(which, kind="stable")
        borders = np.searchsorted(which[order], np.arange(len(parts.dictionary) + 1))
        for k, name in enumerate(parts.dictionary.to_pylist()):
            own = order[borders[k] : borders[k + 1]]
            counts = held.setdefault(name, [PositionCounts() for _ in LABELS])
            for count, labelled in zip(counts, (own, own[good[own]], own[toxic[own]]), strict=True):
                count.add_times(word[labelled].astype(np.uint32), n[labelled])
            if len(held) >= HELD_PARTS:
                yield rows()
                held.clear()
    if held:
        yield rows()


def survivors(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """``part, every, good, toxic``: for each part, how many documents survive each of the 32 subsets.

    Bit ``f`` of a subset's number stands for the ``f``-th letter of ``FILTERS``. Null texts are empty. Of documents
    with one text, those of the smallest id pass ``E``; a null id is larger than all. Rows are
    documents, repeated ones too, and a null part counts as the empty string. Several labels of one id: a 1 counts.
    Rows without id have no label. Texts meet as digests, and only the smallest id of each is looked for, with the
    id as part of the key: neither many copies nor one hot part meet in one task.
    """
    space = Workspace(docs.sparkSession)
    read = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), whole(text_col).alias("t")
    ).select("id", "part", "t", words(F.col("t")).alias("w"))
    failed = text_failures(F.col("t"), F.col("w"))
    marks = read.select(
        "id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), *(failed[f].alias(f"fails_{f}") for f in TEXT_FILTERS)
    )
    known = space.save(marks.groupBy(*marks.columns).agg(F.count("*").alias("n")), "marks")
    firsts = known.groupBy("digest").agg(F.min("id").alias("first_id"))
    judged = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    labelled = known.where("id is not null").join(judged, F.col("id") == F.col("label_id"), "left").drop("label_id")
    unknown = known.where("id is null").withColumns({"good": F.lit(None).cast("boolean"), "toxic": F.lit(None).cast("boolean")})
    rows = labelled.unionByName(unknown)
    firsts = firsts.withColumnRenamed("digest", "first_digest").withColumn("first", F.lit(True))
    same = (rows.digest == firsts.first_digest) & rows.id.eqNullSafe(firsts.first_id)
    marked = rows.join(firsts, same, "left").withColumn(f"fails_{COPY_FILTER}", F.col("first").isNull())
    counted = marked.select(
        "part",
        survival_word([F.col(f"fails_{f}") for f in FILTERS]).alias("word"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
        "n",
    )
    bound_batches(docs.sparkSession)
    summed = [
        F.array(*(F.sum(F.get(name, F.lit(s))) for s in range(SUBSETS))).alias(name) for name in LABELS
    ]
    return counted.mapInArrow(count_survivors, COUNT_SCHEMA).groupBy("part").agg(*summed)


def _steps() -> list[tuple[str, int, int, int]]:
    """Order, step, subset before the step and number of its filter, for all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            number = FILTERS.index(letter)
            out.append(("".join(order), step, before, number))
            before |= 1 << number
    return out


def order_report(counts: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and what the step's filter does there, from ``survivors``.

    ``kept, removed, redundant, unique_fails, good_lost, toxic_lost`` count documents of the part; ``shapley`` is what the
    filter removes, added up over all orders.
    """
    steps = _steps()
    all_ = SUBSETS - 1

    def fixed(values: list, kind: str) -> Column:
        return F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>")

    shapley = []
    for number in range(len(FILTERS)):
        total = F.lit(0).cast("long")
        for s in (s for s in range(SUBSETS) if not s >> number & 1):
            size = s.bit_count()
            orders = factorial(size) * factorial(len(FILTERS) - 1 - size)
            total = total + orders * (F.get("every", F.lit(s)) - F.get("every", F.lit(s | 1 << number)))
        shapley.append(total)
    rows = counts.select("part", *LABELS, F.array(*shapley).alias("shapleys")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("i")
    )
    rows = rows.select(
        "part",
        *LABELS,
        "shapleys",
        F.get(fixed([s[0] for s in steps], "string"), F.col("i")).alias("filter_order"),
        F.get(fixed([s[1] for s in steps], "int"), F.col("i")).alias("step"),
        F.get(fixed([s[2] for s in steps], "int"), F.col("i")).alias("before"),
        F.get(fixed([s[3] for s in steps], "int"), F.col("i")).alias("number"),
    )
    bit = F.get(fixed([1 << k for k in range(len(FILTERS))], "int"), F.col("number"))
    rows = rows.withColumn("bit", bit).withColumn("now", F.col("before").bitwiseOR(F.col("bit")))
    gone = {name: F.get(name, F.col("before")) - F.get(name, F.col("now")) for name in LABELS}
    fails = F.get("every", F.lit(0)) - F.get("every", F.col("bit"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("every", F.col("now")).alias("kept"),
        gone["every"].alias("removed"),
        (fails - gone["every"]).alias("redundant"),
        (F.get("every", F.lit(all_) - F.col("bit")) - F.get("every", F.lit(all_))).alias("unique_fails"),
        gone["good"].alias("good_lost"),
        gone["toxic"].alias("toxic_lost"),
        F.get("shapleys", F.col("number")).alias("shapley"),
    )
