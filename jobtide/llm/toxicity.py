"""Toxicity from class-conditional Kneser-Ney models of the characters in words.

Each class has interpolated Kneser-Ney counts of symbol 5-grams within words. Below the highest order
both share one hierarchy of continuation counts, so an expression that is rare in a
class falls back to what all labelled text says, and where neither class
knows a 5-gram only their back-off masses differ. A word's evidence is the difference of its
two log-likelihoods. A document has the mean over its words (the length-normalised difference) and
its strongest words; a logistic function of these, fitted on texts that its models have not seen, is the score.

The 5-grams of all labelled texts are counted by Spark; the driver gets their sums. Only the logistic function is fitted
on a bounded sample, of which it sees five numbers for each text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.batches import bound_batches, segments
from jobtide.llm.wordscan import is_space, range_hashes, spans
from jobtide.llm.workspace import Workspace

#: Texts of a class that calibrate the score, about: the same bound at every size of the input.
MAX_TRAIN = 4000
#: Labels up to this number go to the documents as a broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
ORDER = 5
#: A 5-gram is a number of 30 bits, which bounds what the models can hold.
SYMBOL_BITS = 6
#: Symbols: 0 before a word, letters by rank, other letters, all else, the end of a word.
LETTERS, OTHER_LETTER, NO_LETTER, END = 60, 61, 62, 63
WORD_LIMIT = 8.0
STRONGEST = 3
#: Parts of the sample; each is weighed by models of all other labelled texts when the score is calibrated.
FOLDS = 5
THRESHOLD = 0.3
#: Characters that a step takes up; a longer text is cut between words.
STEP_CHARS = 1 << 20
#: Distinct counts that a task holds before it passes them on.
HELD_COUNTS = 1 << 20
_SPACE = re.compile(r"[\x20\x09-\x0D]")


@dataclass
class ToxicityModel:
    symbols: np.ndarray  # symbol of every code point
    grams: np.ndarray  # sorted 5-grams that some class has seen
    gram_evidence: np.ndarray
    contexts: np.ndarray  # sorted 4-grams before them
    context_evidence: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    bias: float


def letter_table(numbers: dict[int, int]) -> np.ndarray:
    """The symbol of every code point, from how often the code points of lower-case letters occur."""
    ranked = sorted(numbers, key=lambda c: (-numbers[c], c))
    rank = {chr(c): i + 1 for i, c in enumerate(ranked[:LETTERS])}
    table = np.full(0x110000, NO_LETTER, np.uint8)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = rank.get(char.lower()[0], OTHER_LETTER)
    return table


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _words(part: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a segment, and start, length and row of every word."""
    points = _code_points("".join(t for _, t in part))
    offsets = np.r_[0, np.cumsum([len(t) for _, t in part])]
    start, end = spans(~is_space(points), offsets)
    row = np.array([r for r, _ in part], np.int64)[np.searchsorted(offsets, start, "right") - 1]
    return points, start, end - start, row


def _distinct(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of every distinct word, and each word's number among them."""
    _, first, which = np.unique(range_hashes(points, start, start + length), return_index=True, return_inverse=True)
    return first, which


def _grams(points: np.ndarray, start: np.ndarray, length: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram codes of words, end included, and where each word's codes start."""
    size = length + 1
    begin = np.cumsum(size) - size
    where = np.arange(size.sum()) - np.repeat(begin, size)
    at = np.minimum(np.repeat(start, size) + where, len(points) - 1)
    symbol = np.where(where == np.repeat(length, size), END, symbols[points[at]]).astype(np.int64)
    code = symbol.copy()
    for back in range(1, ORDER):
        earlier = np.zeros_like(symbol)
        earlier[back:] = symbol[:-back]
        code |= np.where(where >= back, earlier, 0) << (SYMBOL_BITS * back)
    return code, begin


def _totals(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(which, weights=values, minlength=len(distinct))


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    """Values by sorted key, and another one for what is not there."""
    if not len(keys):
        return np.full(len(wanted), missing)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], missing)


def _discount(counts: np.ndarray) -> float:
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.9))


def _shared(grams: np.ndarray, wanted: np.ndarray, order: int) -> np.ndarray:
    """Kneser-Ney probability of the last symbol of ``wanted`` codes of ``order`` symbols.

    ``grams`` are the distinct codes of the next higher order: each counts once for its last symbols.
    """
    keys, counts = _totals(grams & ((1 << SYMBOL_BITS * order) - 1), np.ones(len(grams)))
    if order == 1:
        p = (_at(keys, counts, wanted, 0.0) + 0.5) / (counts.sum() + 0.5 * (1 << SYMBOL_BITS))
        return p
    discount = _discount(counts)
    heads, total = _totals(keys >> SYMBOL_BITS, counts)
    _, kinds = _totals(keys >> SYMBOL_BITS, np.ones(len(keys)))
    head = wanted >> SYMBOL_BITS
    below = _shared(keys, wanted & ((1 << SYMBOL_BITS * (order - 1)) - 1), order - 1)
    all_ = _at(heads, total, head, 0.0)
    some = np.maximum(all_, 1)
    p = np.maximum(_at(keys, counts, wanted, 0.0) - discount, 0) / some
    return np.where(all_ > 0, p + discount * _at(heads, kinds, head, 0.0) / some * below, below)


def language_models(counted: list[tuple[np.ndarray, np.ndarray]]):
    """Sorted 5-grams and contexts, with the toxic less the ordinary log-probability.

    ``counted`` has the sorted 5-grams of either class and how often they occur.
    """
    grams = np.union1d(counted[0][0], counted[1][0])
    contexts = np.unique(grams >> SYMBOL_BITS)
    below = _shared(grams, grams & ((1 << SYMBOL_BITS * (ORDER - 1)) - 1), ORDER - 1)
    log_p, log_mass = [], []
    for keys, counts in counted:
        discount = _discount(counts)
        heads, total = _totals(keys >> SYMBOL_BITS, counts)
        _, kinds = _totals(keys >> SYMBOL_BITS, np.ones(len(keys)))
        all_, kind = _at(heads, total, contexts, 0.0), _at(heads, kinds, contexts, 0.0)
        mass = np.where(all_ > 0, discount * kind / np.maximum(all_, 1), 1.0)
        log_mass.append(np.log(mass))
        own = np.searchsorted(contexts, grams >> SYMBOL_BITS)
        seen = np.maximum(_at(keys, counts, grams, 0.0) - discount, 0) / np.maximum(all_[own], 1)
        log_p.append(np.log(seen + mass[own] * below))
    return grams, log_p[1] - log_p[0], contexts, log_mass[1] - log_mass[0]


def _evidence(points, start, length, model: ToxicityModel) -> np.ndarray:
    """Evidence of every word, worked out once for each distinct one."""
    first, which = _distinct(points, start, length)
    code, begin = _grams(points, start[first], length[first], model.symbols)
    known = _at(model.grams, model.gram_evidence, code, np.nan)
    fallen = np.isnan(known)
    known[fallen] = _at(model.contexts, model.context_evidence, code[fallen] >> SYMBOL_BITS, 0.0)
    return np.clip(np.add.reduceat(known, begin), -WORD_LIMIT, WORD_LIMIT)[which]


def features(texts: list[str], model: ToxicityModel) -> np.ndarray:
    """Mean evidence of the words, the strongest ones, and the log of their number, for each text."""
    number, total = np.zeros(len(texts)), np.zeros(len(texts))
    top = np.full((len(texts), STRONGEST), -np.inf)
    for part in segments(texts, STEP_CHARS, _SPACE):
        points, start, length, row = _words(part)
        if not len(start):
            continue
        evidence = _evidence(points, start, length, model)
        number += np.bincount(row, minlength=len(texts))
        total += np.bincount(row, weights=evidence, minlength=len(texts))
        # Words by row, the strongest first: a row's first few and those found before are held against each other.
        order = np.lexsort((-evidence, row))
        ranked = row[order]
        nth = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        some = nth < STRONGEST
        found = np.full((len(texts), STRONGEST), -np.inf)
        found[ranked[some], nth[some]] = evidence[order[some]]
        top = -np.sort(-np.c_[top, found], axis=1)[:, :STRONGEST]
    return np.c_[total / np.maximum(number, 1), np.maximum(top, 0), np.log1p(number)]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a penalised logistic regression, the intercept last, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    keep = np.eye(x.shape[1]) * penalty
    keep[-1, -1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + keep @ beta
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + keep, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_train: int) -> tuple[DataFrame, dict]:
    """``t, y, part`` of all labelled documents, and how many ids have each label.

    Part 0 is not in the sample; the others are its folds. A hash of the id decides, so reruns agree.
    """
    known = labels.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sampled = F.lit(False)
    for y, n in sizes.items():
        bound = int(min(1.0, max_train / n) * 2**53)
        sampled = sampled | ((F.col("y") == y) & (F.shiftrightunsigned("h", 11) < bound))
    fold = F.pmod(F.shiftright("h", 5), F.lit(FOLDS)) + 1
    parts = known.select("id", "y", F.when(sampled, fold).otherwise(F.lit(0)).cast("int").alias("part"))
    if sum(sizes.values()) <= BROADCAST_LABELS:
        parts = F.broadcast(parts)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return texts.join(parts, "id").select("t", "y", "part"), sizes


def _letter_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over ``t``: how often each lower-case letter occurs, batch by batch."""
    for batch in batches:
        codes, numbers = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for part in segments([t or "" for t in batch.column(0).to_pylist()], STEP_CHARS, _SPACE):
            code, n = np.unique(_code_points("".join(t for _, t in part).lower()), return_counts=True)
            letter = np.array([chr(c).isalpha() for c in code], bool)
            codes.append(code[letter])
            numbers.append(n[letter])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(codes).astype(np.int32)), pa.array(np.concatenate(numbers))], names=["code", "n"]
        )


def count_grams(symbols: np.ndarray):
    """For ``mapInArrow`` over ``t, y, part``: ``slot, code, n``, where a slot is a part's class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = SYMBOL_BITS * ORDER
        keys, counts = np.empty(0, np.int64), np.empty(0)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array((keys >> bits).astype(np.int32)), pa.array(keys & ((1 << bits) - 1)), pa.array(counts.astype(np.int64))],
                names=["slot", "code", "n"],
            )

        for batch in batches:
            slot = batch.column(2).to_numpy() * 2 + batch.column(1).to_numpy()
            for part in segments([t or "" for t in batch.column(0).to_pylist()], STEP_CHARS, _SPACE):
                points, start, length, row = _words(part)
                if not len(start):
                    continue
                first, which = _distinct(points, start, length)
                code, begin = _grams(points, start[first], length[first], symbols)
                size = np.diff(np.r_[begin, len(code)])
                for s in np.unique(slot[row]):
                    number = np.bincount(which[slot[row] == s], minlength=len(first))
                    some = np.repeat(number > 0, size)
                    keys, counts = _totals(
                        np.r_[keys, code[some] | (int(s) << bits)], np.r_[counts, np.repeat(number, size)[some]]
                    )
                if len(keys) >= HELD_COUNTS:
                    yield rows()
                    keys, counts = keys[:0], counts[:0]
        yield rows()

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_train: int = MAX_TRAIN,
) -> ToxicityModel | None:
    """Language models of all labelled documents, calibrated on a sample of them; None without both labels.

    Labels other than 0 and 1 are left out, an id with both counts as toxic, ids without a
    document do not matter. Texts of any length take part. The labels' shares weigh the calibration, to which
    about ``max_train`` texts of each label are enough.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    space = Workspace(spark)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    rows, sizes = _labelled(docs, known, id_col, text_col, max_train)
    rows = space.save(rows, "labelled")
    letters = rows.select("t").mapInArrow(_letter_numbers, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    symbols = letter_table({r.code: r.n for r in letters.collect()})
    counts = rows.mapInArrow(count_grams(symbols), "slot int, code long, n long").groupBy("slot", "code")
    table = counts.agg(F.sum("n").alias("n")).toArrow()
    slot, code, n = (table.column(c).to_numpy() for c in ("slot", "code", "n"))
    order = np.argsort(code, kind="stable")
    slot, code, n = slot[order], code[order], n[order].astype(np.float64)

    def models(without: int) -> ToxicityModel | None:
        """Of all parts but one."""
        own = slot // 2 != without
        counted = [_totals(code[own & (slot % 2 == y)], n[own & (slot % 2 == y)]) for y in (0, 1)]
        if not all(len(keys) for keys, _ in counted):
            return None
        return ToxicityModel(symbols, *language_models(counted), np.empty(0), np.empty(0), np.empty(0), 0.0)

    whole = models(-1)
    if whole is None:
        return None
    others = [models(k) or whole for k in range(1, FOLDS + 1)]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, part = [t or "" for t in batch.column(0).to_pylist()], batch.column(2).to_numpy()
            x = np.zeros((len(texts), STRONGEST + 2))
            for k in np.unique(part):
                own = np.flatnonzero(part == k)
                x[own] = features([texts[i] for i in own], others[k - 1])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    found = rows.where("part > 0").mapInArrow(weigh, "y int, x array<double>").collect()
    found.sort(key=lambda r: (r.y, r.x))
    labels, x = np.array([r.y for r in found]), np.array([r.x for r in found])
    if len(set(labels.tolist())) < 2:
        return None
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    share = np.array([sizes[y] / (labels == y).sum() for y in (0, 1)])
    weight = share[labels] * len(x) / share[labels].sum()
    beta = _logistic((x - centre) / scale, labels, weight)
    whole.weights, whole.centre, whole.scale, whole.bias = beta[:-1], centre, scale, float(beta[-1])
    return whole


def score(text: Column, model: ToxicityModel | None) -> Column:
    """Score of a text column between 0 and 1: null and empty texts get that of a text without evidence, all 0 without a model."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            scores = np.zeros(len(texts))
            if model is not None and len(texts):
                x = (features([t or "" for t in texts.to_pylist()], model) - model.centre) / model.scale
                scores = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30)))
            yield pa.array(scores)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text)


def with_toxicity(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text") -> DataFrame:
    """All rows and columns, with ``score`` and ``predicted``; only the text is looked at."""
    bound_batches(docs.sparkSession)
    found = docs.withColumn("score", score(F.col(text_col), model))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
