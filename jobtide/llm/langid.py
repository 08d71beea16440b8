"""Language identification with string kernels.

A text is the set of its n-grams of several orders, of lower-case letters of any script and one symbol for all
else. An n-gram's hash is its place in the set, so no alphabet has to be learned.
The kernel of two texts is the number of n-grams both have, divided by the
geometric mean of their own numbers. Nyström landmarks, a few training texts, make it a finite
feature map; one ridge regression for each language on top gives the scores, all
as products of whole batches with the landmark and coefficient matrices. The regression is solved from sums over
all labelled texts, which Spark adds up; only these and the landmarks reach the driver.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.batches import bound_batches, pieces
from jobtide.llm.workspace import Workspace

UNDETERMINED = "und"
#: What all texts weigh in the regression, shared out over the languages, the least share of a language that
#: has so many texts, and landmarks. Every labelled text takes part; the weights say how much.
MAX_TRAIN = 2000
MIN_TRAIN = 8
LANDMARKS = 192
#: An n-gram is known to a language if more than one and more than this part of its texts have it.
KNOWN_PART = 0.004
#: A text fits while the known share of its n-grams is at least this part of what all but a few labelled
#: texts reach, each judged by the others; with fewer texts than the least number a language is not judged.
FIT_PART = 0.75
FIT_QUANTILE = 0.05
MIN_JUDGED = 40
#: Whole numbers that sums over texts are kept in: of products of two kernels, of kernels, and of known shares.
PRODUCT_UNIT = 1 << 22
SUM_UNIT = 1 << 40
SHARE_UNIT = 1 << 16
#: Places of n-grams that a task holds before it counts them, and counts before it hands them on.
HELD_PLACES = 1 << 20
RIDGE = 1e-3
ORDERS = 3
#: Places of n-grams. A text has some hundred to some ten thousand, so few share a place.
HASH_BITS = 18
N_GRAMS = 1 << HASH_BITS
#: Odd multipliers of the hash, by order and distance from the end.
_FACTORS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 8)]
BATCH_ROWS = 64
BATCH_CHARS = 1 << 20


@dataclass
class StringKernelModel:
    """What scoring needs: bounded by the landmarks and the places, not by the input."""

    languages: list[str]
    symbols: np.ndarray  # lower-case letter of every code point, 0 for what is no letter
    vocabulary: np.ndarray  # n-grams of the landmarks
    landmarks: np.ndarray  # vocabulary x landmarks, 0 or 1
    norms: np.ndarray  # root of each landmark's number of n-grams
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    known: np.ndarray  # languages x n-grams that enough of its texts have, as bits
    floors: np.ndarray  # least known share of a text's n-grams, by language


@lru_cache
def symbol_table() -> np.ndarray:
    """The lower-case letter that stands for every code point, 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = ord(unicodedata.normalize("NFC", char.lower())[0])
    return table


def presence(texts: list[str], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams each text has, texts x N_GRAMS, 0 or 1; and which texts have a letter.

    Texts are padded with a non-letter at both ends and cut into overlapping pieces, so one very long
    text takes no more working memory than a batch.
    """
    seen, lettered = np.zeros((len(texts), N_GRAMS), np.uint8), np.zeros(len(texts), bool)
    held, chars = [], 0

    def mark(parts: list[tuple[int, str]]) -> None:
        joined = "".join(p for _, p in parts)
        code = symbols[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        row = np.repeat([r for r, _ in parts], [len(p) for _, p in parts])
        part = np.repeat(np.arange(len(parts)), [len(p) for _, p in parts])
        lettered[row[code > 0]] = True
        mixed = (code + np.uint64(1)) * np.uint64(_FACTORS[0])
        mixed ^= mixed >> np.uint64(31)
        gram = np.zeros_like(code)
        flat = seen.reshape(-1)
        for n in range(1, ORDERS + 1):
            gram = (gram[: len(code) - n + 1] + np.uint64(n)) * np.uint64(_FACTORS[1]) + mixed[n - 1 :]
            place = (gram * np.uint64(_FACTORS[2]) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
            inside = part[: len(gram)] == part[n - 1 :]
            flat[(row[: len(gram)].astype(np.int64) * N_GRAMS + place)[inside]] = 1

    for r, text in enumerate(texts):
        padded = f" {text} "
        for at in range(0, len(padded), BATCH_CHARS):
            part = padded[at : at + BATCH_CHARS + ORDERS - 1]
            held.append((r, part))
            chars += len(part)
            if chars >= BATCH_CHARS:
                mark(held)
                held, chars = [], 0
    if held:
        mark(held)
    return seen, lettered


def quotas(sizes: dict[str, int], total: int, least: int = MIN_TRAIN) -> dict[str, int]:
    """Equal shares of ``total``; what a small language leaves goes to the larger ones."""
    out: dict[str, int] = {}
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(least, (total - sum(out.values())) // (len(sizes) - k)))
    return out


def _gram_set(text: Column, symbols: np.ndarray) -> Column:
    """The n-grams of a text as bits, compressed: bounded by their places, not by the text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for start, stop in pieces(texts, BATCH_ROWS, BATCH_CHARS):
                seen, _ = presence([t or "" for t in texts[start:stop].to_pylist()], symbols)
                out += [zlib.compress(bits.tobytes(), 1) for bits in np.packbits(seen, axis=1)]
            yield pa.array(out, pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(text)


def _seen(sets: list[bytes]) -> np.ndarray:
    """As ``presence``, from compressed sets."""
    bits = np.stack([np.frombuffer(zlib.decompress(x), np.uint8) for x in sets])
    return np.unpackbits(bits, axis=1, count=N_GRAMS)


def _known_share(seen: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Part of each text's n-grams that ``known`` has, a row of bits for each text."""
    bits = np.packbits(seen, axis=1)
    both = np.bitwise_count((bits & known).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return both / np.maximum(np.bitwise_count(bits.view(np.uint64)).sum(axis=1, dtype=np.int64), 1)


def fitting(seen: np.ndarray, values: np.ndarray, model: StringKernelModel) -> np.ndarray:
    """Whether texts fit their best language: by the share of their n-grams that it or the second best knows.

    The share does not depend on the other languages, unlike the scores, which sum to 1. The second is there
    for texts in two languages.
    """
    first = values.argmax(axis=1)
    rest = values.copy()
    rest[np.arange(len(values)), first] = -np.inf
    return _known_share(seen, model.known[first] | model.known[rest.argmax(axis=1)]) >= model.floors[first]


def _marked(batches: Iterator[pa.RecordBatch], model: StringKernelModel) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of batches of ``l, t`` the numbers of the languages and the ``presence`` of the texts, part by part."""
    number = {lang: k for k, lang in enumerate(model.languages)}
    for batch in batches:
        own = np.array([number[lang] for lang in batch.column(0).to_pylist()], np.int64)
        for start, stop in pieces(batch.column(1), BATCH_ROWS, BATCH_CHARS):
            yield own[start:stop], presence(batch.column(1)[start:stop].to_pylist(), model.symbols)[0]


def _places(seen: np.ndarray) -> np.ndarray:
    """As ``np.flatnonzero``, looking at eight places at once first."""
    eights = np.flatnonzero(seen.reshape(-1).view(np.uint64))
    at = np.flatnonzero(seen.reshape(-1, 8)[eights].view(bool))
    return eights[at >> 3] * 8 + (at & 7)


def _tallies(model: StringKernelModel, weights: np.ndarray):
    """For ``mapInArrow`` over ``l, t``: ``slot, place, n``, to be summed.

    A slot from 0 on is a language and ``n`` the number of its texts with the n-gram. Slot -1 has the weighted products of two
    landmarks' kernels, slot -2 - k the weighted kernels of language k, both in whole numbers, so that sums do not depend on the order.
    """
    upper = np.triu_indices(model.landmarks.shape[1])

    def rows(slot: np.ndarray, place: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(slot, pa.int32()), pa.array(place, pa.int32()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["slot", "place", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((len(model.norms), len(model.norms)), np.int64)
        sums = np.zeros((len(model.languages), len(model.norms)), np.int64)
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
            both, at = np.unique(np.r_[keys, new], return_inverse=True)
            return both, np.bincount(at, np.r_[counts, n], len(both)).astype(np.int64)

        for own, seen in _marked(batches, model):
            across = kernel(seen, model).astype(np.float64)
            # Of at most 64 rows, so the product is exact.
            x = np.rint(across * np.sqrt(weights[own])[:, None] * PRODUCT_UNIT)
            products += (x.T @ x).astype(np.int64)
            np.add.at(sums, own, np.rint(across * weights[own][:, None] * SUM_UNIT).astype(np.int64))
            place = _places(seen)
            held.append(own[place >> HASH_BITS] * N_GRAMS + (place & (N_GRAMS - 1)))
            size += len(place)
            if size >= HELD_PLACES:
                keys, counts = merged()
                held, size = [], 0
                if len(keys) >= HELD_PLACES:
                    yield rows(keys >> HASH_BITS, keys & (N_GRAMS - 1), counts)
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield rows(keys >> HASH_BITS, keys & (N_GRAMS - 1), counts)
        if products.any():
            yield rows(np.full(len(upper[0]), -1), np.arange(len(upper[0])), products[upper])
            lang, place = np.nonzero(sums)
            yield rows(-2 - lang, place, sums[lang, place])

    return run


def _shares(model: StringKernelModel, others: np.ndarray):
    """For ``mapInArrow`` over ``l, t``: ``slot, share``, the known share of a text in whole ``SHARE_UNIT``s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, seen in _marked(batches, model):
            share = np.rint(_known_share(seen, others[own]) * SHARE_UNIT).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(share)], names=["slot", "share"])

    return run


def _quantile(values: np.ndarray, numbers: np.ndarray, q: float) -> float:
    """``np.quantile`` of sorted values that occur so many times."""
    ends = np.cumsum(numbers)
    at = (ends[-1] - 1) * q
    low, high = values[np.searchsorted(ends, [np.floor(at), np.ceil(at)], "right")]
    return low + (high - low) * (at - np.floor(at))


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_train: int = MAX_TRAIN,
    n_landmarks: int = LANDMARKS,
    ridge: float = RIDGE,
) -> StringKernelModel | None:
    """Fit on all distinct texts with a language; None if there is none.

    The regression, the n-gram counts and the floors take every such text, of any length. A language's texts together
    weigh in the regression what ``quotas`` gives it of ``max_train``. Landmarks are texts of least hash, dealt to
    the languages in turn. The model is the same at each run, however the rows are dealt to tasks.
    """
    known = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.xxhash64(text_col).alias("h")
    )
    bound_batches(labelled.sparkSession)
    space = Workspace(labelled.sparkSession)
    try:
        # Copies are one text before Python sees them.
        texts = known.groupBy("h").agg(F.min(F.struct("l", "t")).alias("row")).select("h", "row.*")
        return _fitted(space.save(texts, "labelled"), max_train, n_landmarks, ridge)
    finally:
        space.drop("labelled")


def _fitted(texts: DataFrame, max_train: int, n_landmarks: int, ridge: float) -> StringKernelModel | None:
    """As ``fit``, of distinct texts ``t`` with hash ``h`` and language ``l``."""
    sizes = {r.l: r.n for r in texts.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages, symbols = sorted(sizes), symbol_table()
    size = np.array([sizes[lang] for lang in languages])
    share = quotas(sizes, max_train)
    weight = np.array([share[lang] for lang in languages], np.float64)

    turn = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    dealt = texts.select("h", "l", turn.alias("turn")).where(F.col("turn") <= n_landmarks)
    order = [r.h for r in dealt.orderBy("turn", "h").limit(n_landmarks).collect()]
    sets = {r.h: r.grams for r in texts.where(F.col("h").isin(order)).select("h", _gram_set(F.col("t"), symbols).alias("grams")).collect()}
    marked = _seen([sets[h] for h in order])
    vocabulary = np.flatnonzero(marked.any(axis=0))
    landmarks = np.ascontiguousarray(marked[:, vocabulary].T)
    norms = np.sqrt(marked.sum(axis=1, dtype=np.float64))
    n_known = (len(languages), N_GRAMS // 8)
    model = StringKernelModel(
        languages, symbols, vocabulary, landmarks, norms, np.empty(0), np.empty(0), np.zeros(n_known, np.uint8), np.zeros(len(languages))
    )

    # An n-gram is known if more texts than this have it; ``others`` leaves the judged text itself out.
    least = np.maximum(1, KNOWN_PART * size)
    tallies = texts.select("l", "t").mapInArrow(_tallies(model, weight / size), "slot int, place int, n long")
    tallies = tallies.groupBy("slot", "place").agg(F.sum("n").alias("n"))
    table = tallies.where((F.col("slot") < 0) | (F.col("n") > F.get(F.lit(least.tolist()), "slot"))).toArrow()
    slot, place, n = (table.column(c).to_numpy() for c in ("slot", "place", "n"))
    others = np.zeros(n_known, np.uint8)
    judged = [k for k in range(len(languages)) if size[k] >= MIN_JUDGED]
    for k in judged:
        own = slot == k
        for bits, some in ((model.known, own), (others, own & (n - 1 > max(1, KNOWN_PART * (size[k] - 1))))):
            has = np.zeros(N_GRAMS, bool)
            has[place[some]] = True
            bits[k] = np.packbits(has)
    if judged:
        shares = texts.where(F.col("l").isin([languages[k] for k in judged])).select("l", "t")
        shares = shares.mapInArrow(_shares(model, others), "slot int, share int").groupBy("slot", "share").count()
        found = np.array(sorted((r.slot, r.share, r["count"]) for r in shares.collect()), np.int64)
        for k in judged:
            _, value, number = found[found[:, 0] == k].T
            model.floors[k] = FIT_PART * _quantile(value / SHARE_UNIT, number, FIT_QUANTILE)

    products, sums = np.zeros((len(order), len(order))), np.zeros((len(languages), len(order)))
    upper = np.triu_indices(len(order))
    product = slot == -1
    products[upper[0][place[product]], upper[1][place[product]]] = n[product] / PRODUCT_UNIT**2
    products += np.triu(products, 1).T
    sums[-2 - slot[slot < -1], place[slot < -1]] = n[slot < -1] / SUM_UNIT
    value, vector = np.linalg.eigh(kernel(marked, model).astype(np.float64))
    keep = value > 1e-8 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    total, mean_y = weight.sum(), weight / weight.sum()
    mean_x = sums.sum(axis=0) / total
    centred = root.T @ (products - total * np.outer(mean_x, mean_x)) @ root
    across = root.T @ (sums - weight[:, None] * mean_x).T
    coef = np.linalg.solve(centred + ridge * total * np.eye(len(centred)), across)
    model.weights = (root @ coef).astype(np.float32)
    model.bias = (mean_y - mean_x @ root @ coef).astype(np.float32)
    return model


def kernel(seen: np.ndarray, model: StringKernelModel) -> np.ndarray:
    """Kernel of texts with the landmarks by their ``presence``."""
    own = np.sqrt(np.array([np.count_nonzero(row) for row in seen.view(bool)], np.float64))
    both = seen[:, model.vocabulary].astype(np.float32) @ model.landmarks.astype(np.float32)
    return both / (own[:, None] * model.norms[None, :]).astype(np.float32)


def predict(text: Column, model: StringKernelModel | None, judge: bool = False) -> Column:
    """``struct<lang, score, fits>`` of a text column; ``fits`` is null unless ``judge``.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. The score is the
    ridge regression's value for the language, cut to 0 to 1.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            langs, scores, fits = [], [], []
            for start, stop in pieces(texts, BATCH_ROWS, BATCH_CHARS):
                part = [t or "" for t in texts[start:stop].to_pylist()]
                if model is None:
                    langs += [UNDETERMINED] * len(part)
                    scores += [0.0] * len(part)
                    fits += [None] * len(part)
                    continue
                seen, lettered = presence(part, model.symbols)
                values = kernel(seen, model) @ model.weights + model.bias
                best = values.argmax(axis=1)
                top = np.clip(values[np.arange(len(part)), best], 0, 1)
                langs += [model.languages[b] if some else UNDETERMINED for b, some in zip(best, lettered, strict=True)]
                scores += np.where(lettered, top, 0.0).tolist()
                fits += (lettered & fitting(seen, values, model)).tolist() if judge else [None] * len(part)
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.bool_())],
                names=["lang", "score", "fits"],
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "lang string, score double, fits boolean")(text)


def identify(
    docs: DataFrame, model: StringKernelModel | None, text_col: str = "text", fits_col: str | None = None
) -> DataFrame:
    """All rows and columns, with ``lang_pred`` and ``score``; only the text is looked at.

    ``fits_col`` names one more column: whether the text fits the language (see ``fitting``). Null without a model.
    """
    bound_batches(docs.sparkSession)
    found = predict(F.col(text_col), model, fits_col is not None)
    named = {"lang_pred": F.col("_lang.lang"), "score": F.col("_lang.score")}
    if fits_col is not None:
        named[fits_col] = F.col("_lang.fits")
    return docs.withColumn("_lang", found).withColumns(named).drop("_lang")
