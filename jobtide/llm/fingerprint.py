"""Document fingerprints by consistent weighted sampling.

A text is a multiset of word shingles, a shingle's weight being its number of occurrences. For each of ``samples``
draws a shingle of weight ``S`` has, from its hash alone, ``r`` and ``c`` of a Gamma(2, 1)
and ``b`` of a uniform distribution; with ``t = floor(ln S / r + b)`` its value is
``ln c - r (t - b + 1)``. The least value of a text is its sample. Two texts
have the same one with probability sum(min S) / sum(max S), their generalised Jaccard
similarity, so the share of equal samples estimates it.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.text import text_hash, whole, words
from jobtide.llm.workspace import Workspace

SAMPLES = 32
SHINGLE = 5
#: Documents in a stretch of the id order, and the most stretches that the driver cuts.
STRETCH_DOCS = 1000
MAX_STRETCHES = 20_000
#: The sample of a text without words.
NO_WORDS = 0


def _hashes(width: int) -> Column:
    """Sorted hashes of all shingles of the words ``w``; of all words together where there are fewer."""
    shingle = F.transform(
        F.sequence(F.lit(0), F.size("w") - width),
        lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(width))),
    )
    few = F.when(F.size("w") > 0, F.array(F.xxhash64(F.concat_ws(" ", "w")))).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.sort_array(F.when(F.size("w") >= width, shingle).otherwise(few))


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """A number between 0 and 1, neither included, from ``width`` bits of a hash."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part + F.lit(0.5)) * F.lit(1.0 / (1 << width))


def _value(h: Column, log_weight: Column, draw: int) -> Column:
    """The value of a shingle in one draw; the least one of a text is its sample."""
    one, two = F.xxhash64(F.lit(2 * draw), h), F.xxhash64(F.lit(2 * draw + 1), h)
    r = -F.ln(_uniform(one, 0, 32) * _uniform(one, 32, 32))
    c = -F.ln(_uniform(two, 0, 24) * _uniform(two, 24, 24))
    b = _uniform(two, 48, 16)
    t = F.floor(log_weight / r + b)
    return F.ln(c) - r * (t - b + 1)


def _least(terms: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """The least value of every draw, ``v0`` and on, over the terms ``h, log_weight`` of equal keys."""
    return terms.groupBy(*keys).agg(
        *(F.min(_value(F.col("h"), F.col("log_weight"), k)).alias(f"v{k}") for k in range(samples))
    )


def _small(values: list[Column]) -> Column:
    """The samples of a text by the least values of its draws."""
    return F.array(*(F.when(v.isNull(), F.lit(NO_WORDS)).otherwise(F.hash(v)) for v in values))


def _starts(hashes: str) -> Column:
    """Where runs of equal hashes start, and the end of the array: past it every element is null."""
    at = F.sequence(F.lit(0), F.size(hashes))
    return F.filter(at, lambda i: (i == 0) | ~F.get(hashes, i).eqNullSafe(F.get(hashes, i - 1)))


def sample_texts(frame: DataFrame, keys: list[str], text: Column, samples: int = SAMPLES, width: int = SHINGLE) -> DataFrame:
    """``keys`` and ``samples``, an array of 32-bit hashes, for every row; ``keys`` tell rows apart.

    Shingles are counted within the row, over its sorted hashes; values and least values
    are made where the row is read, without a shuffle of shingles.
    """
    runs = F.when(F.size("hs") > 0, F.sequence(F.lit(0), F.size("starts") - 2))
    weight = F.get("starts", F.col("j") + 1) - F.get("starts", F.col("j"))
    terms = (
        frame.select(*keys, words(text).alias("w"))
        .select(*keys, _hashes(width).alias("hs"))
        .select(*keys, "hs", _starts("hs").alias("starts"))
        .select(*keys, "hs", "starts", F.explode_outer(runs).alias("j"))
        .select(
            *keys,
            F.get("hs", F.get("starts", F.col("j"))).alias("h"),
            F.when(weight > 1, F.ln(weight.cast("double"))).otherwise(F.lit(0.0)).alias("log_weight"),
        )
    )
    least = _least(terms, keys, samples)
    return least.select(*keys, _small([F.col(f"v{k}") for k in range(samples)]).alias("samples"))


def sample_pairs(
    frame: DataFrame, keys: list[str], one: Column, two: Column, samples: int = SAMPLES, width: int = SHINGLE
) -> DataFrame:
    """As ``sample_texts`` for two texts of every row: ``keys``, ``samples`` and ``others``.

    A shingle that both texts have once has its values made once. Others are terms of their own
    text; the least values of these three kinds of terms are put together at the end.
    """

    both, first, second = 0, 1, 2
    pair = ("1", "2")
    no_hashes = F.array().cast("array<bigint>")

    def often(x: str) -> Column:
        """Hashes that a text has several times, with their numbers; most texts have none."""
        place = F.sequence(F.lit(0), F.size(f"starts{x}") - 2)

        def weight(j: Column) -> Column:
            return F.get(f"starts{x}", j + 1) - F.get(f"starts{x}", j)

        several = F.filter(place, lambda j: weight(j) > 1)
        runs = F.transform(several, lambda j: F.struct(F.get(f"hs{x}", F.get(f"starts{x}", j)).alias("h"), weight(j).alias("n")))
        return F.when(F.col(f"starts{x}").isNotNull(), runs)

    def once(x: str) -> Column:
        return F.when(F.col(f"often{x}").isNull(), F.col(f"hs{x}")).otherwise(F.array_except(f"hs{x}", F.col(f"often{x}.h")))

    ends = [F.size("both"), F.size("both") + F.size("only1"), F.size("both") + F.size("only1") + F.size("only2")]
    terms = (
        frame.select(*keys, words(one).alias("w"), two.alias("_two"))
        .select(*keys, _hashes(width).alias("hs1"), words(F.col("_two")).alias("w"))
        .select(*keys, "hs1", _hashes(width).alias("hs2"))
        .select(
            *keys,
            "hs1",
            "hs2",
            *(
                F.when(F.size(F.array_distinct(f"hs{x}")) < F.size(f"hs{x}"), _starts(f"hs{x}")).alias(f"starts{x}")
                for x in pair
            ),
        )
        .select(*keys, "hs1", "hs2", *(often(x).alias(f"often{x}") for x in pair))
        .select(*keys, "often1", "often2", *(once(x).alias(f"once{x}") for x in pair))
        .select(
            *keys,
            "often1",
            "often2",
            F.array_intersect("once1", "once2").alias("both"),
            F.array_except("once1", "once2").alias("only1"),
            F.array_except("once2", "once1").alias("only2"),
        )
        .select(
            *keys,
            *(end.alias(f"end{k}") for k, end in enumerate(ends)),
            (ends[2] + F.coalesce(F.size("often1.h"), F.lit(0))).alias("end3"),
            F.concat(F.coalesce("often1.n", F.array().cast("array<int>")), F.coalesce("often2.n", F.array().cast("array<int>"))).alias("n"),
            F.posexplode_outer(
                F.concat("both", "only1", "only2", F.coalesce("often1.h", no_hashes), F.coalesce("often2.h", no_hashes))
            ).alias("at", "h"),
        )
        .select(
            *keys,
            "h",
            F.when(F.col("at") >= F.col("end2"), F.ln(F.get("n", F.col("at") - F.col("end2")).cast("double")))
            .otherwise(F.lit(0.0))
            .alias("log_weight"),
            F.when(F.col("at") < F.col("end0"), both)
            .when((F.col("at") < F.col("end1")) | F.col("at").between(F.col("end2"), F.col("end3") - 1), first)
            .otherwise(second)
            .alias("side"),
        )
    )
    values = [F.col(f"v{k}") for k in range(samples)]
    least = _least(terms, [*keys, "side"], samples)
    least = least.groupBy(*keys).agg(
        *(F.min(F.when(F.col("side") != second, v)).alias(f"a{k}") for k, v in enumerate(values)),
        *(F.min(F.when(F.col("side") != first, v)).alias(f"b{k}") for k, v in enumerate(values)),
    )
    # A text without words has the values of no hash, as where it is sampled alone.
    nothing = [_value(F.lit(None).cast("bigint"), F.lit(0.0), k) for k in range(samples)]
    own, other = ([F.coalesce(f"{x}{k}", nothing[k]) for k in range(samples)] for x in "ab")
    return least.select(*keys, _small(own).alias("samples"), _small(other).alias("others"))


def likeness(a: Column, b: Column, samples: int) -> Column:
    """Share of equal samples."""
    equal = [(F.get(a, k) == F.get(b, k)).cast("int") for k in range(samples)]
    return sum(equal[1:], equal[0]) / F.lit(float(samples))


def as_text(samples: Column) -> Column:
    """Eight hex digits for each sample."""
    return F.array_join(
        F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), ""
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows and columns, with ``samples`` and ``fingerprint``; null texts are empty texts."""
    key = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    numbered = docs.select(key, F.monotonically_increasing_id().alias("n"), whole(text_col).alias("t"))
    space = Workspace(docs.sparkSession)
    kept = space.save(numbered, "rows")
    found = sample_texts(kept.select("n", "t"), ["n"], F.col("t"), **options)
    return kept.join(found, "n").select("row.*", "samples", as_text(F.col("samples")).alias("fingerprint"))


def _cuts_above(id_: Column, cuts: list) -> Column:
    """How many of the falling ``cuts`` lie above the id, by binary search; null ids come last."""
    bound = F.array(*(F.lit(c) for c in cuts))
    levels = len(cuts).bit_length()

    def step(at: Column, level: Column) -> Column:
        ahead = at + F.pow(F.lit(2), F.lit(levels) - level).cast("int")
        return F.when((ahead <= len(cuts)) & (F.get(bound, ahead - 1) > id_), ahead).otherwise(at)

    place = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(0), step)
    return F.when(id_.isNull(), F.lit(len(cuts) + 1)).otherwise(place)


def _stretch(points: list, n_null: int, size: int) -> tuple[Column, Column, Column]:
    """The stretch of ``id, text_id``: between cuts of the id order; ids with many rows are cut by the text's hash.

    A point of the id order that occurs several times is an id of as many stretches. Its rows come behind those of larger
    ids, in the order of their hashes; rows without id come last.
    """
    number = Counter(points)
    cuts = sorted(number, reverse=True)
    bits = [(number[c] - 1).bit_length() for c in cuts] + [0]
    hot = F.array(*(F.lit(b) for b in bits))
    place = _cuts_above(F.col("id"), cuts) if cuts else F.when(F.col("id").isNull(), F.lit(1)).otherwise(F.lit(0))
    own = F.get(F.array(*(F.lit(c) for c in cuts)), place) if cuts else F.lit(None).cast("long")
    null_bits = F.lit((n_null // size).bit_length())
    cut = F.when(F.col("id").isNull(), null_bits).when(F.col("id") == own, F.get(hot, place)).otherwise(F.lit(0))
    # The hash's leading bits, in the order of signed numbers.
    lead = F.expr("shiftrightunsigned(text_id ^ (-9223372036854775807L - 1L), 64 - _bits)")
    within = F.when(F.col("_bits") > 0, lead).otherwise(F.lit(0))
    behind = F.when((F.col("id") == own) & (F.col("_bits") > 0), F.lit(1)).otherwise(F.lit(0))
    return place, cut, (F.col("_place") * 2 + behind) * F.lit(1 << 40) + within


def edited_neighbours(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, width: int = SHINGLE
) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and likenesses.

    ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    The next document is the one of the next smaller id, of the last one the first; null ids
    come last, rows of one id are ordered by text hash and text. The edited text has
    its last third replaced by as many code points from the start of the next text. A single document is its own
    next; an empty table gives an empty one. Documents are ordered within
    stretches of the id order, ids with many rows and rows without id within stretches of their hashes; only the border of a
    stretch looks up the first document of the next.
    """
    space = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("t"))
    n_docs, n_null = rows.agg(F.count("*"), F.count_if(F.col("id").isNull())).first()
    n = min(max(1, n_docs // STRETCH_DOCS), MAX_STRETCHES)
    points = rows.agg(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], 10 * n)).first()[0]
    place, bits, stretch = _stretch([p for p in points or [] if p is not None], n_null, max(STRETCH_DOCS, n_docs // n))
    keyed = (
        rows.withColumn("text_id", text_hash(F.col("t")))
        .withColumns({"_place": place.cast("long"), "_bits": bits})
        .withColumn("s", stretch)
        .select("id", "t", "text_id", "s")
    )
    order = [F.col("id").desc_nulls_last(), "text_id", "t"]
    inside = Window.partitionBy("s").orderBy(*order)

    # One row for each stretch, without texts: where it begins, and which stretch it is behind.
    first = F.max(F.struct("id", F.bitwise_not("text_id").alias("mirrored"))).alias("head")
    along = Window.orderBy("s")
    every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = space.save(keyed.groupBy("s").agg(first), "heads")
    heads = space.save(
        heads.select(
            F.col("s").alias("hs"),
            F.col("head.id").alias("head_id"),
            F.bitwise_not("head.mirrored").alias("head_text"),
            F.coalesce(F.lag("s").over(along), F.last("s").over(every)).alias("behind"),
        ),
        "borders",
    )
    at_head = (F.col("s") == F.col("hs")) & F.col("id").eqNullSafe(F.col("head_id")) & (F.col("text_id") == F.col("head_text"))
    border = (
        keyed.join(heads, at_head)
        .withColumn("k", F.row_number().over(inside))
        .where("k = 1")
        .select(F.col("behind").alias("s"), F.col("t").alias("ahead"))
    )
    third = F.expr("n_chars div 3").cast("int")
    edited = (
        keyed.select("s", "id", "t", F.row_number().over(inside).alias("k"), F.lead("t").over(inside).alias("next"))
        .join(border, "s", "left")
        .select("s", "id", "k", "t", F.char_length("t").alias("n_chars"), F.coalesce("next", "ahead").alias("next"))
        .select(
            "s",
            "id",
            "k",
            "t",
            "n_chars",
            F.concat(
                F.substring("t", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring("next", F.lit(1), third)
            ).alias("edited"),
        )
        .withColumn("edited_sha256", F.sha2("edited", 256))
    )
    keys = ["s", "k", "id", "n_chars", "edited_sha256"]
    found = space.save(sample_pairs(edited, keys, F.col("t"), F.col("edited"), samples, width), "samples")
    along = Window.partitionBy("s").orderBy("k")
    ahead = found.where("k = 1").join(heads, F.col("s") == F.col("hs")).select(F.col("behind").alias("s"), F.col("samples").alias("ahead"))
    return (
        found.withColumn("next", F.lead("samples").over(along))
        .join(ahead, "s")
        .select(
            "id",
            F.col("n_chars").cast("long").alias("n_chars"),
            "edited_sha256",
            as_text(F.col("samples")).alias("fingerprint"),
            as_text(F.col("others")).alias("edited_fingerprint"),
            likeness(F.col("samples"), F.col("others"), samples).alias("near_edited"),
            likeness(F.col("samples"), F.coalesce("next", "ahead"), samples).alias("near_next"),
        )
    )
