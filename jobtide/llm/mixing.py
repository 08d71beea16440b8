"""A mix of sources by target weights, made of fixed-length blocks of words.

The words of a source, its documents in pseudorandom order, are cut into blocks of
``block_words``. The output is a row of shards of slots. Of a shard's slots each source gets the whole part of its share;
the others are drawn, one by one, by what is left of the shares, so a shard's counts are multinomial about the targets. A
source's i-th slot takes the block that a keyed permutation gives for i, one permutation for each
pass over the source. Slots are joined with blocks by that index and written as shards; how often a
document is taken is read back from them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.text import text_hash, whole, words
from jobtide.llm.workspace import Workspace

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 1024
SEED = 42
ROUNDS = 16
#: Rows that one task of a two-level running total sees of a key at once, about.
SCAN_ROWS = 4096
#: Parts of a slot in which shares are reckoned.
FINE = 1 << 20
#: Cells of an interval lookup; every cell holds one interval and those that begin in it.
CELLS = 2048


def before(frame: DataFrame, keys: list[str], group: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of a key, in two levels.

    ``group`` cuts a key's rows into stretches that follow each other in the order; sums
    of the stretches are added up first, so no task sees all rows of a key.
    """
    grouped = frame.withColumn("_group", group)
    totals = grouped.groupBy(*keys, "_group").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, "_group", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys, "_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        grouped.join(bases, [*keys, "_group"])
        .withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("_group", "_base")
    )


def in_interval(points: DataFrame, x: str, intervals: DataFrame, total: int) -> DataFrame:
    """Join each point with the interval ``[lo, lo + n)`` of ``[0, total)`` that holds it.

    Intervals are cut at the borders of equal cells, so the join has an equality.
    """
    width = max(1, -(-total // CELLS))
    cells = intervals.where("n > 0").withColumn(
        "_cell", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(lo + n - 1) div {width}")))
    )
    return (
        points.withColumn("_cell", F.expr(f"`{x}` div {width}"))
        .join(cells, "_cell")
        .where((F.col(x) >= F.col("lo")) & (F.col(x) < F.col("lo") + F.col("n")))
        .drop("_cell")
    )


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of ``0..n-1`` at ``x``: swap-or-not rounds, each its own inverse."""
    size = F.greatest(n, F.lit(1))

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), size) - at, size)
        swap = F.xxhash64(key, r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), step)


def source_targets(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """``sid, source, source_size, target`` from rows ``source, size``.

    Sources in code point order, null last, weigh ``weights`` in turn and share the whole size. A
    target stops at ``max_repeat`` times its source's size, and the excess is shared by
    weight among the others. With sources by rising cap per weight, the first whose
    share of what the capped ones leave is within its cap fixes the share of all. One row for each source: the window over
    them sees no documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(
        F.array(*(F.lit(int(w)).cast("long") for w in weights)), (F.col("sid") % len(weights) + 1).cast("int")
    )
    totals = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("w", turn)
        .withColumn("cap", F.col("source_size") * max_repeat)
    )
    rising = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = (
        totals.withColumn("total", F.sum("source_size").over(every))
        .withColumn("at", F.row_number().over(rising))
        .withColumn(
            "left",
            F.col("total")
            - F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .withColumn("w_left", F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn(
            "first",
            F.min(
                F.when(
                    F.col("left") * F.col("w") <= F.col("cap") * F.col("w_left"),
                    F.struct("at", "left", "w_left"),
                )
            ).over(every),
        )
    )
    return shares.select(
        "sid",
        "source",
        "source_size",
        F.when(F.col("at") < F.col("first.at"), F.col("cap").cast("double"))
        .otherwise(F.col("first.left") * F.col("w") / F.col("first.w_left"))
        .alias("target"),
    )


def _quotas(sources: DataFrame, block_words: int, max_repeat: int) -> DataFrame:
    """Blocks of every source, slots it may fill, and slots that its target asks for, in parts of ``FINE``.

    A slot of a source brings the mean length of its blocks, which differs from the block length by the last block.
    """
    blocks = F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    return (
        sources.withColumn("blocks", blocks)
        .withColumn("most", F.col("blocks") * max_repeat)
        .withColumn(
            "share",
            F.coalesce(F.round(F.col("target") * F.col("blocks") / F.nullif("source_size", F.lit(0)) * FINE), F.lit(0)).cast("long"),
        )
        .withColumn("asked", F.expr(f"(share + {FINE // 2}) div {FINE}"))
    )


def _running(frame: DataFrame, value: Column, name: str) -> DataFrame:
    """The sum over the sources before, in a table of one row for each source."""
    ahead = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return frame.withColumn(name, F.coalesce(F.sum(value).over(ahead), F.lit(0)))


def _drawn(quotas: DataFrame, n_shards: int, shard_slots: int, total: int, seed: int, spark) -> DataFrame:
    """``slot, shard, sid``: the source that each slot has drawn.

    Places of a shard come in a pseudorandom order. The first ones are the whole parts of the sources' shares, the others
    are drawn by the rests.
    """
    fair = quotas.withColumn("whole", F.expr(f"cast(share as decimal(19,0)) * {shard_slots} div {max(1, total)}"))
    left = f"(cast(share as decimal(19,0)) * {shard_slots} % {max(1, total)})"
    fair = fair.withColumn("rest", F.expr(f"cast({left} * {FINE} div {max(1, total)} as long)"))
    fair = _running(_running(fair, F.col("whole"), "whole_lo"), F.col("rest"), "rest_lo")
    filled, rests = fair.agg(F.coalesce(F.sum("whole"), F.lit(0)), F.coalesce(F.sum("rest"), F.lit(0))).first()
    n_slots = n_shards * shard_slots
    shard = F.expr(f"id div {shard_slots}")
    places = spark.range(0, n_slots, 1, max(1, min(10_000, n_slots // 500_000 + 8))).select(
        F.col("id").alias("slot"),
        shard.alias("shard"),
        permuted(F.col("id") % shard_slots, F.lit(shard_slots), F.xxhash64(F.lit(seed), shard)).alias("x"),
    )
    sure = in_interval(
        places.where(F.col("x") < filled), "x", fair.select("sid", F.col("whole_lo").alias("lo"), F.col("whole").alias("n")), filled
    )
    chance = F.pmod(F.xxhash64(F.lit(seed + 2), "slot"), F.lit(max(1, rests)))
    open_ = places.where(F.col("x") >= filled).withColumn("x", chance)
    lucky = in_interval(open_, "x", fair.select("sid", F.col("rest_lo").alias("lo"), F.col("rest").alias("n")), rests)
    return sure.select("slot", "shard", "sid").union(lucky.select("slot", "shard", "sid"))


def _slots(quotas: DataFrame, n_shards: int, shard_slots: int, total: int, seed: int, space: Workspace) -> DataFrame:
    """``slot, shard, sid, i``: which source's how-manieth slot each output slot is.

    A source gives no more than its passes; slots beyond go to the sources that have drawn fewer than their targets ask for.
    """
    drawn = space.save(_drawn(quotas, n_shards, shard_slots, total, seed, space.spark), "drawn")
    counts = space.save(drawn.groupBy("shard", "sid").agg(F.count("*").alias("n")), "counts")
    bases = before(counts, ["sid"], F.expr(f"shard div {SCAN_ROWS}"), ["shard"], "n", "base")
    rank = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1
    ranked = drawn.withColumn("rank", rank).join(
        bases.select("shard", "sid", "base"), ["shard", "sid"]
    ).select("slot", "shard", "sid", (F.col("base") + F.col("rank")).alias("i"))
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    balance = quotas.select("sid", "most", "asked").join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    over, lack = F.greatest(F.col("got") - F.col("most"), F.lit(0)), F.greatest(F.least("asked", "most") - F.col("got"), F.lit(0))
    balance = balance.withColumns({"over": over, "lack": lack})
    balance = space.save(_running(_running(balance, F.col("over"), "over_lo"), F.col("lack"), "lo"), "balance")
    known = ranked.join(balance.select("sid", "most", "over_lo"), "sid")
    kept = known.where("i < most").select("slot", "shard", "sid", "i")
    beyond = known.where("i >= most").select(
        "slot", "shard", (F.col("over_lo") + F.col("i") - F.col("most")).alias("x")
    )
    lacking = balance.where("lack > 0").select("sid", "lo", F.col("lack").alias("n"), "got")
    n_lacking = balance.agg(F.coalesce(F.sum("lack"), F.lit(0))).first()[0]
    moved = in_interval(beyond, "x", lacking, n_lacking).select(
        "slot", "shard", "sid", (F.col("got") + F.col("x") - F.col("lo")).alias("i")
    )
    return kept.union(moved)


def _uses(slots: DataFrame, quotas: DataFrame, block_words: int, seed: int) -> DataFrame:
    """``slot, shard, sid, block, used``: the block each slot takes, and its words."""
    known = slots.join(quotas.select("sid", "blocks", "source_size"), "sid").withColumns(
        {"pass": F.expr("i div blocks"), "j": F.expr("i % blocks")}
    )
    block = permuted(F.col("j"), F.col("blocks"), F.xxhash64(F.lit(seed), "sid", "pass"))
    length = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words)
    return known.withColumn("block", block).select("slot", "shard", "sid", "block", length.alias("used"))


def _mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their places, rows of the shards, and slots, as ``mix`` and ``mixed_documents`` use them."""
    space = Workspace(docs.sparkSession)
    sized = space.save(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), whole(text_col).alias("t"))
        .select("id", "source", text_hash(F.col("t")).alias("text_id"), F.size(words(F.col("t"))).cast("long").alias("size")),
        "sized",
    )
    quotas = space.save(_quotas(source_targets(sized, weights, max_repeat), block_words, max_repeat), "quotas")
    total = quotas.agg(F.coalesce(F.sum("share"), F.lit(0))).first()[0]
    n_slots, n_docs = -(-total // FINE), sized.count()
    # Equal shards: a short one would have no whole parts of its own.
    n_shards = -(-n_slots // shard_slots)
    shard_slots = -(-n_slots // max(1, n_shards))
    slots = _slots(quotas, n_shards, max(1, shard_slots), total, seed, space)
    uses = space.save(_uses(slots, quotas, block_words, seed), "uses")
    bits = max(0, (n_docs // SCAN_ROWS).bit_length())
    known = sized.join(
        quotas.select("sid", F.col("source").alias("_source"), "source_size", "target"),
        F.col("source").eqNullSafe(F.col("_source")),
    ).drop("_source")
    placed = known.where("size > 0").withColumn("h", F.xxhash64(F.lit(seed), "id", "text_id"))
    stretch = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    placed = space.save(before(placed, ["sid"], stretch, ["h", "id", "text_id"], "size", "start").drop("h"), "placed")
    first, last = f"start div {block_words}", f"(start + size - 1) div {block_words}"
    pieces = placed.select(
        "sid", "start", "size", F.explode(F.sequence(F.expr(first), F.expr(last))).alias("block")
    ).withColumns(
        {
            "lo": F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0)),
            "hi": F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words)),
        }
    )
    shards = space.save(
        uses.join(pieces, ["sid", "block"]).select(
            "shard",
            "slot",
            "sid",
            "start",
            (F.col("block") * block_words + F.col("lo") - F.col("start")).alias("from_word"),
            (F.col("hi") - F.col("lo")).alias("n"),
        ),
        "shards",
    )
    empty = known.where("size = 0").withColumn("start", F.lit(None).cast("long"))
    named = uses.join(quotas.select("sid", "source"), "sid").select("slot", "shard", "source", "block", "used")
    return placed.unionByName(empty), shards, named


def mix(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Documents ``id, text_id, source, size, source_size, target, taken`` and the slots.

    Slots are ``slot, shard, source, block, used``. A row of ``docs`` is a document, repeated rows
    are several. Sizes count words, null texts have none; documents without words take part with
    ``taken`` 0. ``taken`` is the number of a document's words in all shards. Its sums come near the targets: of a shard's
    slots only those that the whole parts of the shares leave are drawn. No document
    is taken more than ``max_repeat`` times. All draws are hashes, so reruns agree. A source
    without words has target 0; an empty table gives empty results. Options are those of ``_mixed``.
    """
    placed, shards, slots = _mixed(docs, **options)
    taken = shards.groupBy(F.col("sid").alias("_sid"), F.col("start").alias("_start")).agg(F.sum("n").alias("taken"))
    # A row with words has a place of its own in its source's running sum; one without has none.
    mixed = placed.join(taken, (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start")), "left")
    names = ["id", "text_id", "source", "size", "source_size", "target"]
    return mixed.select(*names, F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), slots


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` repeated as often as the mix takes them; columns stay.

    A document goes, as a whole, with each slot whose block holds its first word, so blocks and draws decide and sums stay
    near the targets. Documents without words have no place in the mix and go.
    """
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    placed, shards, _ = _mixed(docs, text_col=text_col, **options)
    begun = shards.where("from_word = 0").groupBy(F.col("sid").alias("_sid"), F.col("start").alias("_start"))
    begun = begun.agg(F.count("*").cast("int").alias("times"))
    counted = (
        placed.where("start is not null")
        .join(begun, (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start")), "left")
        .groupBy("id", "text_id", "source")
        .agg(F.coalesce(F.sum("times"), F.lit(0)).alias("all_times"), F.count("*").alias("rows"))
        .where("all_times > 0")
    )
    # Rows that agree in id, text and source share what they are taken together; a hash of the row's place shares the rest.
    chance = F.pmod(F.xxhash64("place"), F.col("rows")) < F.col("all_times") % F.col("rows")
    times = F.expr("all_times div rows") + chance.cast("long")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.monotonically_increasing_id().alias("place"),
        F.col(id_col).alias("row_id"),
        F.col(source_col).cast("string").alias("row_source"),
        text_hash(whole(text_col)).alias("row_text"),
    )
    same = (
        rows.row_id.eqNullSafe(counted.id)
        & (rows.row_text == counted.text_id)
        & rows.row_source.eqNullSafe(counted.source)
    )
    return (
        rows.join(counted, same)
        .select("row", times.alias("times"))
        .where("times > 0")
        .select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time"))
        .select("row.*")
    )
