"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A document's fingerprint has a bit for each bit that over half of its shingle hashes
set. Two fingerprints are linked if they differ in at most ``radius`` bits. Candidates
come from ``2^(radius+1) - 1`` tables: bit ``i`` has a vector ``m(i)`` of ``radius + 1``
bits, and table ``v`` keeps the bits with odd ``m(i) & v``. Any ``radius`` vectors leave a ``v``
that is orthogonal to all of them, so any two fingerprints within the radius agree
under some table's mask: no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.components import connected_components
from jobtide.llm.text import ascii_lower, text_hash, whole, words
from jobtide.llm.workspace import Workspace

BITS = 64
RADIUS = 4
SHINGLE = 4
#: Members of one table's bucket that one task compares. Larger buckets are linked through half-radius neighbours.
BUCKET_LIMIT = 65536
#: Groups up to this size are compared together, by distance in sorted order.
SMALL_GROUP = 32


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One mask of kept bits for every table."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(BITS)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        for v in range(1, 2 ** (radius + 1))
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _shingle(width: int) -> Column:
    """Shingle ``i`` of the word array ``w``; all words where there are fewer."""
    parts = [F.get("w", F.col("i") + k) for k in range(width)]
    spaced = [p for part in parts for p in (F.lit(" "), part)][1:]
    return F.when(F.size("w") >= width, F.concat(*spaced)).otherwise(F.concat_ws(" ", "w"))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE
) -> DataFrame:
    """``doc_id, text_id, fp, n_shingles, copies`` of every document, whole texts.

    Rows that agree in id and text are one row here, counted in ``copies``. Null texts
    count as empty; without a word the fingerprint is zero and ``n_shingles`` 0.
    Two 32-bit counters share a long, so 32 sums hold the counts of all 64 bits. They are
    summed in the task that reads the document; only the sums are shuffled.
    """
    shingled = (
        docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("t"))
        .select("doc_id", text_hash(F.col("t")).alias("text_id"), words(ascii_lower(F.col("t"))).alias("w"))
        .select(
            "doc_id",
            "text_id",
            "w",
            F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))).alias("i"),
        )
        .select(
            "doc_id",
            "text_id",
            (F.size("w") > 0).alias("some"),
            (F.col("i") == 0).cast("long").alias("first"),
            F.xxhash64(_shingle(width)).alias("h"),
        )
    )
    lanes = F.lit(0x0000000100000001)
    half = BITS // 2
    summed = shingled.groupBy("doc_id", "text_id").agg(
        F.sum("first").alias("copies"),
        F.sum(F.col("some").cast("long")).alias("n_shingles"),
        *(
            F.sum(F.shiftrightunsigned("h", j).bitwiseAND(lanes)).alias(f"s{j}")
            for j in range(half)
        ),
    )
    low = F.lit(0xFFFFFFFF)
    fp = F.lit(0).cast("long")
    for j in range(half):
        for bit, n in (
            (j, F.col(f"s{j}").bitwiseAND(low)),
            (j + half, F.shiftrightunsigned(f"s{j}", 32)),
        ):
            fp = fp.bitwiseOR(
                F.when(n * 2 > F.col("n_shingles"), F.lit(_signed(1 << bit))).otherwise(F.lit(0).cast("long"))
            )
    return summed.select(
        "doc_id",
        "text_id",
        F.when(F.col("n_shingles") > 0, fp).otherwise(F.lit(0).cast("long")).alias("fp"),
        (F.col("n_shingles") / F.col("copies")).cast("long").alias("n_shingles"),
        "copies",
    )


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes, for links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _component_roots(fp: np.ndarray, radius: int) -> np.ndarray:
    """Index of the first member of each one's component within one group.

    Every member is compared once with the members that no component has yet.
    """
    root = np.full(len(fp), -1)
    left = np.arange(len(fp))
    while len(left):
        start, left = left[0], left[1:]
        root[start], queue = start, [start]
        while queue and len(left):
            near = np.bitwise_count(fp[left] ^ fp[queue.pop()]) <= radius
            root[left[near]] = start
            queue.extend(left[near])
            left = left[~near]
    return root


def _group_links(v, key, fp, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first member of its component) of whole, sorted groups."""
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (key[1:] != key[:-1])])
    sizes = np.diff(np.r_[starts, n])
    group = np.repeat(np.arange(len(starts)), sizes)
    size = sizes[group]
    out_a, out_b = [], []
    few = np.flatnonzero((size > 1) & (size <= SMALL_GROUP))
    if len(few):
        f, g = fp[few], group[few]
        a, b = [], []
        for lag in range(1, int(size[few].max())):
            near = (g[lag:] == g[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= radius)
            i = np.flatnonzero(near)
            a.append(i)
            b.append(i + lag)
        label = _forest(len(few), np.concatenate(a), np.concatenate(b))
        moved = np.flatnonzero(label != np.arange(len(few)))
        out_a.append(f[moved])
        out_b.append(f[label[moved]])
    for s in starts[sizes > SMALL_GROUP]:
        f = fp[s : s + size[s]]
        root = _component_roots(f, radius)
        moved = np.flatnonzero(root != np.arange(len(f)))
        out_a.append(f[moved])
        out_b.append(f[root[moved]])
    if not out_a:
        return fp[:0], fp[:0]
    return np.concatenate(out_a), np.concatenate(out_b)


def bucket_links(radius: int, limit: int):
    """A function for ``mapInArrow`` over rows ``v, key, fp`` sorted within partitions.

    Yields links ``a, b`` that connect each bucket's components, at most one per member.
    Members of a bucket above ``limit`` come out with a null ``b``.
    """

    def rows(a, b=None):
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), b], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64)]
        large = None  # the bucket that has passed the limit, while its rows go on
        for batch in batches:
            part = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            part[2] = part[2].view(np.uint64)
            if large is not None:
                same = (part[0] == large[0]) & (part[1] == large[1])
                yield rows(part[2][same])
                part = [c[~same] for c in part]
            if not len(part[0]):
                continue
            large = None
            v, key, fp = (np.concatenate(c) for c in zip(held, part, strict=True))
            cut = int(np.argmax((v == v[-1]) & (key == key[-1])))
            yield from whole_buckets(v[:cut], key[:cut], fp[:cut])
            held = [v[cut:], key[cut:], fp[cut:]]
            if len(held[0]) > limit:
                yield rows(held[2])
                large, held = (v[-1], key[-1]), [c[:0] for c in held]
        yield from whole_buckets(*held)

    def whole_buckets(v, key, fp):
        if not len(v):
            return
        starts = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (key[1:] != key[:-1])])
        sizes = np.repeat(np.diff(np.r_[starts, len(v)]), np.diff(np.r_[starts, len(v)]))
        big = sizes > limit
        if big.any():
            yield rows(fp[big])
        a, b = _group_links(v[~big], key[~big], fp[~big], radius)
        if len(a):
            yield rows(a, b)

    return run


def _half_radius_links(members: DataFrame, radius: int) -> DataFrame:
    """Links among fingerprints ``fp`` of large buckets, without comparing pairs.

    Two values within the radius share a value at half of it from both, and all that
    share one are within the radius of each other: each is linked to the smallest.
    """
    if radius % 2 or radius > 4:
        raise ValueError("the radius must be 2 or 4")
    flips = {0} | {1 << i for i in range(BITS)}
    if radius == 4:
        flips |= {(1 << i) | (1 << j) for i in range(BITS) for j in range(i)}
    spread = members.select(
        "fp", F.explode(F.array(*(F.lit(_signed(x)) for x in sorted(flips)))).alias("x")
    ).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("near"))
    least = spread.groupBy("near").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top")
    return spread.join(least, "near").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    radius: int = RADIUS,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """``doc_id, text_id, fp, n_shingles, copies, root, component_id`` of every document.

    ``root`` is the smallest fingerprint and ``component_id`` the smallest id reachable over links of at most ``radius``
    differing bits (null if all ids there are null). Documents of one fingerprint are one node,
    so copies are never paired. A bucket gives at most one link per member; components
    are found by star contraction over tables in the shared folder. Null and empty
    texts share fingerprint zero. Other columns of ``docs`` are ignored.
    """
    space = Workspace(docs.sparkSession)
    marked = space.save(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    tables = F.array(
        *(
            F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
            for v, mask in enumerate(covering_masks(radius))
        )
    )
    candidates = (
        nodes.select("fp", F.explode(tables).alias("c"))
        .select("c.v", "c.key", "fp")
        .repartition("v", "key")
        .sortWithinPartitions("v", "key", "fp")
    )
    found = space.save(
        candidates.mapInArrow(bucket_links(radius, bucket_limit), "a long, b long"), "found"
    )
    links = found.where("b is not null")
    large = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    if large.take(1):
        links = links.union(_half_radius_links(large, radius))
    roots = connected_components(links, space)
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = placed.join(named, "root").select("fp", "root", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id", "text_id", "fp", "n_shingles", "copies", "root", "component_id"
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents, of each near-duplicate group only one: that of the smallest id.

    A null id counts as the largest. Of repeated rows, and of several texts with that
    id, one stays. Columns and their order stay as they are.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    stay = (
        near_duplicates(docs, **options)
        .groupBy("root")
        .agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_id")).alias("pick"))
        .select("pick.doc_id", "pick.text_id")
    )
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(id_col).alias("id"),
        text_hash(whole(text_col)).alias("text_id"),
    )
    same = rows.id.eqNullSafe(stay.doc_id) & (rows.text_id == stay.text_id)
    kept = rows.join(stay, same, "left_semi").dropDuplicates(["id", "text_id"])
    return kept.select("row.*")
