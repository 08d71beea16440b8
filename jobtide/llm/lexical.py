"""Ranked lexical search with dual trees.

Documents are scanned once for the terms of the items, which leaves a small table of term counts. Its rows
are put into trees, a few hundred at a time, and so are the items; a node holds, for every
term, the greatest value below it (coordinate maxima). The product of an item node and a document
node bounds every score between the two. Pairs of nodes are followed downwards while
their bound reaches the weakest ``k``-th score of the node's items, so whole batches are
left out without a score, and no hit is missed. Scores are integers; all arithmetic is exact.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from jobtide.llm.batches import bound_batches, segments
from jobtide.llm.text import ascii_lower, whole
from jobtide.llm.wordscan import range_hashes, spans
from jobtide.llm.workspace import Workspace

TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Terms of items that are searched for together, about: the size of what is sent to the tasks.
BLOCK_TERMS = 1 << 15
#: Characters that one step of the scan takes up; a longer text is cut between terms.
SCAN_CHARS = 1 << 20
#: Cells of a tree's matrix of documents by terms.
TREE_CELLS = 1 << 22
LEAF_DOCS, LEAF_ITEMS, FAN = 16, 8, 4
#: Document leaves that are scored before the bounds are looked at again.
STEP_LEAVES = 8
#: Dimensions in which rows are compared when trees are built.
SKETCH = 16
_BREAK = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_EXACT = float(1 << 53)

_inside = np.ones(128, bool)
_inside[[c for c in range(128) if _BREAK.match(chr(c))]] = False


@dataclass
class Terms:
    """A block's terms, sorted by hash."""

    keys: np.ndarray
    points: np.ndarray  # code points of all terms in a row
    start: np.ndarray
    length: np.ndarray


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def term_table(terms: list[str]) -> tuple[list[str], Terms]:
    """The terms in the order of their hashes, and what the scan needs of them."""
    points = _code_points("".join(terms))
    length = np.array([len(t) for t in terms], np.int64)
    start = np.cumsum(length) - length
    keys = range_hashes(points, start, start + length) if len(terms) else np.empty(0, np.uint64)
    order = np.argsort(keys, kind="stable")
    if len(np.unique(keys)) != len(keys):
        raise ValueError("two terms share a hash")
    return [terms[i] for i in order], Terms(keys[order], points, start[order], length[order])


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``start[i] .. start[i] + length[i]``, one after another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def count_terms(texts: list[str], terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of all terms of every text; and row, term number and count of those in the table."""
    total = np.zeros(len(texts), np.int64)
    keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    size = max(1, len(terms.keys))
    for part in segments(texts, SCAN_CHARS, _BREAK):
        points = _code_points("".join(t for _, t in part))
        points = np.where((points >= 0x41) & (points <= 0x5A), points + 32, points)
        offsets = np.r_[0, np.cumsum([len(t) for _, t in part])]
        begin, end = spans((points >= 128) | _inside[np.minimum(points, 127)], offsets)
        row = np.array([r for r, _ in part])[np.searchsorted(offsets, begin, "right") - 1]
        total += np.bincount(row, minlength=len(texts))
        if not len(terms.keys) or not len(begin):
            continue
        hashes = range_hashes(points, begin, end)
        place = np.minimum(np.searchsorted(terms.keys, hashes), len(terms.keys) - 1)
        hit = np.flatnonzero((terms.keys[place] == hashes) & (terms.length[place] == end - begin))
        if not len(hit):
            continue
        # Equal hashes are not enough: the characters are compared as well.
        place, length = place[hit], (end - begin)[hit]
        same = points[_ranges(begin[hit], length)] == terms.points[_ranges(terms.start[place], length)]
        equal = np.logical_and.reduceat(same, np.cumsum(length) - length)
        key, count = np.unique(row[hit][equal] * size + place[equal], return_counts=True)
        keys.append(key)
        counts.append(count)
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, which, np.concatenate(counts))
    return total, key // size, key % size, count


COUNT_SCHEMA = "doc_id long, n long, terms array<int>, counts array<int>"


def term_counts(docs: DataFrame, terms: Terms, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, terms, counts`` of every row: all its terms counted, and those of the table one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            total, row, term, count = count_terms(texts, terms)
            offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (term, count)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total), *lists], names=["doc_id", "n", "terms", "counts"]
            )

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("t")).mapInArrow(run, COUNT_SCHEMA)


def tree_order(sketch: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows in which those of a leaf, and of neighbouring leaves, are alike.

    Rows are halved along the direction in which they differ most, again and again.
    """
    out, open_ = [], [np.arange(len(sketch))]
    while open_:
        rows = open_.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        own = sketch[rows] - sketch[rows].mean(axis=0)
        _, vectors = np.linalg.eigh(own.T @ own)
        middle = -(-len(rows) // leaf) // 2 * leaf
        order = np.argpartition(own @ vectors[:, -1], middle)
        open_ += [rows[order[middle:]], rows[order[:middle]]]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _sizes(n: int, leaf: int) -> list[int]:
    """Number of nodes of every level, leaves first."""
    sizes = [-(-n // leaf)]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


def _children(nodes: np.ndarray, below: int) -> np.ndarray:
    found = (np.asarray(nodes)[:, None] * FAN + np.arange(FAN)).ravel()
    return found[found < below]


def _row_sums(row: np.ndarray, rows: int, values: np.ndarray) -> np.ndarray:
    """Sums of the vectors of every row; ``row`` rises."""
    out = np.zeros((rows, values.shape[1]))
    if len(row):
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[begin]] = np.add.reduceat(values, begin, axis=0)
    return out


def _sketches(row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int, directions: np.ndarray) -> np.ndarray:
    """Rows as short vectors: sums of the directions of their terms, of length 1."""
    out = _row_sums(row, rows, directions[term] * value[:, None])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def term_directions(row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int, n_terms: int) -> np.ndarray:
    """Directions in which terms of like items lie close: leading singular vectors of items by terms."""
    found = np.random.default_rng(11).standard_normal((n_terms, SKETCH))
    norm = np.sqrt(np.bincount(row, value.astype(np.float64) ** 2, rows))
    value = value / np.maximum(norm, 1e-9)[row]
    by_term = np.argsort(term, kind="stable")
    for _ in range(4):
        items, _ = np.linalg.qr(_row_sums(row, rows, found[term] * value[:, None]))
        found = _row_sums(term[by_term], n_terms, (items[row] * value[:, None])[by_term])
        found = np.linalg.qr(found)[0]
    return found


@dataclass
class ItemTree:
    """Items of a block. A node is its terms and the greatest weight of each below it."""

    ids: list  # in the order of the tree
    leaves: list[tuple[np.ndarray, np.ndarray]]  # terms, and a matrix items x terms
    levels: list[list[tuple[np.ndarray, np.ndarray]]]
    weights: np.ndarray  # of every term
    directions: np.ndarray

    @property
    def n_terms(self) -> int:
        return len(self.weights)


def item_tree(ids: list, held: list[np.ndarray], weights: np.ndarray) -> ItemTree:
    """A tree of items with the terms ``held``; terms without weight have no part in it."""
    held = [h[weights[h] > 0] for h in held]
    row = np.repeat(np.arange(len(ids)), [len(h) for h in held])
    term = np.concatenate([np.empty(0, np.int64), *held])
    directions = term_directions(row, term, weights[term], len(ids), len(weights))
    order = tree_order(_sketches(row, term, weights[term], len(ids), directions), LEAF_ITEMS)
    leaves, nodes = [], []
    for at in range(0, len(order), LEAF_ITEMS):
        own = [held[i] for i in order[at : at + LEAF_ITEMS]]
        columns = np.unique(np.concatenate(own))
        matrix = np.zeros((len(own), len(columns)))
        for k, h in enumerate(own):
            matrix[k, np.searchsorted(columns, h)] = weights[h]
        leaves.append((columns, matrix))
        nodes.append((columns, weights[columns].astype(np.float64)))
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        columns = [np.unique(np.concatenate([c for c, _ in below[k : k + FAN]])) for k in range(0, len(below), FAN)]
        levels.append([(c, weights[c].astype(np.float64)) for c in columns])
    return ItemTree([ids[i] for i in order], leaves, levels, weights, directions)


@dataclass
class DocTree:
    """Documents by terms, in the order of the tree, and the greatest values of every node."""

    ids: np.ndarray
    no_id: np.ndarray
    impact: np.ndarray
    maxima: list[np.ndarray]


def doc_tree(ids, no_id, row, term, impact, items: ItemTree) -> DocTree:
    sketch = _sketches(row, term, impact * items.weights[term], len(ids), items.directions)
    order = tree_order(sketch, LEAF_DOCS)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sizes = _sizes(len(ids), LEAF_DOCS)
    matrix = np.zeros((sizes[0] * LEAF_DOCS, items.n_terms), np.float32)
    matrix[place[row], term] = impact
    maxima = [matrix.reshape(sizes[0], LEAF_DOCS, -1).max(axis=1)]
    while len(maxima[-1]) > 1:
        maxima.append(np.maximum.reduceat(maxima[-1], np.arange(0, len(maxima[-1]), FAN), axis=0))
    return DocTree(ids[order], no_id[order], matrix, maxima)


class Ranking:
    """The best ``k`` documents of every item so far: by score, then by id, null ids last."""

    def __init__(self, items: ItemTree, k: int):
        self.items, self.k, self.compared = items, k, 0
        n = len(items.ids)
        self.kth = np.zeros(n, np.int64)
        self.hits = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in range(n)]

    def weakest(self, level: int, node: int) -> int:
        """The least score that still counts for some item of a node."""
        width = LEAF_ITEMS * FAN**level
        return max(1, int(self.kth[node * width : (node + 1) * width].min()))

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        near = np.flatnonzero(scores >= max(1, self.kth[item]))
        if not len(near):
            return
        new = scores[near].astype(np.int64), ids[near], no_id[near]
        s, i, null = (np.r_[a, b] for a, b in zip(self.hits[item], new, strict=True))
        best = np.lexsort((i, null, -s))[: self.k]
        self.hits[item] = s[best], i[best], null[best]
        if len(best) == self.k:
            self.kth[item] = s[best[-1]]

    def search(self, docs: DocTree) -> None:
        """Take up what a tree of documents adds."""
        for leaf, (nodes, bounds) in self._leaf_pairs(docs).items():
            columns, matrix = self.items.leaves[leaf]
            # Sums up to 2^53 are exact as doubles, others are made in 64-bit integers.
            kind = np.float64 if matrix.sum(axis=1).max() * 1e6 < _EXACT else np.int64
            order = np.argsort(-bounds, kind="stable")
            nodes, bounds = nodes[order], bounds[order]
            at = 0
            while at < len(nodes) and bounds[at] >= self.weakest(0, leaf):
                rows = (nodes[at : at + STEP_LEAVES, None] * LEAF_DOCS + np.arange(LEAF_DOCS)).ravel()
                rows = rows[rows < len(docs.ids)]
                scores = matrix.astype(kind) @ docs.impact[rows[:, None], columns].astype(kind).T
                self.compared += scores.size
                for k, own in enumerate(scores):
                    self.add(leaf * LEAF_ITEMS + k, own, docs.ids[rows], docs.no_id[rows])
                at += STEP_LEAVES

    def _leaf_pairs(self, docs: DocTree) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For item leaves, the document leaves whose bound reaches their weakest score."""
        levels = self.items.levels
        level, depth = len(levels) - 1, len(docs.maxima) - 1
        open_ = {0: np.arange(len(docs.maxima[depth]))}
        while True:
            kept = {}
            for node, others in open_.items():
                columns, greatest = levels[level][node]
                bounds = docs.maxima[depth][others[:, None], columns].astype(np.float64) @ greatest
                near = bounds * (1 + 1e-12) >= self.weakest(level, node)
                if near.any():
                    kept[node] = others[near], bounds[near] * (1 + 1e-12)
            if not level and not depth:
                return kept
            if depth:
                below = len(docs.maxima[depth - 1])
                kept = {node: (_children(others, below), None) for node, (others, _) in kept.items()}
            open_ = {}
            for node, (others, _) in kept.items():
                for child in _children([node], len(levels[level - 1])) if level else [node]:
                    open_[int(child)] = others
            level, depth = max(0, level - 1), max(0, depth - 1)


_HIT = [StructField("doc_id", LongType()), StructField("score", LongType())]


def search_counts(items: ItemTree, id_type: pa.DataType, n_docs: int, n_all: int, k: int):
    """A function for ``mapInArrow`` over ``doc_id, n, terms, counts``: each task's best ``k`` of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = Ranking(items, k)
        at_once = max(2 * LEAF_DOCS, TREE_CELLS // items.n_terms // LEAF_DOCS * LEAF_DOCS)
        for batch in batches:
            for start in range(0, len(batch), at_once):
                part = batch.slice(start, at_once)
                ids = part.column(0)
                row = np.repeat(np.arange(len(part)), part.column(2).value_lengths().to_numpy(zero_copy_only=False))
                if not len(row):
                    continue
                term = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                count = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                n = part.column(1).to_numpy(zero_copy_only=False)
                length = 100 - 90 + (90 * n * n_docs) // n_all
                impact = (1_000_000_000 * count) // (1000 * count + 8 * length[row])
                some = np.unique(row)
                row = np.searchsorted(some, row)
                null = ids.is_null().to_numpy(zero_copy_only=False)[some]
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[some]
                ranking.search(doc_tree(ids, null, row, term, impact, items))
        named = [i for i, (s, _, _) in zip(items.ids, ranking.hits, strict=True) for _ in s]
        scores, ids, null = (np.concatenate(x) for x in zip(*ranking.hits, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(named, id_type), pa.array(ids, mask=null), pa.array(scores)], names=["item_id", "doc_id", "score"]
        )

    return run


def _search_block(counts: DataFrame, items: list, numbers: dict[str, int], id_field: StructField, k: int) -> DataFrame:
    """``item_id, doc_id, score``: the best ``k`` documents in every task for the ``(id, terms)`` of a block."""
    schema = StructType([id_field, *_HIT])
    n_docs, n_all = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(numbers), np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        weights[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    if not (weights > 0).any():
        return counts.sparkSession.createDataFrame([], schema)
    held = [np.array(sorted(numbers[t] for t in terms), np.int64) for _, terms in items]
    tree = item_tree([i for i, _ in items], held, weights)
    return counts.mapInArrow(search_counts(tree, to_arrow_type(id_field.dataType), n_docs, n_all, k), schema)


def ranked_search(
    items: DataFrame,
    docs: DataFrame,
    k: int = TOP,
    item_col: str = "item_id",
    item_text: str = "text",
    id_col: str = "doc_id",
    text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item with a score above 0.

    Items are searched for in blocks of about ``block_terms`` terms; a block reads the documents once, and what
    is sent to the tasks grows with the block. Rows of one item id are one item with the terms
    of all of them, rows without id one item without id. A row of ``docs`` is a document; null and empty texts have
    no term. Equal scores go by rising id, null ids last. An item without terms, or an empty
    table, gives no rows. Other columns are ignored.
    """
    space = Workspace(docs.sparkSession)
    words = F.explode(F.regexp_extract_all(ascii_lower(whole(item_text)), F.lit(TERM_PATTERN), F.lit(0)))
    pairs = space.save(items.select(F.col(item_col).alias("item_id"), words.alias("term")).distinct(), "items")
    blocks = max(1, -(-pairs.count() // max(1, block_terms // 2)))
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    id_field = StructField("item_id", items.schema[item_col].dataType)
    found = docs.sparkSession.createDataFrame([], StructType([id_field, *_HIT]))
    for block in range(blocks):
        own = pairs.where(block_of == block).groupBy("item_id").agg(F.collect_list("term").alias("terms"))
        rows = [tuple(r) for r in own.collect()]
        if not rows:
            continue
        names, table = term_table(sorted({t for _, terms in rows for t in terms}))
        counts = space.save(term_counts(docs, table, id_col, text_col), f"counts-{block}")
        found = found.union(_search_block(counts, rows, {t: i for i, t in enumerate(names)}, id_field, k))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
