"""Exact top-k search by inner product with MaxScore.

A component of the vectors is a term, its non-zero values are the term's postings, a batch of vectors is a shard.
For a query, a term adds at most its bound to a score in a shard. Terms by falling bound are essential until the rest
together cannot reach the query's ``k``-th score: a vector without an essential posting is no hit. Postings of
essential terms are summed up; the other terms are probed, in turn, only for the vectors that
still compete. The best of all shards are merged. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.batches import bound_batches
from jobtide.llm.workspace import Workspace

TOP = 5
SCALE = 256
#: Vectors of a shard, and components of the queries that are sent to the tasks together, about.
SHARD_ROWS = 4096
BLOCK_CELLS = 1 << 20
#: Terms that are probed before vectors are left out again.
STEP_TERMS = 4
HIT_SCHEMA = "query_id long, vec_id long, score long"
_EXACT, _LONG = 1 << 53, (1 << 63) - 1


def whole_steps(vector: Column, scale: int = SCALE) -> Column:
    """Every component times ``scale``, rounded down; beyond 64 bits it stays at their end."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


class Shard:
    """Vectors of one length as columns, with the greatest and least value of each."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, vectors: np.ndarray):
        self.ids, self.no_id = ids, no_id
        self.columns = np.ascontiguousarray(vectors.T)
        self.top, self.low = self.columns.max(axis=1), self.columns.min(axis=1)


class Best:
    """The ``k`` best vectors of a query so far: by score, then by id, null ids last."""

    def __init__(self, query_id: int, vector: np.ndarray, k: int):
        self.query_id, self.vector, self.k = query_id, vector, k
        self.scores, self.ids, self.no_id = [], np.empty(0, np.int64), np.empty(0, bool)
        self.probed = 0

    def search(self, shard: Shard) -> None:
        query, floor = self.vector, self.scores[-1] if len(self.scores) == self.k else None
        bounds = np.maximum(np.maximum(query * shard.top, query * shard.low), 0)
        order = np.argsort(-bounds, kind="stable")
        # What the terms from the j-th on may still add.
        rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
        enough = np.flatnonzero(rest < floor) if floor is not None else []
        essential = int(enough[0]) if len(enough) else len(order)
        if len(enough) and not essential:
            return  # not even all terms together
        partial = np.zeros(len(shard.ids), query.dtype)
        for term in order[:essential]:
            partial += query[term] * shard.columns[term]
        mine = (shard.ids == self.query_id) & ~shard.no_id
        rows = np.flatnonzero(~mine if floor is None else ~mine & (partial + rest[essential] >= floor))
        partial = partial[rows]
        for at in range(essential, len(order), STEP_TERMS):
            for term in order[at : at + STEP_TERMS]:
                partial += query[term] * shard.columns[term, rows]
            self.probed += len(rows)
            near = partial + rest[min(at + STEP_TERMS, len(order))] >= floor
            rows, partial = rows[near], partial[near]
        if len(rows) > self.k:
            near = partial >= np.sort(partial)[-self.k]
            rows, partial = rows[near], partial[near]
        self._add(partial.tolist(), shard.ids[rows], shard.no_id[rows])

    def _add(self, scores: list, ids: np.ndarray, no_id: np.ndarray) -> None:
        """Scores are Python integers from here on, so that none is rounded."""
        scores, ids, no_id = [*self.scores, *map(int, scores)], np.r_[self.ids, ids], np.r_[self.no_id, no_id]
        best = sorted(range(len(scores)), key=lambda i: (-scores[i], no_id[i], ids[i]))[: self.k]
        self.scores, self.ids, self.no_id = [scores[i] for i in best], ids[best], no_id[best]


def search_shards(queries: list[tuple[int, np.ndarray]], k: int):
    """A function for ``mapInArrow`` over ``id, vector``: each task's best ``k`` of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, list[Best]] = {}
        for query_id, vector in queries:
            by_length.setdefault(len(vector), []).append(Best(query_id, vector, k))
        greatest = {n: max(abs(int(x)) for b in own for x in [*b.vector, 0]) for n, own in by_length.items()}
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for n, own in by_length.items():
                rows = np.flatnonzero(lengths == n)
                for start in range(0, len(rows), SHARD_ROWS):
                    part = batch.take(pa.array(rows[start : start + SHARD_ROWS]))
                    ids = part.column(0)
                    vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), n)
                    reach = max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0)))) * greatest[n] * n
                    # Sums below 2^53 are exact as doubles; beyond, Python's integers take over.
                    kind = np.float64 if reach < _EXACT else object
                    shard = Shard(
                        ids.fill_null(0).to_numpy(zero_copy_only=False),
                        ids.is_null().to_numpy(zero_copy_only=False),
                        vectors.astype(kind),
                    )
                    for best in own:
                        best.vector = best.vector.astype(kind)
                        best.search(shard)
        found = [b for own in by_length.values() for b in own]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b.query_id for b in found for _ in b.scores], pa.int64()),
                pa.array(np.concatenate([np.empty(0, np.int64), *(b.ids for b in found)]),
                         mask=np.concatenate([np.empty(0, bool), *(b.no_id for b in found)])),
                pa.array([max(-_LONG - 1, min(_LONG, s)) for b in found for s in b.scores], pa.int64()),
            ],
            names=["query_id", "vec_id", "score"],
        )

    return run


def top_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = TOP,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` greatest inner products of every query with other rows.

    ``is_query`` picks the queries among the rows. Components are taken in steps of 1 / ``scale``. Vectors
    that are null or hold null or non-finite components take no part. A query meets the vectors of its own
    length whose id differs; rows without id are no queries and come last among equals. Rows of one id are several
    candidates, but one query, that of the least vector. A score beyond 64 bits stays at their end. An
    empty table gives no rows. Queries go to the tasks in blocks; each block reads all vectors once.
    """
    spark = vectors.sparkSession
    space = Workspace(spark)
    kept = space.save(
        vectors.where(usable(F.col(vector_col))).select(
            F.col(id_col).cast("long").alias("id"),
            whole_steps(F.col(vector_col), scale).alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        ),
        "vectors",
    )
    queries = space.save(
        kept.where("asks and id is not null").groupBy("id").agg(F.min("vector").alias("vector")), "queries"
    )
    cells = queries.agg(F.coalesce(F.sum(F.size("vector") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-cells // max(1, block_cells // 2)))
    bound_batches(spark)
    found = spark.createDataFrame([], HIT_SCHEMA)
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()
        if own:
            run = search_shards([(r.id, np.array(r.vector, np.int64)) for r in own], k)
            found = found.union(kept.select("id", "vector").mapInArrow(run, HIT_SCHEMA))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
